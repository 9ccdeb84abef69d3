import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from riskweave.functions import privacy
from riskweave.operators import policy

KEY = hashlib.sha256(b"k").digest()


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("card 4111111111111111 ok", "card <PAN> ok"),
        ("iban FR7630006000011234567890189.", "iban <IBAN>."),
        ("from 10.0.0.1 to 999.1.2.3", "from <IP> to <IP>"),
        ("short 12345678901", "short 12345678901"),
        ("x12345678901234", "x12345678901234"),
        ("", ""),
        (None, None),
    ],
)
def test_mask(spark, text, masked):
    assert one(spark, text, privacy.mask_pii) == masked


def test_agent_is_cut_before_masking(spark):
    assert one(spark, "a" * 110 + " 10.0.0.1 tail", privacy.mask_agent) == "a" * 110 + " <IP> "
    assert one(spark, "a" * 114 + " 10.0.0.1", privacy.mask_agent) == "a" * 114 + " 10.0."


@pytest.mark.parametrize("key", [b"short", KEY, b"x" * 100])
def test_hmac_equals_standard(spark, key):
    assert one(spark, "acc_é", lambda c: privacy.pii_token(c, key)) == hmac.new(key, "acc_é".encode(), hashlib.sha256).hexdigest()


def test_cipher_round_trip_on_one_line(spark):
    plain = "x" * 500
    encrypted = one(spark, plain, lambda c: privacy.encrypt_pii(c, KEY))
    assert "\n" not in encrypted and len(base64.b64decode(encrypted)) == 12 + 500 + 16
    assert one(spark, encrypted, lambda c: privacy.decrypt_pii(c, KEY)) == plain


def test_signature_equals_standard(spark):
    row = spark.createDataFrame([("POST", "/p", "17", "body", None)], "m string, p string, t string, b string, n string")
    cols = [F.col(c) for c in "mptbn"]
    expected = base64.b64encode(hmac.new(KEY, b"POST|/p|17||body", hashlib.sha256).digest()).decode()
    assert row.select(privacy.sign(*cols, KEY)).first()[0] == expected


def test_network_and_device(spark):
    assert one(spark, "10.1.2.3", privacy.ip_cidr24) == "10.1.2.0/24"
    assert one(spark, "::1", privacy.ip_cidr24) == "::1"
    assert [one(spark, v, privacy.valid_device) for v in ("dev1", "dev-1", "", None)] == [True, False, False, False]
    assert one(spark, "a-b.c", privacy.sanitize_name) == "a_b_c"


@pytest.mark.parametrize("claimed, reason", [("100", None), ("40", None), ("39", "signature_expired"), ("161", "signature_expired"), ("x", "invalid_timestamp"), (None, "missing_signature")])
def test_skew(spark, claimed, reason):
    assert one(spark, claimed, lambda c: privacy.skew_reason(F.lit(100), c)) == reason


def token(claims, alg="HS256", key=KEY):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    text = part(json.dumps({"alg": alg}).encode()) + "." + part(json.dumps(claims).encode())
    return text + "." + part(hmac.new(key, text.encode(), hashlib.sha256).digest())


GOOD = {"iss": "i", "aud": "a", "iat": 50, "exp": 200}


@pytest.mark.parametrize(
    "value, reason",
    [
        (token(GOOD), None),
        (token(GOOD, alg="none"), "algorithm"),
        (token(GOOD, key=b"other"), "signature"),
        (token({**GOOD, "exp": 100}), "expired"),
        (token({**GOOD, "aud": "b"}), "audience"),
        (token({**GOOD, "iss": "b"}), "issuer"),
        (token({k: v for k, v in GOOD.items() if k != "iat"}), "missing_claim"),
        ("a.b", "malformed"),
        ("###.###.###", "algorithm"),
        (None, "malformed"),
    ],
)
def test_claim_token(spark, value, reason):
    assert one(spark, value, lambda c: privacy.token_reason(c, F.lit(100), KEY, "i", "a")) == reason


@pytest.mark.parametrize(
    "name, license, classifiers, blocked",
    [
        ("p", "MIT", [], False),
        ("p", "GPLv3", [], True),
        ("p", "LGPL", [], True),  # deny is tested first and matches inside LGPL
        ("p", "Lesser General Public License", [], False),
        ("p", "General Public License", [], True),
        ("p", "MIT", ["GNU Affero"], True),
        ("p", "GPL", ["MIT License"], True),  # no verdict from the classifier, so the short license counts
        ("p", "GPL " + "x" * 80, [], False),  # full text is not read as a name
        ("ignored-x", "GPL", [], False),
        ("p", "", [], True),
        ("p", None, None, True),
    ],
)
def test_policy(spark, name, license, classifiers, blocked):
    df = spark.createDataFrame([(name, license, classifiers)], "name string, license string, classifiers array<string>")
    rules = policy.Policy(ignore_packages=["^ignored"], block_unknown=True)
    assert policy.policy_flag(df, rules).first()["blocked"] is blocked
