"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken

from pyspark.sql import functions as F

from riskweave.llm import bpe
from riskweave.session import cut
from test_operators import WORD, groups

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(cut(stage(spark, states[-1], SF)))
        assert name == "byte_bpe" or states[-1].columns == columns
    rows = [{r.doc_id: r for r in s.collect()} for s in states]

    base = set()
    for i, r in rows[0].items():
        w = WORD.findall(r.text)
        g = Counter(zip(w, w[1:], w[2:]))
        covered = {p for a, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for p in (a, a + 1, a + 2)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            base.add(i)
    assert set(rows[1]) <= base
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & base - set(rows[1])) <= 0.05 * len(good & base)

    assert set(rows[2]) == {i for i, (_, c) in groups([(i, r.text) for i, r in rows[1].items()], 5).items() if i == c}

    seen = set()
    for i in sorted(rows[2]):
        w = WORD.findall(rows[2][i].text)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if tuple(w[a : a + 20]) in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(tuple(w[a : a + 20]))
        want = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else rows[2][i].text
        assert rows[3][i].text == want and (rows[3][i].n_chars == len(want) or not any(gone))

    words = {i: len(WORD.findall(r.text)) for i, r in rows[3].items()}
    assert set(rows[4]) <= set(rows[3]) and sum(words[i] for i in rows[4]) <= 0.8 * sum(words.values())

    encoder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r.ids == encoder.encode_ordinary(rows[4][i].text) and r.decoded_sha256 == hashlib.sha256(rows[4][i].text.encode()).hexdigest()


# Names that the operators use themselves, and columns they return.
CLASHES = [
    "_row", "_good", "_mark", "_key", "_cut", "_at", "_after", "_times", "_least", "_most", "row", "mark", "kept", "kept_id", "kept_mark", "component",
    "component_id", "set_key", "keys", "stratum", "reasons", "n_words", "base_failed", "mix_epoch", "mix_tokens", "mix_domain", "dom", "domain", "take_id", "body", "bucket", "chunk",
]


def test_stages_keep_columns_of_any_name(spark):
    from riskweave.llm import mixing, near_dedup, quality_rules, substring
    from riskweave.llm.queries import domain, weights

    rng = random.Random(4)
    line = lambda i: " ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(70 + i % 5))
    texts = [line(i) for i in range(12)]
    texts += [texts[0], texts[1] + " tail " + " ".join(texts[2].split()[10:45])]
    rows = [(i, t, "en", f"src{i % 3}", len(t), f"own{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, own string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), "own") for c in CLASHES})
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for name, out in (
        ("rules", quality_rules.apply(docs, labels)), ("near", near_dedup.near_dedup(docs)), ("cut", substring.remove_repeats(docs)),
        ("mix", mixing.mix(docs, weights(spark), 1.0, domain()).select(*docs.columns)),
    ):
        assert out.columns == docs.columns, name
        found = out.collect()
        assert len(found) >= 12, name
        for r in found:
            for c in CLASHES:
                assert r[c] == f"{c}:{r['own']}" or (name == "mix" and c.startswith("mix_")), (name, c)
