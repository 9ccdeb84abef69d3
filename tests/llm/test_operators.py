"""The training-data operators against brute force, on given tables and on edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from riskweave.llm import bpe, chat, classifier, fingerprint, mixing, near_dedup, packing, pitman_yor, quality_rules, substring, text, token_counts
from riskweave.llm.queries import DOMAINS, QUERIES, domain, weights  # noqa: F401
from riskweave.session import shared_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGE = [
    (-5, None), (-4, ""), (-3, "a b"), (-2, "one"), (-6, " 's\x1c\x85 　x  \n\n y'll'S 12 ١٢ <|endoftext|> \U0001f600‍!!\r\n"),
    (7777, " ".join(map(str, range(60)))), (7777, " ".join(map(str, range(60)))), (7778, "é " * 30_000), (None, "w " * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents, edge rows, and columns whose names the operators use themselves."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    return given.unionByName(more).withColumns({"key": F.lit(1), "chunk": F.lit("x"), "s": F.lit(None).cast("string"), "n": F.lit(0), "lang": F.lit("en"), "source": F.lit("src1")})


@pytest.fixture(scope="module")
def data(docs):
    return sorted(((low(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect()))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(ranks):
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def low(doc_id):
    return -(10**9) if doc_id is None else doc_id


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


def shingle_set(text, k):
    w = WORD.findall(text.translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(docs, data, k):
    got = near_dedup.near_groups(docs, k).where("doc_id is not null").collect()
    want = groups([d for d in data if d[0] != low(None)], k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(data) - 1


def test_strays_are_compared(spark):
    """A chain: neighbours are alike, the smallest document is unlike most; every link has to be found."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        base = list(base)
        for _ in range(5):
            base[rnd.randrange(200)] = f"v{rnd.random()}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, 2).collect()} == {i: c for i, (_, c) in groups(rows, 2).items()}


def test_near_dedup_keeps_columns(docs):
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and None in ids


def test_repeats(docs, data):
    got = sorted((low(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.cut_repeats(docs).collect())
    seen, want = set(), []
    for i, text in data:
        w = WORD.findall(text)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            window = tuple(w[a : a + 20])
            if window in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(window)
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    assert got == sorted(want)


def test_repeats_leave_other_texts_alone(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a  b\n{passage}", 5), (2, f"{passage} c", 5), (3, "x  y\tz", 5), (4, " ".join(f"p{i}" for i in range(19)), 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    assert {r.doc_id: (r.text, r.n_chars) for r in substring.remove_repeats(docs).collect()} == {1: (rows[0][1], 5), 2: ("c", 1), 3: ("x  y\tz", 5), 4: (rows[3][1], 5)}


def test_splitter():
    splitter, find = bpe.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    assert bpe.USUAL == public_tokenizers.PATTERN
    rnd = random.Random(3)
    letters = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "a", "B", "1", "!", "é", "ß", "×", "½", "\x1c", "\x85", "　", "'ll", "'S", "\x00", "²", "ſ"]
    for _ in range(1500):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(0, 5))]
        raw = [t.encode() for t in texts]
        block = np.frombuffer(b"".join(raw), np.uint8)
        cuts = splitter.cuts(block, np.cumsum([0, *map(len, raw)]))
        assert [block[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:])] == [x for t in texts for x in find(t)]


def test_bpe(docs, data, ranks, encoder):
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted((low(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((i, encoder.encode_ordinary(t), t.encode()) for i, t in data)


def test_token_counts(docs, data, ranks, encoder):
    back = {v: k for k, v in ranks.items()}
    want = Counter()
    for i, text in data:
        section = np.cumsum([0, *(c == 10 for c in text.encode())])
        at = 0
        for token in encoder.encode_ordinary(text):
            held = Counter(section[at : at + len(back[token])].tolist())
            want[i, max(held, key=lambda s: (held[s], -s))] += 1
            at += len(back[token])
    got = Counter()
    spans = defaultdict(set)
    for r in token_counts.section_counts(docs, ranks, public_tokenizers.PATTERN).collect():
        got[low(r.doc_id), r.section] += r.n_tokens
        spans[low(r.doc_id)].add((r.section, r.start_char, r.end_char))
    assert +got == want
    for i, text in data:
        assert max(e for _, _, e in spans[i]) == len(text)


def test_attribution_rule():
    ends, borders = np.array([2, 6, 8, 12]), np.array([4, 7, 12])  # token 2-6 lies half in each: the earlier section
    n, crossing = token_counts.attribute(ends, borders)
    assert n.tolist() == [2, 1, 1] and crossing.tolist() == [1, 1, 0]


def test_rules(spark, docs, data):
    labels = spark.createDataFrame([(-3, 1), (-3, None), (99999, 0)], "doc_id bigint, quality int")
    got = sorted((low(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs, labels).collect())
    want = []
    for i, text in data:
        w = WORD.findall(text)
        g = Counter(zip(w, w[1:], w[2:]))
        covered = {p for a, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for p in (a, a + 1, a + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want)


def test_binomial_tail(spark):
    cases = [(0, 100), (3, 1000), (5, 400), (90, 10_000), (12, 30), (0, 0)]
    rows = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        exact = 1.0 if r.k >= r.n * 0.01 else sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_certified_cutoff(spark):
    """A rule that separates is certified and takes effect; with few labels nothing is."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(900)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), "en") for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    kept = {r.doc_id for r in quality_rules.apply(docs, labels).collect()}
    assert kept == set(range(900))
    assert quality_rules.apply(docs, labels.where("doc_id < 50 or doc_id >= 1000")).count() == 1000


def test_rules_keep_rows_without_and_with_repeated_ids(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(None, good, "en"), (None, "short", "en"), (5, good, "en"), (5, "short", "en"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = quality_rules.apply(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[0:3:2], key=str)


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (6, b), (7, c), (7, ""), (8, a), (None, a), (None, a)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, a), (5, b), (7, c), (7, ""), (None, a), (None, a)], key=str)


def test_repeats_of_rows_without_and_with_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(None, a), (None, f"{a} c"), (5, f"{a} d"), (5, f"{b} e"), (5, f"x  {b}"), (6, b), (6, b)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (None, "c"), (5, "d"), (5, f"{b} e"), (5, "x"), (6, ""), (6, "")], key=str)


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else "de", f"src{i % 20}") for i in range(2000)] + [(None, None, None, None), (5000, "", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    taken = mixing.mix(docs, weights(spark), 0.5, domain()).collect()
    total = sum(i % 7 + 1 for i in range(2000))
    spent = Counter()
    for r in taken:
        spent[r.mix_domain] += r.mix_tokens
    assert 0.5 * total - 8 * 40 <= sum(spent.values()) <= 0.5 * total
    whole = sum(DOMAINS.values())
    supply = Counter()
    for i, _, _, s in rows[:2000]:
        supply["core" if int(s[3:]) < 5 else "web" if int(s[3:]) < 15 else "rest"] += i % 7 + 1
    assert spent["core"] <= supply["core"] and all(abs(spent[d] - 0.5 * total * w / whole) < 8 * 20 for d, w in DOMAINS.items() if 0.5 * total * w / whole < supply[d])
    assert len({(r.doc_id, r.mix_epoch) for r in taken}) == len(taken)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 90), ("b", "x", "1", 100)], "domain string, lang string, source string, tokens bigint")
    none = spark.createDataFrame([], "level string, name string, w double")
    got = {(r.domain, r.source): r.budget for r in mixing.budgets(leaves, none, 100.0, 1).collect()}
    assert got == {("a", "1"): 10.0, ("a", "2"): 40.0, ("b", "1"): 50.0}
    got = {(r.domain, r.source): r.budget for r in mixing.budgets(leaves, none, 1000.0, 1).collect()}
    assert got == {("a", "1"): 10.0, ("a", "2"): 90.0, ("b", "1"): 100.0}


def test_chat_round_trip():
    rnd = random.Random(1)
    parts = ["<", "s", ">", "/", "[", "INST", "]", "\\", "<s>", "[/INST]", " ", "<<SYS>>", "[TEXT]"]
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "", "tool <s>"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 4))]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def test_chat_events(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "He"), (1, 3, "delta", 1, None, "llo"), (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", "Hey"), (1, 6, "delta", 1, None, "!"), (1, 7, "edit", 0, None, "HI"),
        (None, 1, "delta", 0, None, None), (2, 1, "message", None, None, None),
    ]
    rows = spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(rows).collect()}
    assert got == {1: [("user", "HI"), ("assistant", "Hey!")], None: [("", "")], 2: [("", "")]}
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_fingerprints(docs, data):
    got = fingerprint.fingerprints(docs).collect()
    want = []
    for j, (i, t) in enumerate(data):
        follows = data[(j + 1) % len(data)][1]
        want.append((i, len(t), t[: len(t) - len(t) // 2] + follows[: len(t) // 2]))
    assert sorted((low(r.doc_id), r.n_chars, r.edited_text) for r in got) == sorted(want)
    text = dict(data)
    errors = []
    for r in got:
        a, b = shingle_set(text[low(r.doc_id)], 5), shingle_set(r.edited_text, 5)
        errors.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    by_text = defaultdict(set)
    for r in got:
        by_text[text[low(r.doc_id)]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_similar_classes(docs, data):
    want = {i: c for i, (_, c) in groups([d for d in data if d[0] != low(None)], 5).items()}
    assert {r.doc_id: r.component_id for r in fingerprint.similar(docs).where("doc_id is not null").collect()} == want


def test_fingerprint_query_has_classes(spark):
    """The registered query itself runs the band join over the whole table."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_fingerprints"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, 5) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and len(r.fingerprint) in (0, 512) for r in got)


def test_fingerprints_meet_their_classes_before_they_are_made(spark):
    """Only compressed texts and classes cross a shuffle, no fingerprints; repeated and null doc_ids keep a class per text."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, same), (2, same + " end"), (2, "quite another text of seven words"), (3, None), (4, same), (None, same), (None, ""), (5, "short"), (2, same)]
    rows += [(6, "a" * 64 + x) for x in ("z", "b", "", " y", "b")]  # told apart behind what Spark sorts by
    rows += [(i, f"{i} " * (i % 9) + "tail of the text") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = fingerprint.fingerprints_and_classes(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
    plain = near_dedup.grouped(fingerprint.fingerprints(docs, digests=True), fingerprint.linked(docs, fingerprint.banded(docs), fingerprint.SHINGLE, 80))
    assert sorted(map(repr, made.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert {r.component_id for r in made.collect() if r.doc_id == 2} == {1, 2}
    texts = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    assert sorted(r.edited_sha256 for r in made.collect()) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in edited)


def test_fingerprints_of_long_texts():
    """Minima of very large sets are small numbers; unequal ones must not share their 16 bits."""
    minhash = fingerprint.MinHash(k=1)
    long = [" ".join(f"{x}{i}" for i in range(1 << 20)) for x in "ab"]
    sig, _ = minhash.signatures(pa.array(long))
    assert (sig[0] == sig[1]).sum() <= 1


def held(i, n):
    return zlib.crc32(b"" if i == low(None) else str(i).encode()) % n == 0


def test_language_model(docs, data):
    got = pitman_yor.score(docs).collect()
    tokens = [(i, [*WORD.findall(t.translate(FOLD)), None]) for i, t in data]
    c = Counter(w for i, t in tokens if not held(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i, 10), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens)
    assert sorted((low(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    for side in (True, False):
        rows = [r for r in got if r.held_out == side]
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_is_a_distribution():
    """With all words in one bucket, the predictive probabilities of a context sum to one over known words and one unknown."""
    rng = np.random.default_rng(2)
    k = rng.integers(1, 5, 50)
    context = np.concatenate([np.sort(rng.choice(8, n, replace=False)) for n in k])
    row = {"bucket": 0, "k": k, "context": context, "count": rng.geometric(0.2, len(context))}
    x = pitman_yor.Bucket(row)
    tables = np.bincount(context, minlength=pitman_yor.CLASSES)
    fixed = {"d": 0.6, "d0": 0.5, "strength": 1.0, "base": 1 / 51}
    t, c0, t0 = x.sweep(0, pitman_yor.left_over(tables, int(len(context)), 50), fixed)
    assert (t >= 1).all() and (t <= x.count).all() and (t0 >= 1).all() and (t0 <= c0).all()
    now = pitman_yor.left_over(np.bincount(context, t, minlength=pitman_yor.CLASSES), int(c0.sum()), int(t0.sum()))
    p0 = pitman_yor.parent_probability(c0, t0, now, fixed)
    unknown0 = pitman_yor.parent_probability(np.zeros(1), np.zeros(1), now, fixed)[0]
    assert p0.sum() + unknown0 == pytest.approx(1)
    for u in range(8):
        there = x.count[context == u].sum()
        own = np.zeros(50)
        at = context == u
        np.add.at(own, x.word_of[at], x.count[at] - 0.6 * t[at])
        back = 1 + 0.6 * now["tables"][u]
        assert ((own + back * p0).sum() + back * unknown0) / (1 + there) == pytest.approx(1)


def test_language_model_keeps_contexts_apart(spark):
    """Two words that agree in 16 bits of their hashes are two contexts, and what follows one says nothing of the other."""
    names = [f"n{i}" for i in range(3000)]
    hashes = text.Hasher(lower=True).words(np.frombuffer(" ".join(names).encode(), np.uint8), np.array([0, len(" ".join(names))])).hash
    by_class = defaultdict(list)
    for name, h in zip(names, hashes.tolist()):
        by_class[(h >> 40) % 65536].append(name)
    a, b = next(x for x in by_class.values() if len(x) > 1)[:2]
    ids = [i for i in range(2000) if not held(i, 10)][:400]
    test = [i for i in range(2000) if held(i, 10)][:2]
    rows = [(i, f"{a} p" if j % 2 else f"{b} q") for j, i in enumerate(ids)] + [(test[0], f"{a} p"), (test[1], f"{a} q")]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[test[0]] - got[test[1]] > 1


def test_classifier(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = classifier.classify(docs.unionByName(spark.createDataFrame(EDGE, "doc_id bigint, text string"), allowMissingColumns=True), labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.score, known[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in known]
    assert sum(p == q for _, q, p in rows) / len(rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(low(r.doc_id), 5) for r in got)


def test_only_labelled_texts_meet_the_labels(spark):
    docs = spark.createDataFrame([(i % 5000, f"text {i}") for i in range(10_000)], "doc_id bigint, text string")
    marks = spark.range(0, 5000, 100).select(F.col("id").cast("int").alias("doc_id"), F.lit(1).alias("good"))
    got = [r.doc_id for r in classifier.labelled(docs, marks).collect()]
    assert len(got) < 200 and sorted(i for i in got if i % 100 == 0) == sorted(2 * list(range(0, 5000, 100)))
    assert classifier.labelled(docs, marks.where("good = 0")).count() == 0


def test_classifier_without_labels(spark, docs):
    got = classifier.classify(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).select("score").distinct().collect()
    assert len(got) == 1


def test_features_of_very_long_texts():
    text = "abc " * 300_000
    long, short = list(classifier.features(pa.array([text, text[:400]])))
    assert long.tolist() == short.tolist()


def test_empty_tables(spark, ranks):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    pattern = public_tokenizers.PATTERN
    for out in (
        quality_rules.judge(docs, labels), near_dedup.near_groups(docs), mixing.mix(docs, weights(spark), 0.5, domain()), substring.cut_repeats(docs),
        bpe.decode(bpe.encode(docs, ranks, pattern), ranks), token_counts.section_counts(docs, ranks, pattern), pitman_yor.score(docs),
        classifier.classify(docs, labels), fingerprint.fingerprints(docs), fingerprint.similar(docs),
    ):
        assert out.count() == 0


def test_pressed_numbers():
    """Numbers of any width come back from a cell, in a binary field of ``list_rows`` as from a list."""
    cells = [np.array(x, np.int64) for x in ([], [0, -1, 127], [300, -300], [1 << 20], [-(1 << 63), (1 << 63) - 1])]
    assert [packing.pressed(c)[:1] for c in cells] == [b"b", b"b", b"h", b"i", b"q"]
    assert all((packing.opened(packing.pressed(c)) == c).all() for c in cells)
    table = packing.list_rows(pa.schema([("i", pa.int32()), ("x", pa.binary())]), list(enumerate(cells)))
    assert [c.tolist() for c in packing.lists(table, "x")] == [c.tolist() for c in cells]
    ones = np.ones(100_000, np.int64)
    assert len(packing.pressed(ones)) < 100  # 800,000 bytes as a list


def test_language_model_keeps_few_tables(spark):
    """Kept are the counts, the layout of the homes and two tables a sweep, without a further table of all contexts."""
    kept = Path(shared_dir(spark)) / "riskweave-tables" / spark.sparkContext.applicationId
    before = set(kept.glob("*"))
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(300))) for i in range(60)]
    assert pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 60
    assert len(set(kept.glob("*")) - before) == 2 + 2 * 4
