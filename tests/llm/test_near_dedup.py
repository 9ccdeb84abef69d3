"""Candidates of near-deduplication: linear in the documents, whatever a bucket holds."""

import random

import numpy as np

from riskweave.llm import near_dedup

WORDS = [f"w{i}" for i in range(400)]


def edit(i, changes):
    text, rng = list(WORDS), random.Random(i)
    for at in rng.sample(range(400), changes):
        text[at] = f"x{i}_{at}"
    return " ".join(text)


def counted(monkeypatch):
    """How many candidate pairs each confirmation gets."""
    sizes, real = [], near_dedup.confirmed

    def spy(pairs, sets, percent):
        sizes.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirmed", spy)
    return sizes


def test_common_counts_intersections():
    rng = np.random.default_rng(1)
    draw = lambda top: np.unique(rng.integers(0, top, rng.integers(1, 300))).astype(np.uint32)
    left, right = [draw(500) for _ in range(30)], [draw(900) for _ in range(50)]
    assert (near_dedup.common(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()
    assert near_dedup.common(left[:1], left[:1]).tolist() == [[len(left[0])]]


def test_edits_below_the_threshold_give_linear_candidates_and_no_link(spark, monkeypatch):
    sizes = counted(monkeypatch)
    docs = spark.createDataFrame([(i, edit(i, 8)) for i in range(200)], "doc_id bigint, text string")
    groups = near_dedup.near_groups(docs).collect()
    assert len({r.component_id for r in groups}) == 200
    assert max(sizes) <= near_dedup.BANDS * 200 and sizes[-1] == 0  # of 19,900 pairs none leaves a block


def test_edits_of_a_present_text_meet_at_it(spark, monkeypatch):
    sizes = counted(monkeypatch)
    rows = [(i, edit(i, 5)) for i in range(200)] + [(7000, " ".join(WORDS)), (8000, "something else entirely"), (8001, None)]
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {groups[i] for i in range(200)} == {0} and groups[7000] == 0 and groups[8000] == 8000 and groups[8001] == 8001
    assert sizes[0] <= 42 * 201


def test_long_texts_are_compared_by_sketches(spark):
    base = [f"w{i}" for i in range(9000)]
    texts = {0: base, 1: base[:8200], 2: base[2500:] + [f"y{i}" for i in range(2500)], 3: base[:8990] + ["z"] * 10}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 0}
