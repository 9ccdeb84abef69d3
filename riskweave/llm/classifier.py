"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are the distinct byte 3-grams of a whole text, in ``2**BITS`` hash places.  Over all labelled training rows the
documents of either class that have a feature are counted; the log ratio of the two smoothed class shares scales the
indicators, and each row is brought to unit length.  A linear hinge-loss model is fitted to them by dual coordinate
descent, on at most ``SAMPLE`` rows of each class (a documented bound: the rows of lowest seeded digest among all labelled
training rows).  A quarter of these rows is kept from the fit and calibrates the margin to a probability, weighted to the
class shares of all training rows.  The weights (a fixed size) score every text in one pass without a shuffle.

Edge rows: null and empty texts have no feature and get the score of the bare margin; labels that are null or of unknown
documents are ignored, repeated ones count once (the smallest); without labels of both classes every score is the
smoothed share of good labels; doc_id null rows are scored and never train; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.near_dedup import among, bit_set
from riskweave.llm.packing import list_rows
from riskweave.llm.text import U, buffers, mix, pieces
from riskweave.session import cut

BITS, SAMPLE, EPOCHS, COST = 18, 4000, 20, 1.0


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each text, ascending."""
    data, offsets = buffers(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        x = data[a:b].astype(np.uint32)
        if len(x) < 3:
            yield np.zeros(0, np.int32)
            continue
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        found = np.zeros(1 << 24, bool) if len(code) > 1 << 20 else None  # very long texts: flags instead of sorting
        if found is not None:
            found[code] = True
            code = np.flatnonzero(found)
        else:
            code = np.sort(code)
            code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        place = (mix(code.astype(U)) >> U(64 - BITS)).astype(np.int32)
        yield np.unique(place)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels of the training fold (doc_id, good), docs of that fold)."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    marks = labels.where("doc_id is not null and quality is not null").where(fold).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    return marks, docs.where("doc_id is not null").where(fold).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def labelled(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in ``marks``, and few others: told apart by a bit set where they lie, so that the join
    with the labels moves no other text."""
    words, bits = bit_set(marks.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null"))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            batch = batch.filter(among(batch.column(0).to_numpy(), shared.value, bits))
            if batch.num_rows:
                yield batch

    return texts.mapInArrow(run, "doc_id bigint, text string")


def class_counts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(place, good, bad): labelled training documents that have a feature; place -1 counts the documents."""
    wire = pa.schema([("place", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in pieces(batches, 0):
            for found, good in zip(features(batch.column(0)), batch.column(1).to_pylist()):
                counts[1 - good, found] += 1
                counts[1 - good, -1] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 1 << BITS, -1, at), pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], schema=wire)

    return labelled(texts, marks).join(marks, "doc_id").select("text", "good").mapInArrow(run, "place int, good bigint, bad bigint").groupBy("place").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )


def descend(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and offset of the hinge-loss model by dual coordinate descent over unit rows scaled by ``scale``; both
    classes weigh the same in total."""
    rng = np.random.default_rng(5)
    w, b = np.zeros(len(scale)), 0.0
    values = [scale[r] for r in rows]
    values = [v / max(np.sqrt((v * v).sum()), 1e-12) for v in values]
    share = np.array([(sign == s).mean() for s in sign])
    upper = cost * 0.5 / share
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            gradient = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), upper[i])  # squared length of the row with its offset: 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def margin(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    out = np.empty(len(rows))
    for i, r in enumerate(rows):
        v = scale[r]
        out[i] = w[r] @ v / max(np.sqrt((v * v).sum()), 1e-12) + b
    return out


def calibrated(m: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the weighted logistic fit, by damped Newton steps."""
    a, c = 1.0, 0.0
    target = np.where(good > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -35, 35)))
        g = weight * (p - target)
        h = weight * p * (1 - p)
        grad = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        size = min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(c)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17) -> dict:
    """The model: ``scale``, ``w``, ``b``, ``slope``, ``offset``, or only ``share`` where a class is missing."""
    marks, texts = training_rows(docs, labels)
    marks = cut(marks)
    counts = class_counts(texts, marks).collect()  # at most 2**BITS + 1 rows
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    n_good = n_bad = 0
    for r in counts:
        if r["place"] < 0:
            n_good, n_bad = r["good"], r["bad"]
        else:
            good[r["place"]], bad[r["place"]] = r["good"], r["bad"]
    if not n_good or not n_bad:
        return {"share": (n_good + 1) / (n_good + n_bad + 2)}
    p, q = good + 1.0, bad + 1.0
    scale = np.log((p / p.sum()) / (q / q.sum()))
    drawn = texts.select("doc_id").join(marks, "doc_id").distinct().withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    few = drawn.where("good = 1").orderBy("draw", "doc_id").limit(SAMPLE).unionByName(drawn.where("good = 0").orderBy("draw", "doc_id").limit(SAMPLE))
    few = cut(few)
    wire = pa.schema([("good", pa.int64()), ("draw", pa.int64()), ("found", pa.list_(pa.int32()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), features(batch.column(0))))
            yield from list_rows(wire, rows).to_batches()

    sample = texts.join(F.broadcast(few), "doc_id").select("text", F.col("good").cast("long").alias("good"), "draw").mapInArrow(find, "good bigint, draw bigint, found array<int>")
    shares = {1: n_good / (n_good + n_bad), 0: n_bad / (n_good + n_bad)}
    spread = docs.sparkSession.sparkContext.broadcast(scale)

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("good", "ascending")])
        y = table["good"].to_numpy()
        rows = [r for c in table["found"].chunks for r in (x.values.to_numpy() for x in c)]
        kept = np.arange(len(y)) % 4 == 3
        if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
            kept[:] = False
        take = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
        w, b = descend(take(~kept), spread.value, np.where(y[~kept] > 0, 1.0, -1.0))
        judge = kept if kept.any() else ~kept
        weight = np.array([shares[v] / max((y[judge] == v).mean(), 1e-9) for v in y[judge]])
        slope, offset = calibrated(margin(take(judge), spread.value, w, b), y[judge], weight)
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": [b], "slope": [slope], "offset": [offset]})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "w array<double>, b double, slope double, offset double").first()
    return {"scale": scale, "w": np.array(found["w"]), "b": found["b"], "slope": found["slope"], "offset": found["offset"]}


def predict(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wire = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, 1):
            if "share" in m:
                score = np.full(batch.num_rows, m["share"])
            else:
                z = m["slope"] * margin(list(features(batch.column(1))), m["scale"], m["w"], m["b"]) + m["offset"]
                score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=wire)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, by a model learned from its labelled training fold."""
    scored = predict(docs, fit(docs, labels))
    return scored.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).select("doc_id", "held_out", "score", "predicted")
