import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import evaluate, ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.4).astype(int)
    kind = rng.choice(["standard", "premium", "business"], 600)
    data = [(i, *map(float, r), str(k), int(t)) for i, (r, k, t) in enumerate(zip(x, kind, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, kind string, label int").repartition(4).cache()


def test_logistic_learns_and_ignores_unknown_category(spark, rows):
    model = ml.fit_logistic(rows, ["a", "b", "c"], "kind", "label", max_iter=100)
    assert evaluate.roc_auc(model.transform(rows), "label", "probability").first()["auc"] > 0.97
    odd = model.transform(rows.withColumn("kind", F.lit("never seen")))
    assert odd.where("probability IS NULL").count() == 0


def test_forest_report(spark, rows):
    report = ml.train_report(rows, ["a", "b", "c"], "label", trees=15, depth=6).first()
    assert report["auc"] > 0.95 and report["rows"] == 600 and report["features"] == ["a", "b", "c"]
    assert 0.1 <= report["optimal_threshold"] <= 0.9 and report["precision"] > 0.8 and report["recall"] > 0.8


def test_forest_of_many_rows_is_fitted_in_groups_of_trees(spark, rows, tmp_path):
    assert ml.tree_groups(200, 36_000_000) == [25] * 8 and ml.tree_groups(200, 5_000_000) == [200] and ml.tree_groups(200, 0) == [200]
    assert ml.tree_groups(7, 10, 20) == [1, 2, 2, 2] and ml.tree_groups(3, 10, 1) == [1, 1, 1]
    model = ml.fit_forest(rows, ["a", "b", "c"], "label", trees=7, depth=4, cells=2 * rows.count())
    parts = model.pipeline.stages[1:]
    assert [p.getNumTrees for p in parts] == [1, 2, 2, 2]
    model.write().save(str(tmp_path / "groups"))
    scores = [[r["probability"] for r in m.transform(rows).orderBy("id").collect()] for m in (model, ml.Tabular.load(str(tmp_path / "groups")))]
    assert scores[0] == scores[1]
    # every tree has the same say
    kept = rows.select("*", *[F.col(c).cast("double").alias(f"_x_{c}") for c in "abc"])
    votes = model.pipeline.transform(ml.scale(kept, model.scaler, ["_x_a", "_x_b", "_x_c"])).orderBy("id").collect()
    mean = [sum(float(r[f"_raw{i or ''}"][1]) for i in range(4)) / 7 for r in votes]
    assert scores[0] == pytest.approx(mean, abs=1e-12)


def test_forest_of_many_rows_uses_all_cores(spark, rows, monkeypatch):
    monkeypatch.setattr(ml, "WHOLE_ROWS", 100)
    monkeypatch.setattr(ml, "LEAST_ROWS", 50)
    seen = []
    fit = ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    ml.fit_forest(rows.coalesce(1), ["a", "b", "c"], "label", trees=5, depth=4)
    assert seen == [8]


def test_local_score_uses_block_threshold(spark, rows):
    model = ml.fit_forest(rows, ["a", "b", "c"], "label", trees=10, depth=5)
    out = ml.score_local(rows, model)
    assert out.where("(decision = 'FRAUD') <> (probability >= 0.85)").count() == 0
    assert out.where("decision = 'FRAUD'").count() > 0


def test_isolation_forest_finds_planted_outlier(spark, rows):
    planted = rows.unionByName(spark.createDataFrame([(-1, 9.0, -9.0, 9.0, "standard", 0)], rows.schema))
    forest = ml.fit_iforest(planted.where("label = 0"), ["a", "b", "c"], "id", trees=60)
    out = forest.score(planted).orderBy("anomaly_raw")
    assert out.first()["id"] == -1
    share = forest.score(planted.where("label = 0")).select(F.avg((F.col("anomaly_raw") < 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.02, abs=0.01)
    again = ml.fit_iforest(planted.where("label = 0").repartition(7), ["a", "b", "c"], "id", trees=60)
    assert again.offset == pytest.approx(forest.offset)


def test_saved_models_score_as_before(spark, rows, tmp_path):
    for name, trainer in (("logistic", ml.LogisticTrainer(["a", "b", "c"], "kind", "label", 50)), ("forest", ml.ForestTrainer(["a", "b", "c"], "label", 8, 4))):
        model = trainer.fit(rows)
        model.write().save(str(tmp_path / name))
        again = ml.Tabular.load(str(tmp_path / name))
        scores = [[r["probability"] for r in m.transform(rows).orderBy("id").collect()] for m in (model, again)]
        assert scores[0] == scores[1] and again.numeric == ["a", "b", "c"]
    forest = ml.fit_iforest(rows, ["a", "b"], "id", trees=12)
    forest.write().save(str(tmp_path / "iforest"))
    again = ml.IsolationForest.load(str(tmp_path / "iforest"))
    assert [r["anomaly_raw"] for r in forest.score(rows).orderBy("id").collect()] == [r["anomaly_raw"] for r in again.score(rows).orderBy("id").collect()]
    with pytest.raises(Exception):
        forest.write().save(str(tmp_path / "iforest"))
    forest.write().overwrite().save(str(tmp_path / "iforest"))


def test_tree_samples_are_the_lowest_hashes_of_each_tree(spark):
    df = spark.range(6000).withColumn("v", F.col("id").cast("double"))
    x = F.array("v")
    got = ml.tree_samples(df, x, "id", 7, 3, size=40).groupBy("tree").agg(F.sort_array(F.collect_list(F.col("x")[0])).alias("v")).collect()
    drawn = df.select("v", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("tree")).withColumn("h", F.xxhash64(F.col("v").cast("long"), F.lit(3), "tree")).toPandas()
    want = {t: sorted(part.nsmallest(40, "h")["v"]) for t, part in drawn.groupby("tree")}
    assert {r["tree"]: r["v"] for r in got} == want
    few = ml.tree_samples(df.where("id < 30"), x, "id", 3, 3, size=40)
    assert few.groupBy("tree").count().select("count").distinct().collect()[0][0] == 30
    assert ml.tree_samples(df.where("id < 0"), x, "id", 3, 3, size=40).count() == 0


def test_autoencoder_equals_numpy_and_beats_principal_components(spark):
    rng = np.random.default_rng(8)
    t = rng.uniform(-1, 1, (300, 2))
    data = np.c_[t, np.abs(t[:, 0]) * 2, np.maximum(t[:, 1], 0) * 2, np.abs(t[:, 0] + t[:, 1]), np.abs(t[:, 0] - t[:, 1])]
    odd = [(-1, None), (-2, [1.0]), (-3, [float("nan")] * 6)]
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(data)] + odd, "id long, v array<double>").repartition(3)
    model = ml.fit_autoencoder(df, "v", [16, 2, 16], steps=40, rate=0.02)
    mean, std = data.mean(axis=0), data.std(axis=0)
    x, layers = (data - mean) / std, ml.initial_layers(6, [16, 2, 16], 42)
    moments = [(np.zeros_like(v), np.zeros_like(v)) for pair in layers for v in pair]
    losses = []
    for step in range(1, 41):
        sums = ml.gradient(layers, x)
        losses.append(sums[0][0] / 300)
        layers = ml.adam(layers, sums[1:], 300, moments, step, 0.02, 1e-4)
    for (w, b), (w2, b2) in zip(model.layers, layers):
        assert np.allclose(w, w2, atol=1e-8) and np.allclose(b, b2, atol=1e-8)
    # the gradient itself, by differences
    base, at = ml.gradient(ml.initial_layers(6, [16, 2, 16], 1), x), (2, 3)
    moved = ml.initial_layers(6, [16, 2, 16], 1)
    moved[0][0][at] += 1e-6
    assert (ml.gradient(moved, x)[0][0] - base[0][0]) / 1e-6 == pytest.approx(base[-2][at], rel=1e-3)
    # trained on in numpy, it ends below two principal components
    for step in range(41, 1500):
        layers = ml.adam(layers, ml.gradient(layers, x)[1:], 300, moments, step, 0.02, 1e-4)
    error = ((ml._activations(layers, x)[-1] - x) ** 2).sum()
    _, _, basis = np.linalg.svd(x, full_matrices=False)
    assert losses[-1] < losses[0] / 2 and error < ((x - x @ basis[:2].T @ basis[:2]) ** 2).sum()
    back = {r["id"]: r["recon"] for r in model.reconstruct(df.where("id <> -2"), "v").collect()}
    assert back[-1] is None and np.allclose(back[0], ml._activations(model.layers, x[:1])[-1][0] * std + mean)


def test_reconstruction_with_all_components_is_exact(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, -1.0],), ([0.5, 0.5],), (None,)], "v array<double>")
    model = ml.fit_recon(df.where("v IS NOT NULL"), "v", 2)
    for r in ml.reconstruct(df, model, "v").collect():
        assert r["recon"] is None if r["v"] is None else r["recon"] == pytest.approx(r["v"])


def test_dense_score(spark):
    w = {"mean": np.zeros(2, np.float32), "std": np.ones(2, np.float32), "layers": [(np.eye(2, dtype=np.float32), np.zeros(2, np.float32), True)]}
    df = spark.createDataFrame([([1.0, 1.0],), ([-0.2, 0.0],), ([-5.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [round(r["autoencoder"], 5) for r in ml.score_dense(df, w, "v").collect()] == [0.0, 0.2, 1.0, 0.0, 0.0]


def test_lstm_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    hidden, dim = 3, 2
    w = {
        "mean": rng.normal(size=dim), "std": np.array([2.0, 0.5]), "w_ih": rng.normal(size=(4 * hidden, dim)), "w_hh": rng.normal(size=(4 * hidden, hidden)),
        "b": rng.normal(size=4 * hidden), "head": [(rng.normal(size=(2, hidden)), rng.normal(size=2)), (rng.normal(size=(1, 2)), rng.normal(size=1))],
    }
    sig = lambda v: 1 / (1 + np.exp(-v))

    def plain(seq):
        h, c = np.zeros(hidden), np.zeros(hidden)
        for x in seq:
            z = w["w_ih"] @ ((np.array(x) - w["mean"]) / w["std"]) + w["w_hh"] @ h + w["b"]
            i, f, g, o = z[:3], z[3:6], z[6:9], z[9:]
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
        (w1, b1), (w2, b2) = w["head"]
        return float(sig(w2 @ np.maximum(w1 @ h + b1, 0) + b2)[0])

    seqs = [[list(map(float, r)) for r in rng.normal(size=(n, dim))] for n in (1, 4, 4, 2)]
    df = spark.createDataFrame([(s,) for s in seqs] + [([],), (None,)], "s array<array<double>>")
    out = [r["lstm"] for r in ml.score_lstm(df, w, "s").collect()]
    assert out == pytest.approx([plain(s) for s in seqs] + [0.0, 0.0])


def test_background_is_stable(spark, rows):
    first = {r["id"] for r in ml.background(rows, 50, "id", 1).collect()}
    assert len(first) == 50 and first == {r["id"] for r in ml.background(rows.repartition(9), 50, "id", 1).collect()}


def test_registered_fits_have_the_reference_size(spark, monkeypatch):
    """200 trees of depth 8, and 100 isolation trees."""
    import inspect

    from riskweave.plans import QUERIES

    class Seen(Exception):
        pass

    def spy(fit):
        def called(*args, **named):
            given = inspect.signature(fit).bind(*args, **named)
            given.apply_defaults()
            raise Seen(given.arguments["trees"], given.arguments.get("depth"))

        return called

    for name in ("fit_forest", "fit_iforest"):
        monkeypatch.setattr(ml, name, spy(getattr(ml, name)))
    for query, size in {"t2_fit_forest": (200, 8), "t3_isolation_forest": (100, None), "t6_train_report": (200, 8), "m12_score_local": (200, 8)}.items():
        with pytest.raises(Seen) as seen:
            QUERIES[query](spark, "/root/testdata/sf0.001")
        assert seen.value.args == size
