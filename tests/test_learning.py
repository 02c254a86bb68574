import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelane.operators import quantiles, splits
from kinelane.operators.learning import cluster, forest, forest_search, members, per_column, project_2d, score_windows, silhouette
from kinelane.operators.metrics import classification_report, confusion_cells
from kinelane.operators.quantiles import exact_quantiles
from kinelane.operators.scaling import apply_minmax, fit_minmax, minmax_series, standardise_series
from kinelane.operators.splits import class_weights, random_split
from kinelane.operators.verdicts import majority_vote, mean_vector, pointed_document
from kinelane.plans.pipelines import row_verdicts, train_rows, train_segments, train_windows, window_verdicts
from kinelane.schema import AXES
from series import frame


@pytest.mark.parametrize("digits, ordered", [(3, 1_000_000), (1, 4)])
def test_split_sizes_are_exact(spark, monkeypatch, digits, ordered):
    """Buckets of three digits put in order at once, or cut digit by digit to four rows."""
    monkeypatch.setattr(splits, "DIGITS", digits)
    monkeypatch.setattr(splits, "ORDERED", ordered)
    rows = spark.range(1003).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    assert random_split(rows, ["id"]).filter("part = 'test'").count() == 201
    got = {(r.label, r.part): r["count"] for r in random_split(rows, ["id"], (0.2, 0.25), ("test", "valid", "train"), "label").groupBy("label", "part").count().collect()}
    assert got == {(1, "test"): 21, (1, "valid"): 20, (1, "train"): 60, (0, "test"): 181, (0, "valid"): 181, (0, "train"): 540}
    assert {r.part for r in random_split(rows.limit(1), ["id"]).collect()} == {"test"}
    assert random_split(rows.limit(0), ["id"]).count() == 0
    again = random_split(rows.repartition(5), ["id"]).filter("part = 'test'")
    assert {r.id for r in again.collect()} == {r.id for r in random_split(rows, ["id"]).filter("part = 'test'").collect()}


@pytest.mark.parametrize("accuracy, ordered", [(10_000, 1_000_000), (20, 7)])
def test_quantiles_with_outliers_and_hot_values(spark, monkeypatch, accuracy, ordered):
    """Brackets of some or of nearly all rows, values in one order or cut into slots."""
    monkeypatch.setattr(quantiles, "ORDERED", ordered)
    rng = np.random.default_rng(3)
    groups = {
        "smooth": rng.normal(size=999),
        "outlier": np.r_[rng.normal(size=500), 1e12],
        "hot": np.r_[np.full(700, 3.0), rng.normal(size=200)],
        "one": np.array([4.0]),
        "pair": np.array([1.0, 2.0]),
        "ends": np.r_[np.full(30, -np.inf), rng.normal(size=50), np.full(30, np.inf)],
    }
    rows = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()])
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = exact_quantiles(spark.createDataFrame(rows), ["g"], "x", ps, accuracy=accuracy).collect()
    got = {(r.g, r.p): r.x for r in out}
    for k, v in groups.items():
        v, some = np.sort(v), ps if k != "ends" else [0.5]
        assert np.allclose([got[(k, p)] for p in some], np.quantile(v, some)), k


def test_an_outlier_enlarges_no_bracket(spark):
    """What a task holds of 20,000 rows is the same with and without one row of 1e12."""
    x = np.random.default_rng(8).normal(size=20_000)
    sizes = []
    for last in (1.0, 1e12):
        rows = spark.createDataFrame(pd.DataFrame({"g": "a", "_v": np.r_[x, last]}))
        q = F.percentile_approx("_v", F.array(*[F.lit(p) for p in (0.499, 0.501)]), F.lit(10_000))
        totals = rows.groupBy("g").agg(F.count("*").alias("_n"), q.alias("_q"))
        sizes.append(quantiles._bracketed(rows, totals, True, ["g"], 1).count())
    assert sizes[0] < 100 and abs(sizes[0] - sizes[1]) <= 2


def test_scaling_of_constant_columns(spark):
    df = frame(spark, {"c": np.full(5, 2.0), "v": np.array([1.0, 3.0, 2.0])})
    got = {(r.series_id, r.seq): r.x_scaled for r in minmax_series(df, ["x"]).collect()}
    assert [got[("c", i)] for i in range(5)] == [0.0] * 5 and [got[("v", i)] for i in range(3)] == [0.0, 1.0, 0.5]
    std = {(r.series_id, r.seq): r.x_trans for r in standardise_series(df, ["x"]).collect()}
    assert std[("c", 0)] == 0.0 and np.isclose(std[("v", 1)], 1.0 / np.std([1, 3, 2]))
    late = apply_minmax(df.withColumn("x", F.lit(9.0)), fit_minmax(df, ["x"]), ["x"])
    assert late.first().x_scaled == 4.0  # outside the fitted range stays outside


def test_report_and_confusion(spark):
    rows = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)], "label int, prediction int")
    cells = {(r.label, r.prediction): r["count"] for r in confusion_cells(rows).collect()}
    assert sum(cells.values()) == 11 and cells[(2, 2)] == 0 and cells[(2, 0)] == 1
    rep = {r.name: r for r in classification_report(rows).collect()}
    assert np.isclose(rep["0"].precision, 5 / 6) and np.isclose(rep["0"].recall, 5 / 7) and rep["2"].f1 == 0.0
    assert np.isclose(rep["accuracy"].f1, 8 / 11) and rep["weighted avg"].support == 11


def test_votes_and_vectors(spark):
    rows = spark.createDataFrame([("a", 1, [0.5, 0.5]), ("a", 0, [0.5, 0.5]), ("b", 2, [0.1, 0.9])], "series_id string, prediction int, probs array<double>")
    assert {r.series_id: r["class"] for r in majority_vote(rows).collect()} == {"a": 0, "b": 2}
    assert {r.series_id: (r["class"], r.class_name) for r in mean_vector(rows, "probs", 2).collect()} == {"a": (0, "Flexión"), "b": (1, "Extensión")}


def test_pointer(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    sessions = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, updated_at int")
    assert [r.v for r in pointed_document(docs, sessions).collect()] == [2]
    assert pointed_document(docs, sessions.limit(0)).count() == 0


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert {r.label: round(r.weight, 6) for r in class_weights(rows).collect()} == {0: round(4 / 6, 6), 1: 2.0}


def _blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (30, 2))])
    rows = pd.DataFrame({"series_id": [f"s{i:02d}" for i in range(70)], "a": x[:, 0], "b": x[:, 1], "cluster": [0] * 40 + [1] * 30})
    return x, np.array(rows.cluster), spark.createDataFrame(rows)


def _silhouette(x, c, square):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if square else np.sqrt(d)
    s = []
    for i in range(len(x)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) if o != c[i])
        s.append((b - a) / max(a, b))
    return np.mean(s)


def test_silhouettes(spark):
    x, c, df = _blobs(spark)
    assert np.isclose(silhouette(df, ["a", "b"]).first().silhouette, _silhouette(x, c, True))


def test_clusters_and_projection(spark):
    x, c, df = _blobs(spark)
    found, model = cluster(df.drop("cluster"), ["a", "b"], restarts=3)
    groups = {}
    for r in members(found).collect():
        groups.setdefault(r.cluster, set()).add(r.series_id)
    assert sorted(map(len, groups.values())) == [30, 40]
    points, centres = project_2d(df, ["a", "b"], model.centres)
    z = x - x.mean(0)
    v = np.linalg.svd(z, full_matrices=False)[2]
    v = v * np.sign(v[np.arange(2), np.abs(v).argmax(1)])[:, None]
    got = points.orderBy("series_id").select("pc1", "pc2").toPandas().to_numpy()
    assert np.allclose(got, z @ v.T) and len(centres) == 2
    with pytest.raises(ValueError):
        cluster(df.limit(1).drop("cluster"), ["a", "b"])


def test_clusters_of_a_known_split(spark):
    """Five far groups of unequal size: the best of the starts finds them exactly; odd rows get no cluster."""
    rng = np.random.default_rng(4)
    sizes = [200, 60, 20, 6, 2]
    own = np.repeat(np.arange(5), sizes)
    x = np.array([[0, 0], [50, 0], [0, 50], [50, 50], [25, 25]])[own] + rng.normal(size=(len(own), 2))
    rows = [(str(i), *map(float, v)) for i, v in enumerate(x)] + [("null", None, 1.0), ("nan", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "series_id string, a double, b double").repartition(7)
    found, model = cluster(df, ["a", "b"], k=5, restarts=14)
    got = {r.series_id: r.cluster for r in found.collect()}
    assert got.pop("null") is None and got.pop("nan") is None
    assert len({(own[int(i)], c) for i, c in got.items()}) == 5
    means = np.array([x[own == g].mean(0) for g in range(5)])
    assert np.allclose(model.centres, sorted(means.tolist()))
    assert np.isclose(model.cost, ((x - means[own]) ** 2).sum())
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "series_id string, a double")
    found, model = cluster(same, ["a"], k=2)
    assert [r.cluster for r in found.collect()] == [0, 0, 0] and model.cost == 0


def test_user_model_and_column_functions(spark):
    rows = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]])], "series_id string, features array<array<double>>")

    def load():
        return lambda batch: batch.mean(axis=1)

    assert score_windows(rows, load).first().probs == [2.0, 3.0]
    got = per_column(spark.createDataFrame([(-1.0,)], "x double"), ["x"], F.abs, "_abs").first()
    assert got.x_abs == 1.0


def _recordings(spark):
    """Recordings of four classes that differ in the size and axis of their swing."""
    rng = np.random.default_rng(11)
    names = ["flex_bajo_cuello_1rep_", "ext_subo_cuello_1rep_", "idle_cuello_", "gir_flex_izqda_1rep_"]
    parts = []
    for k, name in enumerate(names):
        for j in range(4):
            n = 150 + 7 * j
            t = np.arange(n) * 2 * np.pi / 60
            swing = rng.normal(0, 0.05, (n, 6))
            swing[:, k] += np.sin(t) * (0.0 if k == 2 else 2.0)
            swing[:, 3 + k % 3] += 1.5 * (k != 2)
            parts.append(pd.DataFrame({"series_id": f"{name}{j}", "seq": np.arange(n), "n": n, "label": k % 2, **{a: swing[:, i] for i, a in enumerate(AXES)}}))
    return spark.createDataFrame(pd.concat(parts))


def test_window_model_end_to_end(spark):
    rows = _recordings(spark)
    trained = train_windows(rows, iterations=60)
    assert trained.test.count() > 0
    got = {r.series_id: r["class"] for r in window_verdicts(rows, trained.model).collect()}
    want = {"flex": 0, "ext_": 1, "idle": 2, "gir_": 3}
    assert np.mean([want[k[:4]] == v for k, v in got.items()]) > 0.8 and len(got) == 16


def test_row_and_segment_forests(spark):
    rows = _recordings(spark)
    trained = train_rows(rows, trees=5, depth=5)
    votes = {r.series_id: r["class"] for r in row_verdicts(rows, trained.model, trained.scaler).collect()}
    truth = {r.series_id: r.label for r in rows.select("series_id", "label").distinct().collect()}
    assert np.mean([truth[k] == v for k, v in votes.items()]) > 0.8
    found = train_segments(rows, width=40, grid={"numTrees": [2, 3], "maxDepth": [3]}, folds=2)
    assert found.test.select("prediction").count() > 0


def test_search_serves_all_sizes_from_blocks_of_trees(spark):
    """The accuracy of the least forest is that of a forest fitted apart; classes that differ plainly are told apart."""
    rng = np.random.default_rng(2)
    y = np.arange(90) % 3
    rows = spark.createDataFrame(pd.DataFrame({"a": y + rng.normal(0, 0.6, 90), "b": rng.normal(size=90), "label": y}))
    grid = {"numTrees": [4, 8, 12], "maxDepth": [2, 5], "minInstancesPerNode": [1]}
    found = forest_search(rows, ["a", "b"], weight=None, grid=grid, folds=3)
    assert found.candidates == [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": 1} for t in (4, 8, 12) for d in (2, 5)]
    folds = rows.withColumn("_fold", F.floor(F.rand(42) * 3).cast("int")).checkpoint()
    for depth, got in zip((2, 5), found.accuracies[:2]):
        apart = []
        for k in range(3):
            model = forest(["a", "b"], trees=4, depth=depth).fit(folds.filter(f"_fold != {k}").coalesce(1))
            apart.append(model.transform(folds.filter(f"_fold = {k}")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
        assert abs(got - np.mean(apart)) < 0.1
    assert min(found.accuracies) > 0.6 and found.best.stages[-1].getNumTrees in (4, 8, 12)


def test_search_fits_once_for_all_depths(spark, monkeypatch):
    """One fit a fold and block; its trees cut at a depth give the probabilities and accuracy of a fit of that depth."""
    from kinelane.operators import learning

    rng = np.random.default_rng(4)
    y = np.arange(240) % 3
    made = pd.DataFrame({"a": y + rng.normal(0, 0.9, 240), "b": rng.normal(size=240), "label": y, "weight": 1.0 + y / 7})
    rows = spark.createDataFrame(made).coalesce(1).checkpoint()
    deep = forest(["a", "b"], trees=6, depth=12, weight="weight").fit(rows)
    scored = deep.stages[-1].setLeafCol("leaf").transform(deep.stages[0].transform(rows)).toPandas()
    leaves = np.stack([v.toArray() for v in scored["leaf"]]).astype(int)
    shares, places, first = learning.cut_trees(deep, [0, 1, 3, 7, 12])
    for depth in (0, 1, 3, 7, 12):
        votes = sum(shares[places[depth][leaves[:, t] + first[t]]] for t in range(6))
        apart = forest(["a", "b"], trees=6, depth=depth, weight="weight").fit(rows).transform(rows).toPandas()["probability"]
        assert np.allclose(votes / votes.sum(1, keepdims=True), np.stack([v.toArray() for v in apart]), rtol=0, atol=1e-12)

    fits, own = [], learning.forest
    monkeypatch.setattr(learning, "forest", lambda *a, **k: fits.append(k) or own(*a, **k))
    grid = {"numTrees": [3, 6], "maxDepth": [1, 4, 9], "minInstancesPerNode": [1]}
    found = forest_search(rows, ["a", "b"], grid=grid, folds=2)
    assert len(fits) == 2 * 2 + 1
    assert len(set(found.accuracies)) > 2
    folds = rows.withColumn("_fold", F.floor(F.rand(42) * 2).cast("int")).checkpoint()
    for i, depth in enumerate((1, 4, 9)):
        apart = []
        for k in range(2):
            model = own(["a", "b"], trees=3, depth=depth, weight="weight").fit(folds.filter(f"_fold != {k}").coalesce(1))
            apart.append(model.transform(folds.filter(f"_fold = {k}")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert found.accuracies[i] == sum(apart) / 2


def test_forest_in_parts_holds_few_trees_at_a_time(spark, monkeypatch):
    """A small forest is one fit, as ever; a large one is fitted and scored in parts that vote together."""
    from kinelane.operators import learning

    rng = np.random.default_rng(3)
    y = np.arange(400) % 2
    rows = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": y + rng.normal(0, 0.15, 400), "b": rng.normal(size=400), "label": y}))
    rows = rows.checkpoint()
    train, test = rows.filter("id < 300"), rows.filter("id >= 300")
    assert len(learning.forest_parts(train, ["a", "b"], trees=10, depth=5)) == 1
    whole = learning.forest_votes(test, learning.forest_parts(train, ["a", "b"], trees=10, depth=5), 300)
    again = forest(["a", "b"], trees=10, depth=5).fit(train).transform(test)
    assert {(r.id, r.prediction) for r in whole.collect()} == {(r.id, r.prediction) for r in again.collect()}
    monkeypatch.setattr(learning, "WHOLE_ROWS", 100)
    monkeypatch.setattr(learning, "HELD_ROWS", 300 * 8 * 3)
    parts = learning.forest_parts(train, ["a", "b"], trees=10, depth=5)
    sizes = [m.stages[-1].getNumTrees for m in (p() for p in parts)]
    assert sum(sizes) == 10 and max(sizes) <= 3
    voted = learning.forest_votes(test, parts, 300, 10).collect()
    assert sorted(r.id for r in voted) == list(range(300, 400)) and "_row" not in voted[0]
    assert np.mean([r.prediction == r.label for r in voted]) > 0.9


def test_forecast_cuts_its_windows_once(spark, data, monkeypatch):
    """The split and the fit read written pairs; they do not number and cut the events again."""
    from kinelane.queries import learning

    seen, split = [], learning.random_split
    monkeypatch.setattr(learning, "random_split", lambda df, *a, **k: seen.append(df.inputFiles()) or split(df, *a, **k))
    assert learning._forecast(spark, data).first().n > 0
    assert seen[0] and all("pairs-" in f for f in seen[0])


def test_rows_without_a_class_are_kept(spark):
    from kinelane.operators.splits import class_weights, random_split

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, label int")
    split = random_split(df, ["id"], stratify="label")
    assert split.columns == ["id", "label", "part"] and split.count() == 50
    assert split.filter("part = 'test' and label is null").count() == 2
    weights = {r.id: (r.label, r.weight) for r in class_weights(df).collect()}
    assert len(weights) == 50 and all((label is None) == (w == 0) for label, w in weights.values())
