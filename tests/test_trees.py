"""Trees grown by tasks, against brute force and against Spark's forests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelane.operators import learning, trees


def _brute(x, y, w, counts, cuts, depth, least):
    """The tree on one feature as nested tuples: (cut, left, right), or the class weights of a leaf."""
    own = np.bincount(y, w * counts, 2)
    if depth == 0 or own.min() == 0:
        return tuple(own)
    best, at = 1e-12, None
    for cut in range(cuts):
        go = x <= cut
        if min(counts[go].sum(), counts[~go].sum()) < least:
            continue
        parts = [np.bincount(y[g], (w * counts)[g], 2) for g in (go, ~go)]
        gain = sum((p**2).sum() / p.sum() for p in parts) / own.sum() - (own**2).sum() / own.sum() ** 2
        if gain > best + 1e-13:
            best, at = gain, cut
    if at is None:
        return tuple(own)
    return (at, *[_brute(x[g], y[g], w[g], counts[g], cuts, depth - 1, least) for g in (x <= at, x > at)])


def _nested(tree, node=0):
    if tree.left[node] < 0:
        return tuple(tree.weights[node])
    return (int(tree.cut[node]), _nested(tree, tree.left[node]), _nested(tree, tree.left[node] + 1))


def _flat(nested):
    return [v for part in nested for v in (_flat(part) if isinstance(part, tuple) else [part])]


@pytest.mark.parametrize("depth, least, weighted", [(3, 1, False), (30, 1, True), (30, 4, True), (30, 2, False)])
def test_a_tree_splits_as_brute_force(monkeypatch, depth, least, weighted):
    monkeypatch.setattr(trees, "NODES", 3)
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, trees.BINS, 500), rng.integers(0, 2, 500)
    w = np.where(y == 1, 1.7, 0.6) if weighted else np.ones(500)
    tree = trees.grow(x[:, None].astype(np.uint8), y.astype(np.uint8), w if weighted else None, 2, depth, least, [1, 2])
    counts = np.random.default_rng([1, 2]).poisson(1.0, 500)
    assert np.allclose(_flat(_nested(tree)), _flat(_brute(x, y, w, counts, trees.BINS - 1, depth, least)))
    leaves = trees.reached(tree, x[:, None].astype(np.uint8))
    assert (tree.left[leaves] < 0).all() and np.allclose(np.bincount(leaves, counts, len(tree.left))[tree.left < 0], tree.rows[tree.left < 0])


def _rows(spark, n=900):
    rng = np.random.default_rng(3)
    y = np.arange(n) % 3
    made = pd.DataFrame({"id": range(n), "a": y + rng.normal(0, 0.8, n), "b": rng.normal(size=n), "c": rng.integers(0, 5, n) + 0.5 * y, "label": y, "weight": 1.0 + y / 7})
    return spark.createDataFrame(made).repartition(3).checkpoint()


def _accuracy(scored):
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_grown_forests_are_stored_as_spark_reads_them(spark, monkeypatch, tmp_path):
    """Votes of the tasks, of parts loaded one by one and of the whole stored model agree; Spark's own forest is as good."""
    from kinelane.sources.sinks import load_model, save_model

    rows, names = _rows(spark), ["a", "b", "c"]
    train, test = rows.filter("id < 700"), rows.filter("id >= 700")
    plain = learning.forest(names, trees=20, depth=9, weight="weight").fit(train)
    monkeypatch.setattr(learning, "WHOLE_ROWS", 100)
    monkeypatch.setattr(learning, "FITS", 3)
    parts = learning.forest_parts(train, names, trees=20, depth=9, weight="weight")
    assert len(parts) == 3 and all(isinstance(p, learning.GrownPart) for p in parts)
    saved = [str(tmp_path / str(i)) for i in range(3)]
    learning.store_parts(spark, 700, parts, lambda turn, model: save_model(model, saved[turn]), 20)
    loaded = [load_model(path) for path in saved]
    whole = learning.GrownPart(parts[0].grown, 0, 20)()
    assert whole.stages[-1].getNumTrees == 20 and whole.stages[-1].getMaxDepth() == 9 == max(t.depth for t in whole.stages[-1].trees)
    assert sum(m.stages[-1].totalNumNodes for m in loaded) == whole.stages[-1].totalNumNodes
    assert abs(whole.stages[-1].totalNumNodes / plain.stages[-1].totalNumNodes - 1) < 0.15
    votes = learning.forest_votes(test, parts, 700, 20)
    got = {r.id: r.prediction for r in votes.collect()}
    assert len(got) == 200 and "_row" not in votes.columns
    for again in (whole.transform(test), learning.forest_votes(test, [lambda m=m: m for m in loaded], 700, 20)):
        assert {r.id: r.prediction for r in again.collect()} == got
    assert abs(_accuracy(votes) - _accuracy(plain.transform(test))) < 0.08
    with pytest.raises(Exception, match="null or NaN"):
        learning.forest_votes(test.withColumn("b", F.when(F.col("id") != 800, F.col("b"))), parts, 700, 20).count()


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    rows = spark.range(5000).select((F.col("id") % 4).alias("few"), (F.col("id") / 5000).alias("many"), F.lit(2.0).alias("one"))
    few, many, one = trees.candidate_cuts(rows.repartition(4), ["few", "many", "one"])
    assert few.tolist() == [0.5, 1.5, 2.5] and len(one) == 0
    assert len(many) == trees.BINS - 1 and np.allclose(many, np.arange(1, trees.BINS) / trees.BINS, atol=0.001)


def test_a_large_search_grows_its_trees_in_tasks(spark, monkeypatch):
    """Spark fits one stump and no forest; accuracies are those of forests fitted apart, the best one is on all rows."""
    rows, fits, own = _rows(spark), [], learning.forest
    monkeypatch.setattr(learning, "WHOLE_ROWS", 100)
    monkeypatch.setattr(learning, "forest", lambda *a, **k: fits.append(a) or own(*a, **k))
    grid = {"numTrees": [10, 20], "maxDepth": [2, 12], "minInstancesPerNode": [1, 30]}
    found = learning.forest_search(rows, ["a", "b", "c"], grid=grid, folds=3)
    assert [a[2:4] for a in fits] == [(1, 0)]
    folds = rows.withColumn("_fold", F.floor(F.rand(42) * 3).cast("int")).checkpoint()
    for c, got in zip(found.candidates, found.accuracies, strict=True):
        model = own(["a", "b", "c"], trees=c["numTrees"], depth=c["maxDepth"], weight="weight")
        model.getStages()[1].setMinInstancesPerNode(c["minInstancesPerNode"])
        assert abs(got - _accuracy(model.fit(folds.filter("_fold != 0")).transform(folds.filter("_fold = 0")))) < 0.12
    best = found.candidates[int(np.argmax(found.accuracies))]
    forest = found.best.stages[-1]
    assert (forest.getNumTrees, forest.getMaxDepth(), forest.getMinInstancesPerNode()) == tuple(best.values())
    assert _least_rows(spark, forest) >= best["minInstancesPerNode"]
    assert _accuracy(found.best.transform(rows)) >= max(found.accuracies)


def _least_rows(spark, forest):
    from kinelane.session import work_path

    path = work_path(spark, "seen")
    forest.write().save(path)
    return spark.read.parquet(f"{path}/data").agg(F.min("nodeData.rawCount")).first()[0]


def test_segments_are_cut_once(spark, data):
    from kinelane.queries.learning import _segments

    made, names = _segments(spark, data)
    assert made.select(*names).inputFiles() == []


def test_storing_a_grown_forest_loads_no_part(spark, data, monkeypatch):
    from kinelane.queries import files

    monkeypatch.setattr(learning, "WHOLE_ROWS", 100)
    monkeypatch.setattr(learning, "FITS", 2)
    monkeypatch.setattr(learning.GrownPart, "__call__", None)
    kinds, save = [], files.save_model
    monkeypatch.setattr(files, "save_model", lambda model, path: kinds.append(type(model)) or save(model, path))
    assert sum(r.votes for r in files._stored_forest(spark, data).collect()) > 0
    assert kinds == [learning.GrownPart] * 2


def test_a_grown_forest_votes_without_a_model(spark, data, monkeypatch):
    from kinelane.queries import learning as queries

    monkeypatch.setattr(learning, "WHOLE_ROWS", 100)
    monkeypatch.setattr(learning, "forest", None)
    got = {r.name: r for r in queries._forest_rows(spark, data).collect()}
    assert got["accuracy"].support == got["weighted avg"].support > 0
