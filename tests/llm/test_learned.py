"""Quality rules, toxicity and neighbours: base counts and scans by brute force, learnt parts on held-out rows."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, prose, rows
from pyspark.sql import functions as F

from kinelane.llm import neighbours, toxicity
from kinelane.llm.boosting import fit
from kinelane.llm.neighbours import graph_search, nearest, neighbour_graph
from kinelane.llm.quality import COUNTS, SHARES, keep_good, quality_rules, statistics, train
from kinelane.llm.queries import QUERIES


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def _labelled(spark, texts, labels, name):
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels) if v is not None], f"doc_id long, {name} int")


def test_base_statistics():
    texts = [*ODD, "a b c a b c", "a a a a", "# * | <x>\n# * | <x>\n\n \nb", "l\nl\r\nl\r\nl", prose(1, 400)]
    for t in texts:
        assert tuple(statistics(t or "")[: len(COUNTS)]) == _base(t)


def test_quality(spark):
    good = [prose(i, 90) for i in range(60)]
    bad = [" | ".join(prose(i + 100, 90).split()) for i in range(30)]
    texts = [*good, *bad, *ODD, "w " * 200, "w x y z " * 60]
    labels = [*[1] * 40, *[None] * 20, *[0] * 20, *[None] * 10, *[None] * (len(ODD) + 2)]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in quality_rules(docs, _labelled(spark, texts, labels, "quality")).collect()}
    for i, t in enumerate(texts):
        base = _base(t)
        assert tuple(got[i][c] for c in COUNTS) == base
        assert got[i].base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 90))
    trees = train(docs.select("doc_id", "text"), _labelled(spark, texts, labels, "quality"))
    kept = keep_good(docs, trees)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted(((i,) for i in got if got[i].kept), key=repr)


def test_quality_without_labels_and_rows(spark):
    docs = documents(spark, [prose(1, 80), None], [None, None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.kept for r in quality_rules(docs, none).collect()) == [False, True]
    assert quality_rules(docs.limit(0), none).count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] - x[:, 1] + np.sin(5 * x[:, 0]) + rng.normal(size=600) > 0).astype(float)
    trees = fit(x, y, {0: 1, 1: -1}, trees=30, depth=4)
    grid = np.linspace(-3, 3, 60)
    for row in x[:20]:
        for f, way in ((0, 1), (1, -1)):
            line = np.repeat(row[None], 60, 0)
            line[:, f] = grid
            assert (way * np.diff(trees.score(line)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    by_hand = np.full(len(x), trees.base)
    for root in trees.roots:  # row by row, without the vectorised walk
        for i, row in enumerate(x):
            at = root
            while trees.feature[at] >= 0:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            by_hand[i] += trees.value[at]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-by_hand)))
    assert len(SHARES) == len(statistics("")) - len(COUNTS)


def _maximal(scores):
    """All maximal scoring segments by recursion: the best segment, then left and right of it."""
    best, found = 0.0, None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[a:b])
        if total > best + 1e-12 or (found and abs(total - best) < 1e-12 and b - a < found[1] - found[0]):
            best, found = total, (a, b)
    if not found:
        return []
    a, b = found
    return [*_maximal(scores[:a]), (a, b, best), *[(x + b, y + b, s) for x, y, s in _maximal(scores[b:])]]


def test_segments():
    rng = np.random.default_rng(4)
    for _ in range(150):
        scores = rng.normal(-0.3, 1, int(rng.integers(0, 16))).round(3)
        got, want = toxicity.segments(scores), _maximal(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])
    assert toxicity.segments(np.array([])) == []


def test_tokens_in_segments(monkeypatch):
    text = prose(3, 200) + " Ünïcode, x1-y2 "
    whole = toxicity.tokens(text)
    monkeypatch.setattr(toxicity, "SEGMENT", 40)
    assert (toxicity.tokens(text) == whole).all()
    assert whole.shape[1] == len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))


def test_toxicity(spark, data):
    found = toxicity.toxicity
    clean = [prose(i, 120) for i in range(300)]
    words = "vile nasty horrid awful".split()
    toxic = []
    for i in range(120):
        own = prose(i + 1000, 120).split()
        for k in range(4):
            own.insert(20 + 9 * k, words[(i + k) % 4])
        toxic.append(" ".join(own))
    texts = [*clean, *toxic, None, ""]
    labels = [*[0] * 300, *[1] * 120, None, None]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in found(docs, _labelled(spark, texts, labels, "toxic")).collect()}
    for i in range(len(texts)):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    held = [i for i in range(420) if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert got[420].score == got[421].score < 0.5
    own = texts[310].lower()
    tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+", own)
    assert any(set(words) & set(tokens[p.begin : p.end]) for p in got[310].passages)


def test_toxicity_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark, [prose(1, 60), None], [None, 2])
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_scores_use_no_held_out_label(spark):
    texts = [prose(i, 60) + (" vile" if i % 2 else "") for i in range(80)]
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(80)]
    one = _labelled(spark, texts, [i % 2 for i in range(80)], "toxic")
    other = _labelled(spark, texts, [(1 - i % 2) if held[i] else i % 2 for i in range(80)], "toxic")
    assert rows(toxicity.toxicity(docs, one), "doc_id", "score") == rows(toxicity.toxicity(docs, other), "doc_id", "score")


def _nearest(vectors, query, k):
    a = np.array(vectors[query], float)
    found = sorted((float(np.sqrt(((a - np.array(v, float)) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return [(query, n + 1, i, d) for n, (d, i) in enumerate(found[:k])]


def test_nearest_small_tables_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(22)}
    vectors |= {40 + i: vectors[3] for i in range(15)}  # one common vector
    odd = [(90, None), (91, [0.0] * 5), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("inf")] * 5), (95, [1.0]), (96, []), (None, [1.0] * 5), (3, vectors[3])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("node", "rank", "d", "query_id")})
    got = rows(nearest(df, F.col("vec_id") % 10 == 0, k=10), "query_id", "rank", "vec_id", "score")
    want = [r for q in vectors if q % 10 == 0 for r in _nearest(vectors, q, 10)]
    assert [r[:3] for r in got] == sorted([r[:3] for r in want], key=repr)
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want, key=repr)], rtol=0, atol=1e-12)
    assert nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = df.filter("vec_id in (10, 11, 12)")
    assert [r[:3] for r in rows(nearest(few, F.col("vec_id") == 10), "query_id", "rank", "vec_id")] == [r[:3] for r in _nearest({k: vectors[k] for k in (10, 11, 12)}, 10, 10)]


def test_nearest_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 32))
    vectors = {i: (centers[i % 20] + 0.6 * rng.normal(size=32)).astype(np.float32).tolist() for i in range(2500)}
    df = spark.createDataFrame(list(vectors.items()), table.select("vec_id", "embedding").schema)
    got = nearest(df, F.col("vec_id") % 100 == 0).collect()
    hits = {(r.query_id, r.vec_id) for r in got}
    want = [r for q in range(0, 2500, 100) for r in _nearest(vectors, q, 10)]
    assert len(got) == len(want)
    assert np.mean([(q, v) in hits for q, _, v, _ in want]) >= 0.9


def test_nearest_among_near_copies(spark):
    """One group of 300 copies that differ beyond half precision, and one vector far greater than all others."""
    rng = np.random.default_rng(12)
    center = rng.normal(size=64)
    center /= np.linalg.norm(center)
    vectors = {i: (center + 3e-5 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(300)}
    vectors |= {300 + i: (rng.normal(size=64) / 8).astype(np.float32).tolist() for i in range(100)}
    for table in (vectors, vectors | {1000: [1e7] * 64}):
        df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<float>")
        got = rows(nearest(df, F.col("vec_id") % 50 == 7, k=10), "query_id", "rank", "vec_id", "score")
        want = sorted((r for q in table if q % 50 == 7 for r in _nearest(table, q, 10)), key=repr)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_graph_keeps_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8)).astype(np.float16)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, packed binary")
    edges = neighbour_graph(nodes, degree=5)
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(30) for j in np.argsort(d[i])[:5]}
    assert {(r.u, r.v) for r in edges.collect()} == want
    asked = nodes.filter("node = 4").select(F.lit(77).cast("long").alias("query_id"), "packed", F.lit(4).cast("long").alias("start"))
    seen = [r.node for r in graph_search(edges, nodes, asked, beam=10).collect()]
    assert len(seen) == len(set(seen)) and set(np.argsort(d[4])[:3]) <= set(seen)


def test_graph_around_hubs_in_small_parts(spark, monkeypatch):
    """Every vector lies round one of two hubs, so that a hub has hundreds of neighbours; parts of 16 and blocks of 64 still find the nearest."""
    rng = np.random.default_rng(8)
    centers = 3 * rng.normal(size=(2, 24))
    around = rng.normal(size=(600, 24))
    x = np.concatenate([centers, centers[np.arange(600) % 2] + 2 * around / np.linalg.norm(around, axis=1)[:, None]])
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, packed binary")
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    edges = {(r.u, r.v) for r in neighbour_graph(nodes, degree=10, kind=np.float64, chunk=16).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:10]}
    assert sum(v < 2 for _, v in edges) > 550
    assert len(edges & want) > 0.95 * len(want)


@pytest.mark.parametrize("name", ["op7_quality_rules", "op6_toxicity"])
def test_driver_tables(spark, data, name):
    got = {r.doc_id: r for r in QUERIES[name](spark, data).collect()}
    column = "quality" if "quality" in name else "toxic"
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    if column == "quality":
        judged = [r for r in labels if not got[r.doc_id].base_failed]
        assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in judged]) > 0.9
    else:
        assert np.mean([got[r.doc_id].predicted == r.toxic for r in labels]) > 0.85


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    """Of ten thousand labels, two hundred are of this table: all of them are in a sample of that size."""
    import zlib

    from pyspark.sql import functions as F

    from kinelane.llm.toxicity import _train_ids

    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    docs = spark.range(4_000, 4_200).select(F.col("id").alias("doc_id"))
    held = sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(4_000, 4_200))
    assert _train_ids(docs, labels, 200).count() == 200 - held
