"""The stages one after the other, each against brute force on what the one before it left."""

import numpy as np
import pytest
from helpers import rows
from test_duplicates import _groups, _print, _repeats
from test_learned import _base

import corpus_pipeline as pipeline
from kinelane.llm.common import stored
from kinelane.llm.queries import QUERIES


@pytest.fixture(scope="module")
def kept(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    # A repeated row, a null text and a null id are documents too.
    extra = docs.limit(1).union(spark.createDataFrame([(10**9, None, "en", "s", 0), (None, "x " * 80, "en", "s", 160)], docs.schema))
    docs = stored(docs.union(extra), "documents")
    out.append(docs)
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, data), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(kept):
    assert all(df.columns == kept[0].columns and df.dtypes == kept[0].dtypes for df in kept[1:-1])


def test_quality_stage(spark, data, kept):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in kept[:2])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for i, t in before.items():
        base = _base(t)
        if base[0] < 50 or 100 * base[4] > 50 * base[0]:
            assert i not in after
    judged = [i for i in labels if not (_base(before[i])[0] < 50 or 100 * _base(before[i])[4] > 50 * _base(before[i])[0])]
    assert np.mean([(i in after) == bool(labels[i]) for i in judged]) > 0.9


def test_toxicity_stage(spark, data, kept):
    before, after = ({r.doc_id for r in df.collect()} for df in kept[1:3])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [i for i in before if labels.get(i) == 0]
    assert after < before or after == before
    assert np.mean([i in after for i in clean]) > 0.97


def test_toxicity_stage_learns_from_the_whole_table(spark, tmp_path):
    """Few documents are left and none of them is one to learn from: the toxic ones still go."""
    rng = np.random.default_rng(7)
    plain, vile = [f"{a}{b}{a}" for a in "bcdfgklmnp" for b in ("ora", "eli", "uste", "ami")], ["zvile", "xfoul", "qgrim", "jrot"]
    made = []
    for i in range(600):
        words = rng.choice(plain, 120).tolist()
        if i % 3 == 0:
            words[40:52] = rng.choice(vile, 12).tolist()
        made.append((i, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) as toxic", "1 as quality").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs.filter("crc32(cast(doc_id as string)) % 3 = 1").limit(60)
    want = {r.doc_id for r in left.collect() if r.doc_id % 3}
    got = {r.doc_id for r in pipeline.not_toxic(spark, left, str(tmp_path)).collect()}
    assert 0 < len(want) < 60 and got == want


def test_near_copies_stage(kept):
    before = sorted(kept[2].collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    roots = _groups([_print(r.text) for r in before], 3)
    want = [before[i] for i in sorted(set(roots))]
    assert rows(kept[3], "doc_id", "text") == sorted(((r.doc_id, r.text) for r in want), key=repr)


def test_repeats_stage(kept):
    before = kept[3].collect()
    after = {r.doc_id: r for r in kept[4].collect()}
    assert len(after) == len(before)
    for r, (size, gone, _, _) in zip(before, _repeats([r.text for r in before], 400), strict=True):
        text = after[r.doc_id].text
        assert after[r.doc_id].n_chars == len(text) and (after[r.doc_id].lang, after[r.doc_id].source) == (r.lang, r.source)
        assert (text == r.text) == (gone == 0)
        assert size - gone - 3 * 2 * 8 <= len(text.encode()) <= size - gone


def test_packing_stage(kept):
    packed, docs = kept[5].collect(), kept[4].count()
    assert len({r.doc_id for r in packed}) == docs
    total = {}
    for r in packed:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 1024


def test_run_and_registration(spark, data):
    import __spark_entry__ as driver

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert pipeline.run(spark, data).columns[0] == "doc_id"


CLASHING = "_row _again _turn row key node keys root least text_ component_id".split()


def test_clashing_columns_and_empty_tables(spark, data):
    """Every stage but the last passes other columns through, whatever their names, and takes a table without rows."""
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(120)) for k in (3, 5, 7)] + [None, ""]
    made = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = made.union(made.limit(2)).withColumns({c: made["doc_id"] * 10 + i for i, c in enumerate(CLASHING)})
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        none = stage(spark, docs.limit(0), data)
        assert none.count() == 0 and none.columns == out.columns
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            for r in out.collect():
                assert [r[c] for c in CLASHING] == [r["doc_id"] * 10 + i for i in range(len(CLASHING))]
