import numpy as np
from pyspark.sql import functions as F

from kinelane.functions.text import RULE_A, RULE_B, RULE_C, RULE_D, label, repetitions, strip_accents
from kinelane.operators.parsing import explode_lines, parse_strict, parse_tolerant, parse_whole

GOOD = (
    "timestamp_acc=1735486798649,acc_x=1,25,acc_y=0,5,acc_z=-0,75;"
    "timestamp_gyro=1735486798654,gyro_x=28,5,gyro_y=-99,25,gyro_z=83,125"
)
CASES = {
    "good": GOOD,
    "no_separator": "acc_x=1,2",
    "two_separators": GOOD + ";",
    "two_equals": GOOD.replace("acc_x=1", "acc_x==1"),
    "two_fractions": GOOD.replace("acc_x=1,25", "acc_x=1,25,3"),
    "bad_fraction": GOOD.replace("acc_x=1,25", "acc_x=1,ab"),
    "missing": GOOD.replace("acc_y=0,5,", ""),
    "whole": GOOD.replace("acc_x=1,25", "acc_x=7"),
    "negative": GOOD.replace("acc_x=1,25", "acc_x=-0,75"),
    "fragment_first": "zz," + GOOD,
    "repeated_key": GOOD.replace("acc_x=1,25", "acc_x=9,5,acc_x=1,25"),
    "old": "acc_x=1,acc_y=2,acc_z=3;gyro_x=4,gyro_y=5,gyro_z=6",
    "empty": "",
}


def _lines(spark):
    rows = [(name, i, line) for i, (name, line) in enumerate(CASES.items())]
    return spark.createDataFrame(rows, "series_id string, seq long, line string")


def test_tolerant(spark):
    good, bad = parse_tolerant(_lines(spark))
    rows = {r.series_id: r for r in good.collect()}
    reasons = {r.series_id: r.reason for r in bad.collect()}
    assert set(rows) | set(reasons) == set(CASES) and not set(rows) & set(reasons)
    assert set(reasons) == {"no_separator", "two_separators", "two_equals", "two_fractions", "bad_fraction", "empty"}
    g = rows["good"]
    assert (g.timestamp_acc, g.acc_x, g.acc_y, g.acc_z) == (1735486798649, 1.25, 0.5, -0.75)
    assert (g.timestamp_gyro, g.gyro_x, g.gyro_y, g.gyro_z) == (1735486798654, 28.5, -99.25, 83.125)
    assert rows["missing"].acc_y is None and rows["missing"].acc_z == -0.75
    assert rows["whole"].acc_x == 7.0 and rows["negative"].acc_x == -0.75
    assert rows["fragment_first"].acc_x == 1.25 and rows["repeated_key"].acc_x == 1.25
    assert rows["old"].gyro_z == 6.0 and rows["old"].timestamp_acc is None


def test_strict(spark):
    good, bad = parse_strict(_lines(spark))
    rows = {r.series_id: r for r in good.collect()}
    assert set(rows) == {"good", "negative"}
    assert rows["good"].gyro_y == -99.25 and rows["negative"].acc_x == -0.75
    assert bad.count() == len(CASES) - 2


def test_whole(spark):
    rows = parse_whole(_lines(spark)).collect()
    assert [(r.series_id, r.acc_x, r.gyro_z) for r in rows] == [("old", 1.0, 6.0)]


def test_document_lines_keep_order_and_missing_content(spark):
    docs = spark.createDataFrame([("a", "  one\ntwo\n\nthree \n"), ("b", None)], "doc_id string, content string")
    rows = [(r.series_id, r.seq, r.line) for r in explode_lines(docs).orderBy("series_id", "seq").collect()]
    assert rows == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, "three"), ("b", 0, "")]


def test_names(spark):
    names = {
        "flexion_cuello_4rep_3": (0, 0, "Flexion", 0, 4),
        "extension_cuello_10rep_3": (1, 1, "Extension", 1, 10),
        "flex_bajo_cuello_1rep0": (None, None, None, 0, None),
        "ext_subo_cuello_1rep_9": (None, None, None, 1, 1),
        "idle_cuello_12": (None, None, "Idle", 2, None),
        "gir_flex_izqda_1rep_0": (None, None, None, 3, 1),
    }
    n = F.col("name")
    df = spark.createDataFrame([(k,) for k in names], "name string").select(
        n, label(n, RULE_A, prefix=True, lower=False).alias("a"), label(n, RULE_B).alias("b"),
        label(n, RULE_C).alias("c"), label(n, RULE_D).alias("d"), repetitions(n).alias("r"),
    )
    assert {r.name: tuple(r[1:]) for r in df.collect()} == names


def test_accents(spark):
    df = spark.createDataFrame([("Flexión ÀÉÎõü ñ Ç é",), (None,)], "t string")
    for exact in (False, True):
        got = [r[0] for r in df.select(strip_accents(F.col("t"), exact)).collect()]
        assert got == ["Flexion AEIou n C e", None]


def test_accents_of_any_script_by_slices(spark, monkeypatch):
    """Slices of a few bytes, nulls, empty and long texts: the same as Python's own decomposition of each text."""
    import unicodedata

    from kinelane.functions import text

    monkeypatch.setattr(text, "SLICE_BYTES", 40)
    texts = ["", None, "plain", "Ελλάδα ό", "한국어 각", "ﬁn ﬀ ½", "é" * 500, "a\u0301\u0323b", "日本ガ", "𝒜é𐐀", None, "x" * 300, "ñ"] * 7
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = dict(df.select("i", strip_accents(F.col("t"), True)).collect())
    want = [t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert df.limit(0).select(strip_accents(F.col("t"), True)).count() == 0


def _squares(line):
    """Twelve lines of x = i * i; the fourth is broken."""
    return ["broken" if i == 3 else line(i * i) for i in range(12)]


def test_every_parser_gives_dense_positions(spark):
    """A filter sees neighbours, not the hole that a rejected line leaves."""
    from kinelane.operators.parsing import LINE_NO, parse_strict, parse_tolerant, parse_whole
    from kinelane.operators.savgol import savgol

    full = "timestamp_acc=1,acc_x={0},0,acc_y=0,0,acc_z=0,0;timestamp_gyro=2,gyro_x=0,0,gyro_y=0,0,gyro_z=0,0"
    old = "acc_x={0},acc_y=0,acc_z=0;gyro_x=0,gyro_y=0,gyro_z=0"
    for parse, form in ((lambda d: parse_tolerant(d)[0], full), (lambda d: parse_strict(d)[0], full), (parse_whole, old)):
        lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(_squares(form.format))], "series_id string, seq long, line string")
        rows = {r["seq"]: r for r in savgol(parse(lines), ["acc_x"], 5).collect()}
        kept = [i for i in range(12) if i != 3]
        assert [rows[k][LINE_NO] for k in range(11)] == kept and {r["n"] for r in rows.values()} == {11}
        x = [i * i for i in kept]
        want = [np.polyval(np.polyfit(range(s, s + 5), x[s : s + 5], 2), k) for k in range(11) for s in [min(max(k - 2, 0), 6)]]
        assert np.allclose([rows[k]["acc_x_smooth"] for k in range(11)], want)
