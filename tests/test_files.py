import pytest
from pyspark.sql import functions as F

from kinelane.operators.augment import variants
from kinelane.plans.pipelines import documents_to_recordings
from kinelane.schema import AXES, PROFILES
from kinelane.sources.recordings import scan_recordings, scan_written
from kinelane.sources.sinks import write_history, write_record, write_recordings, write_variants

HEADER = ",".join(PROFILES["P8_RAW"])


@pytest.fixture()
def folder(tmp_path):
    def rows(count, start=0):
        return "\n".join(f"{1000 + i // 2},{start + i}.5,1,2,{1001 + i // 2},3,4,-{i}.25" for i in range(count))

    (tmp_path / "flexion_cuello_2rep_0.csv").write_text(HEADER + "\n" + rows(250) + "\n")
    (tmp_path / "idle_cuello_5.csv").write_text(HEADER + "\r\n" + rows(30, 7).replace("\n", "\r\n") + "\r\n")
    (tmp_path / "empty.csv").write_text(HEADER + "\n")
    (tmp_path / "header.csv").write_text(HEADER.replace("acc_x", "ax") + "\n" + rows(3))
    (tmp_path / "short_row.csv").write_text(HEADER + "\n" + rows(3) + "\n1,2,3\n")
    (tmp_path / "text.csv").write_text(HEADER + "\n" + rows(2).replace("0.5", "abc", 1) + "\n")
    (tmp_path / "notes.txt").write_text("not a recording")
    return str(tmp_path)


@pytest.mark.parametrize("large", [False, True])
def test_scan(spark, folder, large):
    if large:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        scan = scan_recordings(spark, folder, large_files=large)
        rows = scan.recordings.orderBy("series_id", "seq").collect()
        rejects = {r.series_id: r.reason for r in scan.rejects.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rejects == {
        "empty": "no rows", "header": "wrong header", "short_row": "wrong number of columns", "text": "value is not a number"
    }
    flexion = [r for r in rows if r.series_id == "flexion_cuello_2rep_0"]
    assert [r.seq for r in flexion] == list(range(250)) and [r.acc_x for r in flexion] == [i + 0.5 for i in range(250)]
    assert {r.n for r in flexion} == {250}
    assert [r.acc_x for r in rows if r.series_id == "idle_cuello_5"] == [i + 7.5 for i in range(30)]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,t,ax,ay,az,gx,gy,gz,l\n0,1.5,1,2,3,4,5,6,1\n1,2.5,1,2,3,4,5,6,0\n")
    scan = scan_recordings(spark, str(tmp_path), "P9_LABEL", check_header=False)
    assert scan.recordings.columns == ["series_id", "seq", "n", "timestamp", *AXES, "label"]
    assert [r.label for r in scan.recordings.orderBy("seq").collect()] == [1, 0]
    assert scan_recordings(spark, str(tmp_path), "P8_RAW", check_header=False).rejects.count() == 1


def test_written_recordings_come_back_in_order(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out")) + "/x"
    rows = scan_recordings(spark, folder).recordings.withColumn("series_id", F.concat(F.lit("Flexión "), "series_id"))
    write_recordings(rows, out, rows_per_file=64)
    back = scan_written(spark, out, PROFILES["P8_RAW"])
    want = {(r.series_id.replace("ó", "o"), r.seq): (r.n, r.acc_x, r.timestamp_gyro) for r in rows.collect()}
    assert {(r.series_id, r.seq): (r.n, r.acc_x, r.timestamp_gyro) for r in back.collect()} == want


def test_variants_have_prefixed_names(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("var")) + "/x"
    made = variants(scan_recordings(spark, folder).recordings)
    counts = {(r.variant, r.series_id): r["count"] for r in made.groupBy("variant", "series_id").count().collect()}
    assert counts[("interpolated", "idle_cuello_5")] == 60 and counts[("noisy", "idle_cuello_5")] == 30
    write_variants(made, out)
    names = {r.series_id for r in scan_written(spark, out, PROFILES["P8_RAW"]).select("series_id").distinct().collect()}
    assert names == {f"{v}_{s}" for v, s in counts}


def test_documents(spark, tmp_path):
    line = "timestamp_acc=1,acc_x=1,5,acc_y=0,5,acc_z=-0,75;timestamp_gyro=2,gyro_x=1,5,gyro_y=2,5,gyro_z=3,5"
    (tmp_path / "Flexión_1.txt").write_text(f"\n{line}\nbroken\n{line}\n")
    good, bad = documents_to_recordings(spark, str(tmp_path))
    assert [(r.series_id, r.seq, r.acc_x) for r in good.orderBy("seq").collect()] == [("Flexión_1", 0, 1.5), ("Flexión_1", 1, 1.5)]
    assert {(r.name, r.n, r.line_no) for r in good.collect()} == {("Flexion_1", 2, 0), ("Flexion_1", 2, 2)}
    assert [(r.line_no, r.line) for r in bad.collect()] == [(1, "broken")]


def test_small_sinks(spark, tmp_path):
    write_record(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "one"))
    assert spark.read.csv(str(tmp_path / "one"), header=True).collect()[0].asDict() == {"a": "1", "b": "2.5"}
    write_history(spark.createDataFrame([(0, 1.0)], "iteration int, loss double"), {"epochs": 3}, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h" / "params")).first().epochs == "3"


def test_names_that_meet(spark, tmp_path, tmp_path_factory):
    """Same names in several folders, names that differ by accents, blank files, holes between good lines."""
    from kinelane.operators.lanes import short_series
    from kinelane.sources.recordings import read_documents

    rows = "\n".join(f"{i},{i}.5,1,2,{i},3,4,5" for i in range(4))
    for name in ("a/one.csv", "b/one.csv"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(HEADER + "\n" + rows)
    (tmp_path / "a" / "zero.csv").write_text("")
    (tmp_path / "a" / "blank.csv").write_text("\n \n")
    scan = scan_recordings(spark, str(tmp_path / "*"))
    assert scan.recordings.select("series_id").distinct().count() == 2
    assert {r.series_id.split("/")[-1]: r.reason for r in scan.rejects.collect()} == {"zero": "no rows", "blank": "no rows"}
    own = scan_recordings(spark, str(tmp_path / "a"))
    assert {r.series_id for r in own.recordings.collect()} == {"one"}
    assert [(r.series_id, r.n) for r in short_series(own.recordings, 5).collect()] == [("one", 4)]
    docs = tmp_path_factory.mktemp("docs")
    (docs / "Flexión_1.txt").write_text("x")
    (docs / "Flexion_1.txt").write_text("y")
    assert {r.doc_id for r in read_documents(spark, str(docs)).collect()} == {"Flexión_1", "Flexion_1"}
    out = str(tmp_path_factory.mktemp("out")) + "/x"
    both = own.recordings.withColumn("series_id", F.explode(F.array(F.lit("Flexión"), F.lit("Flexion"), F.lit("Única"))))
    write_recordings(both, out)
    assert {r.series_id for r in scan_written(spark, out, PROFILES["P8_RAW"]).collect()} == {"Flexión", "Flexion", "Unica"}


def test_long_files_are_read_in_splits(spark, folder, tmp_path, monkeypatch):
    """A scan of files of all sizes gives the same rows and rejects when the long ones are no single values."""
    from kinelane.sources import recordings

    whole = scan_recordings(spark, folder)
    want, wrong = sorted(whole.recordings.collect()), sorted(whole.rejects.collect())
    (tmp_path / "more.csv").write_text(HEADER + "\r\n\r\n" + "1,2,3,4,5,6,7,8\r\n" * 200)
    more = [r for r in scan_recordings(spark, folder).recordings.collect() if r.series_id == "more"]
    assert len(more) == 200
    split = []
    lines = recordings._lines_of_large_files
    monkeypatch.setattr(recordings, "_lines_of_large_files", lambda *a: split.append(lines(*a)) or split[-1])
    monkeypatch.setattr(recordings, "WHOLE_BYTES", 1200)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        scan = scan_recordings(spark, folder)
        assert sorted(scan.recordings.collect()) == sorted([*want, *more]) and sorted(scan.rejects.collect()) == wrong
        assert {r.series_id for r in split[0].select("series_id").distinct().collect()} == {"flexion_cuello_2rep_0", "more"}
        small = recordings._lines_of_small_files(spark, folder, "*.csv", 1200)
        assert "file_size" in small._jdf.queryExecution().executedPlan().toString().split("DataFilters: ")[1].split("]")[0]
        monkeypatch.setattr(recordings, "WHOLE_BYTES", 1)
        scan = scan_recordings(spark, folder)
        assert sorted(scan.recordings.collect()) == sorted([*want, *more]) and sorted(scan.rejects.collect()) == wrong
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
