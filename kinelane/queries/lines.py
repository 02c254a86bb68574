"""Parsing, text and naming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelane.functions.text import RULE_A, RULE_B, RULE_C, RULE_D, class_name, fixed4, label, repetitions, strip_accents
from kinelane.operators.frames import moving_average
from kinelane.operators.parsing import LINE_NO, explode_lines, parse_strict, parse_tolerant, parse_whole
from kinelane.plans.pipelines import lines_to_recordings
from kinelane.queries import Query
from kinelane.queries.common import cents, r, rounded
from kinelane.schema import AXES, LENGTH, SEQ, SERIES
from kinelane.sources.recordings import epoch_us, table

# One event in seven each: two ';', an item with two '=', two fractions, a missing axis, no fraction.
SHAPES = """CASE event_id % 7 WHEN 0 THEN 'two_parts' WHEN 1 THEN 'two_equals' WHEN 2 THEN 'two_fractions'
  WHEN 3 THEN 'missing' WHEN 4 THEN 'whole' ELSE 'good' END"""


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written in the raw line format: ``value`` on x, its negative on y, half a unit on z."""
    c = cents()
    whole, part = F.floor(c / 100).cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    ms = F.floor(epoch_us("ts") / 1000)
    x = (
        F.when(F.col("event_id") % 7 == 1, F.concat(F.lit("acc_x=="), whole, F.lit(","), part))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("acc_x="), whole, F.lit(","), part, F.lit(",7")))
        .when(F.col("event_id") % 7 == 4, F.concat(F.lit("acc_x="), whole))
        .otherwise(F.concat(F.lit("acc_x="), whole, F.lit(","), part))
    )
    y = F.when(F.col("event_id") % 7 == 3, "").otherwise(F.concat(F.lit("acc_y=-"), whole, F.lit(","), part, F.lit(",")))
    tail = F.when(F.col("event_id") % 7 == 0, ";").otherwise("")
    line = F.concat(
        F.lit("timestamp_acc="), ms.cast("string"), F.lit(","), x, F.lit(","), y, F.lit("acc_z=0,5000"),
        F.lit(";timestamp_gyro="), (ms + 5).cast("string"),
        F.lit(",gyro_x="), whole, F.lit(",25,gyro_y=-"), whole, F.lit(","), part, F.lit(",gyro_z=-0,75"), tail,
    )
    # A generated column is written once; a plain one would be rendered again in every filter on it.
    rendered = F.explode(F.array(line)).alias("line")
    return table(spark, folder, "events").select(F.col("event_type").alias(SERIES), F.col("event_id").alias(SEQ), rendered)


def _parsed_sql(where: str, tolerant: bool) -> str:
    x = "CASE WHEN shape = 'whole' THEN CAST(w AS DOUBLE) ELSE c / 100.0 END" if tolerant else "c / 100.0"
    y = "CASE WHEN shape = 'missing' THEN NULL ELSE -(c / 100.0) END" if tolerant else "-(c / 100.0)"
    return f"""
WITH e AS (
  SELECT event_type AS series_id, event_id AS seq, {SHAPES} AS shape,
         CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms,
         CAST(round(value * 100) AS BIGINT) AS c, CAST(floor(round(value * 100) / 100) AS BIGINT) AS w
  FROM events)
SELECT series_id, seq AS line_no, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS seq,
       count(*) OVER (PARTITION BY series_id) AS n, ms AS timestamp_acc, CAST({r(x)} AS DOUBLE) AS acc_x, {r(y)} AS acc_y,
       CAST(0.5 AS DOUBLE) AS acc_z, ms + 5 AS timestamp_gyro, CAST(w + 0.25 AS DOUBLE) AS gyro_x,
       CAST({r('-(c / 100.0)')} AS DOUBLE) AS gyro_y, CAST(-0.75 AS DOUBLE) AS gyro_z
FROM e WHERE shape IN ({where})"""


def _parsed(df: DataFrame) -> DataFrame:
    made = [F.round(F.col(a), 6).alias(a) for a in AXES]
    return df.select(SERIES, LINE_NO, SEQ, LENGTH, "timestamp_acc", *made[:3], "timestamp_gyro", *made[3:])


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with rejects among them to recordings with dense positions, smoothed over five samples."""
    good, _ = lines_to_recordings(raw_lines(spark, folder))
    smooth = moving_average(good, ["acc_x"], 5)
    return rounded(smooth, [SERIES, SEQ, "n", "line_no"], ["acc_x", "acc_x_smooth"])


DOCUMENT_FEATURES_SQL = f"""
WITH e AS (
  SELECT event_type AS series_id, event_id AS line_no, {SHAPES} AS shape, CAST(round(value * 100) AS BIGINT) AS c,
         CAST(floor(round(value * 100) / 100) AS BIGINT) AS w
  FROM events),
g AS (SELECT series_id, line_no, CASE WHEN shape = 'whole' THEN CAST(w AS DOUBLE) ELSE c / 100.0 END AS acc_x,
             row_number() OVER s - 1 AS seq, count(*) OVER (PARTITION BY series_id) AS n
      FROM e WHERE shape IN ('missing', 'whole', 'good') WINDOW s AS (PARTITION BY series_id ORDER BY line_no))
SELECT series_id, seq, n, line_no, {r('acc_x')} AS acc_x,
       {r('sum(acc_x) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} AS acc_x_smooth
FROM g WHERE n >= 5"""


def whole_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Old format; every third event also carries a timestamp and so is not 3 + 3."""
    v = F.floor(F.col("value")).cast("string")
    stamp = F.when(F.col("event_id") % 3 == 0, "timestamp_acc=1,").otherwise("")
    line = F.concat(
        stamp, F.lit("acc_x="), v, F.lit(",12,acc_y=2,acc_z=-"), v, F.lit(";gyro_x="), v, F.lit(",gyro_y=5,gyro_z=6,99")
    )
    return table(spark, folder, "events").select(F.col("event_type").alias(SERIES), F.col("event_id").alias(SEQ), line.alias("line"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id"), F.col("text").alias("content"))


NAMES = """CASE event_id % 7 WHEN 0 THEN 'flexion_cuello_' WHEN 1 THEN 'extension_cuello_' WHEN 2 THEN 'flex_bajo_cuello_'
  WHEN 3 THEN 'ext_subo_cuello_' WHEN 4 THEN 'idle_cuello_' WHEN 5 THEN 'Gir_Flex_izqda_' ELSE 'otro_' END
  || CAST(event_id % 13 AS VARCHAR(9)) || CASE WHEN event_id % 2 = 0 THEN 'rep_' ELSE 'rep' END || CAST(event_id AS VARCHAR(19))"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.expr(NAMES.replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING")).alias("name"))


def label_rules(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("name")
    d = label(n, RULE_D)
    return _names(spark, folder).select(
        "event_id",
        "name",
        label(n, RULE_A, prefix=True, lower=False).alias("rule_a"),
        label(n, RULE_B, lower=False).alias("rule_b"),
        label(n, RULE_C).alias("rule_c"),
        d.alias("rule_d"),
        class_name(d).alias("class_name"),
    )


LABEL_SQL = f"""
WITH e AS (SELECT event_id, {NAMES} AS name FROM events),
d AS (SELECT *, lower(name) AS l FROM e),
k AS (SELECT *, CASE WHEN contains(l, 'flexion') OR contains(l, 'flex_bajo') THEN 0
       WHEN contains(l, 'extension') OR contains(l, 'ext_subo') THEN 1 WHEN contains(l, 'idle') THEN 2
       WHEN contains(l, 'gir_flex_izqda') OR contains(l, 'gir_flex_dcha') THEN 3 END AS rule_d FROM d)
SELECT event_id, name,
  CASE WHEN starts_with(name, 'extension_cuello') THEN 1 WHEN starts_with(name, 'flexion_cuello') THEN 0 END AS rule_a,
  CASE WHEN contains(name, 'flexion') THEN 0 WHEN contains(name, 'extension') THEN 1 END AS rule_b,
  CASE WHEN contains(l, 'flexion') THEN 'Flexion' WHEN contains(l, 'extension') THEN 'Extension'
       WHEN contains(l, 'idle') THEN 'Idle' END AS rule_c,
  rule_d,
  CASE rule_d WHEN 0 THEN 'Flexión' WHEN 1 THEN 'Extensión' WHEN 2 THEN 'Idle' WHEN 3 THEN 'Flex baja' END AS class_name
FROM k"""


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return explode_lines(_documents(spark, folder))


def _strip(spark: SparkSession, folder: str, exact: bool = False) -> DataFrame:
    plain = strip_accents(F.col("text"), exact)
    return table(spark, folder, "documents").select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("bigint").alias("chars"))


STRIP_SQL = "SELECT doc_id, md5(strip_accents(text)) AS digest, length(strip_accents(text)) AS chars FROM documents"

QUERIES = {
    "parse_lines": Query(
        lambda s, d: _parsed(parse_tolerant(raw_lines(s, d))[0]), _parsed_sql("'missing', 'whole', 'good'", True)
    ),
    "parse_rejects": Query(
        lambda s, d: parse_tolerant(raw_lines(s, d))[1].select(SERIES, SEQ, "reason"),
        f"""
WITH e AS (SELECT event_type AS series_id, event_id AS seq, {SHAPES} AS shape FROM events)
SELECT series_id, seq, CASE shape WHEN 'two_parts' THEN 'expected two parts separated by '';'''
  WHEN 'two_equals' THEN 'item with two ''=''' ELSE 'malformed number' END AS reason
FROM e WHERE shape IN ('two_parts', 'two_equals', 'two_fractions')""",
    ),
    "documents_features": Query(document_features, DOCUMENT_FEATURES_SQL),
    "parse_strict": Query(
        lambda s, d: _parsed(parse_strict(raw_lines(s, d))[0]), _parsed_sql("'good'", False)
    ),
    "parse_strict_rejects": Query(
        lambda s, d: parse_strict(raw_lines(s, d))[1].select(SERIES, SEQ, "reason"),
        f"""
WITH e AS (SELECT event_type AS series_id, event_id AS seq, {SHAPES} AS shape FROM events)
SELECT series_id, seq, CASE shape WHEN 'two_parts' THEN 'expected two parts separated by '';'''
  ELSE 'expected a timestamp and three values in each part' END AS reason
FROM e WHERE shape <> 'good'""",
    ),
    "parse_whole": Query(
        lambda s, d: rounded(parse_whole(whole_lines(s, d)), [SERIES, LINE_NO, SEQ, LENGTH], AXES),
        """
WITH e AS (SELECT event_type AS series_id, event_id AS seq, floor(value) AS v FROM events WHERE event_id % 3 <> 0)
SELECT series_id, seq AS line_no, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS seq,
       count(*) OVER (PARTITION BY series_id) AS n, v AS acc_x, CAST(2 AS DOUBLE) AS acc_y, -v + 0.0 AS acc_z, v AS gyro_x,
       CAST(5 AS DOUBLE) AS gyro_y, CAST(6 AS DOUBLE) AS gyro_z FROM e""",
    ),
    "doc_lines": Query(
        _document_lines,
        r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS series_id,
                  string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM documents)
SELECT series_id, unnest(range(len(l))) AS seq, unnest(l) AS line FROM d""",
    ),
    "strip_accents": Query(_strip, STRIP_SQL),
    "strip_accents_exact": Query(lambda s, d: _strip(s, d, True), STRIP_SQL),
    "label_rules": Query(label_rules, LABEL_SQL),
    "rep_from_name": Query(
        lambda s, d: _names(s, d).select("event_id", repetitions(F.col("name")).alias("reps")),
        rf"""
WITH e AS (SELECT event_id, {NAMES} AS name FROM events)
SELECT event_id, CAST(nullif(regexp_extract(name, '_(\d+)rep_', 1), '') AS INTEGER) AS reps FROM e""",
    ),
    "unlabelled_series": Query(
        lambda s, d: _names(s, d).filter(label(F.col("name"), RULE_D).isNull()).select("event_id", "name"),
        f"""
WITH e AS (SELECT event_id, {NAMES} AS name FROM events)
SELECT event_id, name FROM e WHERE starts_with(name, 'otro_')""",
    ),
    "formatted_report": Query(
        lambda s, d: table(s, d, "events")
        .groupBy(F.col("event_type").alias(SERIES))
        .agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
        .select(SERIES, fixed4(F.col("k") / F.col("n")).alias("share")),
        """
SELECT event_type AS series_id, printf('%.4f', count(*) FILTER (value > 50) * 1.0 / count(*)) AS share
FROM events GROUP BY event_type""",
    ),
}
