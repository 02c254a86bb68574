"""Raw sensor lines ``timestamp_acc=..,acc_x=1,19..;timestamp_gyro=..,gyro_x=..`` to typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.functions.text import trim_ws
from kinelane.operators.lanes import number_rows
from kinelane.schema import AXES, PROFILES, SEQ, SERIES

LINE_NO = "line_no"

NUMBER = r"\s*[+-]?(?:\d+,\d*|,\d+)(?:[eE][+-]?\d+)?\s*"
FRAGMENT = r"[^=,;]*+"  # possessive: what it stops at never belongs to it
# key=int,fraction (which must be a number) or key=anything; after a nameless key fragments are ignored.
ELEMENT = rf"(?:[^=,;]++={NUMBER}|[^=,;]++={FRAGMENT}|={FRAGMENT}(?:,{FRAGMENT})*)"
HALF = rf"(?:{FRAGMENT},)*(?:{ELEMENT}(?:,{ELEMENT})*|{FRAGMENT})"
TOLERANT = rf"^{HALF};{HALF}$"
PAIR = r"[^=,;]*=\s*[+-]?\d+,\d+"
STRICT_HALF = rf"[^=,;]*=\s*\d+(?:\.\d+)?,{PAIR},{PAIR},{PAIR}"
STRICT = rf"^{STRICT_HALF};{STRICT_HALF}$"


def _halves(line: Column) -> Column:
    return F.size(F.split(line, ";"))


def _starts(name: str) -> Callable[[Column], Column]:
    return lambda item: item.startswith(f"{name}=")


def _items(line: Column) -> Column:
    """Items of both halves, fractions joined to their whole part so that each is ``key=value``."""
    joined = F.regexp_replace(line, r"(=\s*[+-]?\d*),(\d*(?:[eE][+-]?\d+)?\s*(?:[,;]|$))", "$1.$2")
    return F.split(joined, "[,;]")


def _value(items: Column, name: str) -> Column:
    """Value by name; of two items with the same name the later one counts."""
    last = F.try_element_at(F.filter(items, _starts(name)), F.lit(-1))
    text = F.trim(F.substring_index(last, "=", -1))
    return text.try_cast("bigint" if name.startswith("timestamp") else "double")


def _has_item(line: Column) -> Column:
    return line.rlike(r"(^|[,;])[^=,;]+=")


def tolerant_ok(line: Column) -> Column:
    return line.rlike(TOLERANT) & _has_item(line)


def tolerant_reason(line: Column) -> Column:
    """Why the tolerant parser drops a line; NULL if it does not."""
    return F.when(
        ~tolerant_ok(line),
        F.when(line == "", "empty line")
        .when(_halves(line) != 2, "expected two parts separated by ';'")
        .when(line.rlike(r"=[^,;]*="), "item with two '='")
        .when(~_has_item(line), "no key=value item")
        .otherwise("malformed number"),
    )


def parse_tolerant(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(recordings, rejects)``: missing keys become NULL, malformed lines are rejected with a reason.

    Positions of recordings are dense (see ``renumbered``), as for the other parsers; rejects keep their line number.
    """
    text = F.col(line)
    split = lines.filter(tolerant_ok(text)).withColumn("_items", _items(text))
    good = split.withColumns({c: _value(F.col("_items"), c) for c in PROFILES["P8_RAW"]}).drop(line, "_items")
    bad = lines.withColumn("reason", tolerant_reason(text)).filter(F.col("reason").isNotNull())
    return renumbered(good), bad.select(SERIES, SEQ, F.col(line).alias("line"), "reason")


def parse_strict(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Positional parser: a timestamp and three (whole, fraction) pairs in either half, whatever the names."""
    text = F.col(line)
    ok = text.rlike(STRICT)
    value = r"[^=,;]*=\s*([+-]?\d+,\d+)"
    made: dict[str, Column] = {}
    for half, axes in ((0, AXES[:3]), (1, AXES[3:])):
        part = F.element_at(F.split(text, ";"), half + 1)
        stamp = "timestamp_acc" if half == 0 else "timestamp_gyro"
        made[stamp] = F.regexp_extract(part, r"^[^=,;]*=\s*(\d+(?:\.\d+)?)", 1).try_cast("double").cast("bigint")
        for i, axis in enumerate(axes):
            pattern = r"^[^,;]*," + rf"{PAIR}," * i + value
            made[axis] = F.replace(F.regexp_extract(part, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    good = lines.filter(ok).withColumns(made).drop(line)
    reason = F.when(_halves(text) != 2, "expected two parts separated by ';'").otherwise(
        "expected a timestamp and three values in each part"
    )
    bad = lines.filter(~ok).select(SERIES, SEQ, F.col(line).alias("line"), reason.alias("reason"))
    return renumbered(good), bad


def parse_whole(lines: DataFrame, line: str = "line") -> DataFrame:
    """Old format without timestamps or fractions: lines with exactly 3 + 3 ``key=value`` items."""
    text = F.col(line)
    halves = F.split(text, ";")

    def values(half: int) -> Column:
        items = F.filter(F.split(F.element_at(halves, half), ","), lambda v: v.contains("="))
        return F.transform(items, lambda v: F.split(v, "=")[1].try_cast("double"))

    six = F.concat(values(1), values(2))
    both = lines.filter(F.size(halves) == 2).withColumns({"_a": values(1), "_g": values(2)})
    kept = both.filter((F.size("_a") == 3) & (F.size("_g") == 3) & ~F.exists(six, lambda v: v.isNull()))
    made = {a: F.col("_a")[i] for i, a in enumerate(AXES[:3])}
    made |= {g: F.col("_g")[i] for i, g in enumerate(AXES[3:])}
    return renumbered(kept.withColumns(made).drop(line, "_a", "_g"))


def renumbered(good: DataFrame) -> DataFrame:
    """Parsed lines with dense positions: rejected lines leave holes that no operator may see.

    ``seq`` becomes the rank among the good lines of the document and ``n`` their number; the position in the document
    stays as ``line_no``.
    """
    return number_rows(good.withColumnRenamed(SEQ, LINE_NO), [LINE_NO])


def explode_lines(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """One row per line of a document, in order: ``(series_id, seq, line)``; ``seq`` is the line number from 0."""
    parts = F.split(trim_ws(F.coalesce(F.col(content), F.lit(""))), "\n")
    return docs.select(F.col(key).cast("string").alias(SERIES), F.posexplode(parts).alias("_p", "line")).select(
        SERIES, F.col("_p").cast("long").alias(SEQ), "line"
    )
