"""String functions, naming rules and labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names by id.
CLASS_NAMES = {0: "Flexión", 1: "Extensión", 2: "Idle", 3: "Flex baja"}
# Fragments of a file name that decide its class (first match wins).
RULE_A = [("extension_cuello", 1), ("flexion_cuello", 0)]
RULE_B = [("flexion", 0), ("extension", 1)]
RULE_C = [("flexion", "Flexion"), ("extension", "Extension"), ("idle", "Idle")]
RULE_D = [
    ("flexion", 0), ("flex_bajo", 0),
    ("extension", 1), ("ext_subo", 1),
    ("idle", 2),
    ("gir_flex_izqda", 3), ("gir_flex_dcha", 3),
]

SLICE_BYTES = 4_000_000  # of text that is decomposed at a time
LATIN = [(0x00A8, 0x024F), (0x0300, 0x036F), (0x1E00, 0x1EFF)]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _plain(text: str | None) -> str | None:
    return text if text is None or text.isascii() else _without_marks(text)


def _accent_map() -> tuple[str, str]:
    """Latin letters to their base letter; combining marks have no counterpart, so they vanish."""
    kept, removed, bases = [], [], []
    for low, high in LATIN:
        for code in range(low, high + 1):
            ch = chr(code)
            base = _without_marks(ch)
            if base == "":
                removed.append(ch)
            elif len(base) == 1 and base != ch:
                kept.append(ch)
                bases.append(base)
    return "".join(kept + removed), "".join(bases)


def strip_accents(c: Column, exact: bool = False) -> Column:
    """Decompose and drop combining marks.

    The built-in form covers Latin letters; ``exact`` handles every script in an Arrow batch.
    """
    if not exact:
        return F.translate(c, *_accent_map())

    @F.arrow_udf("string")
    def decompose(text: pa.Array) -> pa.Array:
        made, first, held = [], 0, 0
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for i, size in enumerate([*sizes.tolist(), SLICE_BYTES]):
            if held + size > SLICE_BYTES and i > first or i == len(sizes):  # a slice at a time becomes Python strings
                made.append(pa.array(map(_plain, text.slice(first, i - first).to_pylist()), pa.string()))
                first, held = i, 0
            held += size
        return pa.concat_arrays(made)

    # Plain texts stay where they are.
    return F.coalesce(decompose(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def repetitions(name: Column, strict: bool = False) -> Column:
    """Repetition count from ``_<digits>rep_`` in a name; NULL (or an error if ``strict``) without it."""
    found = F.nullif(F.regexp_extract(name, r"_(\d+)rep_", 1), F.lit("")).try_cast("int")
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no repetition count in "), name)).cast("int"))


def label(
    name: Column,
    rule: Sequence[tuple[str, int | str]] = RULE_D,
    prefix: bool = False,
    lower: bool = True,
    strict: bool = False,
) -> Column:
    """Class of a recording from its name; NULL (or an error if ``strict``) when no fragment matches."""
    text = F.lower(name) if lower else name
    test = text.startswith if prefix else text.contains
    chain: Column | None = None
    for fragment, value in rule:
        hit = test(fragment)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    assert chain is not None
    if strict:
        kind = "string" if isinstance(rule[0][1], str) else "int"
        return chain.otherwise(F.raise_error(F.concat(F.lit("unknown label for "), name)).cast(kind))
    return chain


def class_name(c: Column, names: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(v) for item in (names or CLASS_NAMES).items() for v in item]
    return F.element_at(F.create_map(*pairs), c)


def fixed4(c: Column) -> Column:
    return F.format_string("%.4f", c)
