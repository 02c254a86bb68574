"""Encoding with a piece model that keeps, for every piece, the bytes of the original text that it stands for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from kinelane.llm.char_map import normaliser_of
from kinelane.llm.common import arrow_pass, text_of
from kinelane.llm.token_counts import SPACE, cuts_at_spaces, load_pieces
from kinelane.llm.units import UnitCache, piece_units


class Encoding(NamedTuple):
    """Ids of a text, the byte spans [begin, end) of the pieces in the original text, and the ids written out."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    written: str


class PieceCodec:
    """One worker's encoder: normalise by longest prefix, cut at word starts, merge, project pieces to source bytes."""

    def __init__(self, path: str):
        self.model = load_pieces(path)
        self.normalise = normaliser_of(path)
        self.cuts = cuts_at_spaces(self.model) and self.normalise.escape_spaces and self.normalise.dummy_prefix
        self.sizes = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(self.model.get_piece_size())])
        if self.model.encode("\U0010fffd") == [self.model.unk_id()]:
            raise ValueError("pieces can be projected to bytes only for models with byte fallback")
        self.units = UnitCache(self._merge, limit=250_000)

    def _merge(self, units: list[str]) -> list[tuple[bytes, str]]:
        return [(np.array(ids, np.int32).tobytes(), ",".join(map(str, ids))) for ids in self.model.encode(units, num_threads=1)]

    def encode(self, texts: list[str]) -> list[Encoding]:
        normal = [self.normalise(t.encode()) for t in texts]
        if self.cuts and self.normalise.identity:
            # Normalised text minus its first space mark, read as words: merging the words is merging the whole.
            split = [piece_units(n[len(SPACE.encode()) :].decode().replace(SPACE, " ")) if n else [] for n, _ in normal]
        else:
            split = [[t] if t else [] for t in texts]
        self.units.fill(split)
        return [self._project(units, *found) for units, found in zip(split, normal, strict=True)]

    def _project(self, units: list[str], normal: bytes, starts: np.ndarray) -> Encoding:
        found = [self.units[u] for u in units]
        ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        written = ",".join([f[1] for f in found if f[1]])
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return Encoding(ids, starts[begins], starts[ends], written)

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _parts(texts: list[str]):
    """Texts in groups of about a million characters, so that spans of few texts exist at a time."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > 1_000_000:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_pieces(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    derive: Callable[[PieceCodec, Encoding], tuple] | None = None,
    columns: str = "ids array<int>, begins array<long>, ends array<long>, decoded string",
) -> DataFrame:
    """Ids, original byte spans and decoded text of every row, or what ``derive`` makes of them in the same pass.

    One pass, no shuffle; no begin or end ids, no sampling. Null text is empty: no ids, decoded to the empty string.
    Null ids, repeated rows and empty tables pass through row by row; other columns are not read. Texts of any length
    are encoded whole.
    """
    derive = derive or (lambda c, e: (e.ids, e.begins, e.ends, c.decode(e.ids)))
    names = [c.split()[0] for c in columns.split(", ")]

    def work(rows: dict[str, list]) -> dict[str, object]:
        own = codec(path)
        made = [derive(own, e) for part in _parts(rows["text"]) for e in own.encode(part)]
        return {"doc_id": rows["doc_id"], **dict(zip(names, zip(*made, strict=True), strict=True))}

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, {columns}")


def digests(own: PieceCodec, e: Encoding) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids written in decimal with commas, SHA-256 of the decoded text."""
    sha = hashlib.sha256
    return len(e.ids), sha(e.written.encode()).hexdigest(), sha(own.decode(e.ids).encode()).hexdigest()
