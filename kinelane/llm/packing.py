"""Best-fit decreasing packing of token sequences, planned from the number of pieces of each length."""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelane.llm.common import arrow_pass, lanes_for, stored, text_of
from kinelane.llm.units import UnitCache, byte_units

#: Pieces numbered together; more pieces make more lanes.
LANE_ROWS = 20_000


# Fixed value: how byte-level vocabularies split text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of every token with its id, if merging by lowest id is what the file's list of merges says; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        return None
    # Bytes that print stand for themselves, the others for the characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Ids:
    """Ids of whole texts for one worker, joined from cached ids of the units between spaces.

    Units without special tokens are merged by rank, which is several times as fast as the vocabulary's own library and
    gives the same ids; all others, and vocabularies of another kind, go through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.ranked = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.break_id = self._encode(["\n"])[0]
        self.units = UnitCache(self._merge, limit=300_000)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, units: list[str]) -> list[bytes]:
        """Ids of " " + unit. Units without a line break are merged together, one per line, and cut at the breaks."""
        out: list[bytes | None] = [None] * len(units)
        if self.ranked and len(self.break_id) == 1:
            plain = [k for k, u in enumerate(units) if u and "\n" not in u and not (u[0].isspace() or u[-1].isspace() or any(t in u for t in self.special))]
            ids = np.array(self.ranked.encode_ordinary(" " + "\n ".join([units[k] for k in plain])), np.uint32)
            breaks = np.flatnonzero(ids == self.break_id[0])
            if plain and len(breaks) == len(plain) - 1:
                raw = ids.tobytes()
                for k, a, b in zip(plain, [0, *(4 * breaks + 4).tolist()], [*(4 * breaks).tolist(), len(raw)], strict=True):
                    out[k] = raw[a:b]
        left = [k for k, found in enumerate(out) if found is None]
        for k, ids in zip(left, self._encode([" " + units[k] for k in left]), strict=True):
            out[k] = np.array(ids, np.uint32).tobytes()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [byte_units(text) for text in texts]
        heads = self._encode([units[0] for units in split])
        for units in split:
            del units[0]
        self.units.fill(split)
        get = self.units.__getitem__
        return [np.array(head, np.uint32).tobytes() + b"".join(map(get, units)) for head, units in zip(heads, split, strict=True)]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: ids of each text plus the end id, cut only where they exceed ``capacity``.

    A longer document leaves its remainder in the first piece, every other piece is full.
    """

    def work(rows: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.uint32(end_id).tobytes()
        for doc, ids in zip(rows["doc_id"], ids_of(path)(rows["text"]), strict=True):
            ids += end
            n = len(ids) // 4
            first = n % capacity or capacity
            begins = [0, *range(first, n, capacity)]
            for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                for name, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                    out[name].append(value)
        return out

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Run(NamedTuple):
    """Pieces ``rank .. rank + bins * each`` of one length go to ``bins`` sequences, ``each`` in a row per sequence."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


class OpenBins:
    """Segment tree over remaining capacities: which have open bins, and the tightest that still takes a length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many)

    def _mark(self, room: int) -> None:
        at = self.leaves + room
        self.filled[at] = bool(self.bins[room])
        while at > 1:
            at //= 2
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        found = self.bins[room].pop()
        self._mark(room)
        return found

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` that an open bin has."""
        at = self.leaves + length
        if self.filled[at]:
            return length
        while at > 1 and (at & 1 or not self.filled[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.filled[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over ``counts`` pieces of each length; equal bins and equal pieces are placed together.

    Every placement is the one that best fit makes piece by piece: the tightest open bin keeps taking pieces of a
    length while they fit, since it only gets tighter. Work and size depend on the capacity alone, not on the pieces.
    """
    open_bins, runs, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, count = made, max(1, left // each)
                made += count
            else:
                first, count = open_bins.take(room)
                each = room // length
            if left >= each:
                used = min(count, left // each)
            else:
                used, each = 1, left
            runs.append(Run(length, rank, used, each, first, capacity - room))
            rank += used * each
            left -= used * each
            open_bins.put(room, first + used, count - used)
            open_bins.put(room - each * length, first, used)
    return runs


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``; places are gapless from 0 in every sequence.

    Pieces are numbered within (length, lane); lanes are hashes of the document, their number grows with the pieces.
    Only the number of pieces per length (at most ``capacity`` rows) reaches the driver.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = stored(found.select(*keys), "pieces")
    counts = {row["length"]: row["n"] for row in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lanes = lanes_for(sum(counts.values()), LANE_ROWS)
    laned = found.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(lanes)))
    sizes = laned.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = laned.withColumn("row", F.row_number().over(own) - 1).join(sizes, ["length", "lane"])
    ranked = ranked.select(*keys, (F.col("first") + F.col("row")).alias("rank"))
    runs = plan(counts, capacity)
    table: dict[int, np.ndarray] = {}
    for length in counts:
        table[length] = np.array([r[1:] for r in runs if r.length == length], np.int64)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                run = table[n][np.searchsorted(table[n][:, 0], rank[at], side="right") - 1]
                bin_, turn = np.divmod(rank[at] - run[:, 0], run[:, 2])
                sequence[at], offset[at] = run[:, 3] + bin_, run[:, 4] + turn * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*keys, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*keys, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_fit(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs every text of ``df`` into sequences of at most ``capacity`` tokens, one row per piece.

    Null text is empty (the end id alone); repeated rows are packed as often as they occur; null ids stay null; an empty
    table gives no rows; columns other than the two named are not read. Pieces that are equal in every column may
    change places with one another, which changes no sequence.
    """
    return pack(pieces(df, path, capacity, end_id, id_column, text_column), capacity)
