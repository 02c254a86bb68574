"""Two tokenisers aligned on the bytes of a text, each distinct text once, with corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelane.llm.char_map import normaliser_of
from kinelane.llm.common import small, stored
from kinelane.llm.packing import Ids
from kinelane.llm.token_counts import SPACE, cuts_at_spaces, load_pieces
from kinelane.llm.units import UnitCache

#: A space that begins a token in both vocabularies: one that follows no space and precedes a visible character.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Longer units are aligned where they stand and not remembered.
REMEMBERED = 64
#: Texts aligned at a time.
TEXTS = 400
#: Most frequent pairs that tasks get as a broadcast; the others are joined by shuffle. Pairs counted before a task hands them on.
FREQUENT, HELD = 1_000_000, 2_000_000
#: Links of a group that are listed one by one.
LISTED = 4096


#: A unit in both vocabularies: numbers of A tokens, B tokens, groups and links; groups written out; linked pairs as 64-bit
#: codes (A id times the size of B, plus B id) and the links of each.
Aligned = tuple[int, int, int, int, str, bytes, bytes]
#: The links of pairs that are linked once each.
ONES = [np.ones(k, np.int64).tobytes() for k in range(64)]


class PlainIds(Ids):
    """Ids in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []


class Aligner:
    """One worker's pair of tokenisers. Texts are cut where a token begins in both, and repeated units are kept."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = PlainIds(byte_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.size_a = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = load_pieces(piece_path)
        self.size_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.lengths = [np.fromiter(map(len, parts), np.int64, len(parts)) for parts in (self.a_bytes, self.b_bytes)]
        # An id with what follows it in a written group: A inside and at the end of a group, B inside and at the end.
        self.written = [f"{i}{sign}" for size, signs in ((self.size_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(size)]
        self.span = self.size_a * self.size_b
        normal = normaliser_of(piece_path)
        self.cuts = self.a.ranked is not None and cuts_at_spaces(self.b) and normal.identity and normal.dummy_prefix
        self.units = UnitCache(self._align, limit=100_000)

    def _align(self, units: list[str]) -> list[Aligned | None]:
        """Each unit with the space before it; None where the tokens' bytes are not the unit's."""
        raws = [b" " + u.encode() for u in units]
        a_blobs, b_ids = self.a._merge(units), self.b.encode(units, num_threads=1)
        a, b = np.frombuffer(b"".join(a_blobs), np.uint32).astype(np.int64), np.fromiter(chain.from_iterable(b_ids), np.int64, sum(map(len, b_ids)))
        a_counts, b_counts, sizes = ([len(x) // 4 for x in a_blobs], list(map(len, b_ids)), np.array(list(map(len, raws))))
        chosen = range(len(units))
        if not self._covers(a, a_counts, b, b_counts, raws, sizes):
            chosen = [k for k in chosen if self._covers(*self._one(k, a_blobs, b_ids), raws[k : k + 1], sizes[k : k + 1])]
            a = np.frombuffer(b"".join([a_blobs[k] for k in chosen]), np.uint32).astype(np.int64)
            b = np.array([i for k in chosen for i in b_ids[k]], np.int64)
        out: list[Aligned | None] = [None] * len(units)
        if len(chosen):
            made = self._linked(a, [a_counts[k] for k in chosen], b, [b_counts[k] for k in chosen], int(sizes[chosen].sum()))
            for k, found in zip(chosen, made, strict=True):
                out[k] = found
        return out

    @staticmethod
    def _one(k: int, a_blobs: list[bytes], b_ids: list[list[int]]) -> tuple:
        a = np.frombuffer(a_blobs[k], np.uint32).astype(np.int64)
        return a, [len(a)], np.array(b_ids[k], np.int64), [len(b_ids[k])]

    def _covers(self, a: np.ndarray, a_counts: list[int], b: np.ndarray, b_counts: list[int], raws: list[bytes], sizes: np.ndarray) -> bool:
        """Whether the tokens of every unit, joined, are its bytes in both vocabularies."""
        whole = b"".join(raws)
        for ids, counts, parts, lengths in ((a, a_counts, self.a_bytes, self.lengths[0]), (b, b_counts, self.b_bytes, self.lengths[1])):
            ends = np.append(0, np.cumsum(lengths[ids]))[np.append(0, np.cumsum(counts))]
            if (np.diff(ends) != sizes).any() or b"".join(map(parts.__getitem__, ids.tolist())) != whole:
                return False
        return True

    def _linked(self, a: np.ndarray, a_counts: list[int], b: np.ndarray, b_counts: list[int], size: int) -> Iterator[Aligned]:
        """Groups and links of units whose tokens cover their bytes, all at once: bytes of the units stand in a row."""
        a_end, b_end = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.zeros((2, size + 1), bool)
        ends[0, a_end] = ends[1, b_end] = True
        a_last, b_last = ends[1, a_end], ends[0, b_end]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_size, b_size = np.bincount(a_group), np.bincount(b_group)
        a_first, b_first = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_first[a_group]] = a + a_last * self.size_a
        order[np.arange(len(b)) + (a_first + a_size)[b_group]] = b + b_last * self.size_b + 2 * self.size_a
        written = list(map(self.written.__getitem__, order.tolist()))
        # Every A token with all B tokens of its group; groups with very many links add up equal pairs one by one.
        links = a_size * b_size
        listed = np.where(links <= LISTED, b_size, 0)[a_group]
        before = np.cumsum(listed) - listed
        one = np.repeat(np.arange(len(a)), listed)
        codes = a[one] * self.size_b + b[b_first[a_group[one]] + np.arange(len(one)) - before[one]]
        a_upto, b_upto = np.cumsum(a_counts), np.cumsum(b_counts)
        groups = np.append(0, a_group[a_upto - 1] + 1).tolist()
        code_upto = np.append(before, len(codes))[a_upto].tolist()
        large = np.flatnonzero(links > LISTED).tolist()
        total = np.append(0, np.cumsum(links))[groups].tolist()
        raw, x, i, p = codes.tobytes(), 0, 0, 0
        for k, (n_a, y, upto) in enumerate(zip(a_counts, (a_upto + b_upto).tolist(), code_upto, strict=True)):
            own, counts = raw[8 * p : 8 * upto], ONES[upto - p] if upto - p < len(ONES) else ONES[1] * (upto - p)
            while i < len(large) and large[i] < groups[k + 1]:
                found = self._counted(a[a_first[large[i]] :][: a_size[large[i]]], b[b_first[large[i]] :][: b_size[large[i]]])
                own, counts, i = own + found[0], counts + found[1], i + 1
            yield n_a, y - x - n_a, groups[k + 1] - groups[k], total[k + 1] - total[k], "".join(written[x:y])[:-1], own, counts
            x, p = y, upto

    def _counted(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        """Different pairs of a group and their links."""
        (a, m), (b, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        return np.add.outer(a * self.size_b, b).tobytes(), np.multiply.outer(m, n).tobytes()

    def align(self, texts: list[str]) -> list[list[Aligned] | None]:
        """Aligned units of each text; None for texts without tokens. Units that these texts hold once are not remembered."""
        split = [CUT.split(t) if self.cuts and t else [t] * bool(t) for t in texts]
        counts = Counter(chain.from_iterable(split))
        self.units.fill({u for u in counts if counts[u] > 1 and len(u) <= REMEMBERED})
        left = [u for u in counts if u not in self.units]
        here = dict(zip(left, chain.from_iterable(self._align(left[k : k + 20_000]) for k in range(0, len(left), 20_000)), strict=True))
        known = self.units
        made = [[known[u] if u in known else here[u] for u in units] for units in split]
        return [None if not m or None in m else m for m in made]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def text_key(column: str) -> F.Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 32))


MEASURES = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def code_type(byte_path: str, piece_path: str) -> str:
    """Type of a pair's code: four bytes where the product of the vocabularies allows."""
    return "<u4" if aligner(byte_path, piece_path).span <= 1 << 32 else "<u8"


def aligned_texts(df: DataFrame, byte_path: str, piece_path: str, text_column: str = "text") -> DataFrame:
    """One row per distinct text that has tokens: measures, multiplicity, and its different linked pairs with their links.

    Texts are shuffled whole, after equal ones of a task have been counted, so that many copies are one row.
    """
    texts = df.select(F.col(text_column).cast("string").alias("text")).filter("text is not null and text != ''")
    distinct = texts.groupBy("text").agg(F.count("*").alias("copies")).select(text_key("text").alias("key"), "copies", "text")
    narrow = code_type(byte_path, piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        for batch in batches:
            for part in (p.slice(k, TEXTS) for p in small(batch) for k in range(0, p.num_rows, TEXTS)):
                made = own.align(part.column(2).to_pylist())
                rows = [k for k, m in enumerate(made) if m is not None]
                if not rows:
                    continue
                columns = [list(zip(*made[k], strict=True)) for k in rows]
                found = [b"".join(c[5]) for c in columns]
                codes, links = np.frombuffer(b"".join(found), np.int64), np.frombuffer(b"".join([b"".join(c[6]) for c in columns]), np.int64)
                text = np.repeat(np.arange(len(rows)), [len(f) // 8 for f in found])
                order = np.lexsort((codes, text))
                codes, text = codes[order], text[order]
                cuts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])]))
                codes, links = codes[cuts].astype(narrow), np.add.reduceat(links[order], cuts)
                ends = np.searchsorted(text[cuts], np.arange(len(rows)), side="right").tolist()
                spans = list(zip([0, *ends[:-1]], ends, strict=True))
                taken = part.take(pa.array(rows))
                numbers = [pa.array([sum(c[k]) for c in columns], pa.int64()) for k in range(4)]
                written = pa.array([hashlib.sha256(";".join(c[4]).encode()).hexdigest() for c in columns])
                blobs = [pa.array([v[x:y].tobytes() for x, y in spans], pa.binary()) for v in (codes, links)]
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *numbers, written, *blobs], names=names)

    names = [f.split()[0] for f in MEASURES.split(", ")] + ["codes", "links"]
    return distinct.mapInArrow(run, f"{MEASURES}, codes binary, links binary")


def _entries(batch: pa.RecordBatch, codes: int, links: int, narrow: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair codes and links of all texts of a batch, and the row of each."""
    blobs = batch.column(codes).to_pylist()
    joined = np.frombuffer(b"".join(blobs), narrow).astype(np.int64)
    sizes = [len(b) // np.dtype(narrow).itemsize for b in blobs]
    return joined, np.frombuffer(b"".join(batch.column(links).to_pylist()), np.int64), np.repeat(np.arange(len(blobs)), sizes)


def pair_counts(aligned: DataFrame, narrow: str, size_b: int) -> DataFrame:
    """``code, n, best``: in how many documents a pair is linked, and whether no pair of its A id is in more.

    Tasks add up their texts' pairs, weighted by multiplicity, before the shuffle. The greatest count of an A id is a
    row per A id, at most the size of that vocabulary, and is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            codes, _, row = _entries(batch, 1, 2, narrow)
            weights = batch.column(0).to_numpy()[row]
            held, which = np.unique(np.concatenate([held, codes]), return_inverse=True)
            summed = np.zeros(len(held), np.int64)
            np.add.at(summed, which, np.concatenate([counts, weights]))
            counts = summed
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["code", "n"])
                held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["code", "n"])

    parts = aligned.select("copies", "codes", "links").mapInArrow(run, "code long, n long")
    pairs = stored(parts.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"code div {size_b}")), "pairs")
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return stored(pairs.join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")


def frequent_from(pairs: DataFrame, limit: int) -> tuple[int, bool]:
    """Least count, a power of two, that at most ``limit`` pairs reach; and whether pairs are left below it."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    total, least = 0, 0
    for power, n in sorted(map(tuple, sizes), reverse=True):
        total += n
        if total > limit:
            return 1 << (power + 1), True
        least = 1 << power
    return least, False


def with_counts(aligned: DataFrame, pairs: DataFrame, narrow: str) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the measures of every text.

    The most frequent pairs, at most FREQUENT, are broadcast as arrays: they are the ones that very many texts hold. The
    entries of all others meet their pair in a join, where no pair has more entries than the least frequent of those.
    """
    least, more = frequent_from(pairs, FREQUENT)
    table = pairs.filter(F.col("n") >= least).toArrow()
    columns = [table.column(n).to_numpy() for n in ("code", "n", "best")]
    order = np.argsort(columns[0])
    known = aligned.sparkSession.sparkContext.broadcast([c[order] for c in columns])
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def find(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the broadcast table, and whether the codes are there."""
        if not len(known.value[0]):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(known.value[0], codes), len(known.value[0]) - 1)
        return at, known.value[0][at] == codes

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, links, row = _entries(batch, len(names), len(names) + 1, narrow)
            at, there = find(codes)
            codes, links, row, at = codes[there], links[there], row[there], at[there]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            if len(at):
                np.add.at(sums[0], row, links * known.value[2][at])
                np.add.at(sums[1], row, links * known.value[1][at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, links, row = _entries(batch, 1, 2, narrow)
            left = ~find(codes)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[left])), pa.array(codes[left]), pa.array(links[left])], names=["key", "code", "links"])

    found = aligned.mapInArrow(add, f"{MEASURES}, n_best long, count_sum long")
    if not more:
        return found
    others = aligned.select("key", "codes", "links").mapInArrow(rest, "key binary, code long, links long").join(pairs, "code")
    others = others.groupBy("key").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    total = [(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return found.join(others, "key", "left").select(*names, *total)


def align_tokenisers(df: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``df``.

    A (byte-level) encodes a space and the text, B (pieces) the text, without special tokens. Offsets where tokens of
    both end cut them into groups; all A-B pairs of a group are links. A pair's count is the number of rows whose text
    holds it linked; ``n_best`` counts links whose pair is the most frequent of its A id, ``count_sum`` adds the counts.

    Equal texts are aligned once and weighted by their number; rows get their measures back by 128 bits of SHA-256. Texts
    that are null, empty or not given back byte by byte by both vocabularies have zeros and an empty ``groups_sha256``.
    Null ids and repeated rows stay; an empty table gives no rows; texts of any length are aligned whole; other columns
    are not read.
    """
    narrow, size_b = code_type(byte_path, piece_path), aligner(byte_path, piece_path).size_b
    aligned = stored(aligned_texts(df, byte_path, piece_path, text_column), "aligned")
    measures = with_counts(aligned, pair_counts(aligned, narrow, size_b), narrow)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = measures.select(F.col("key").alias("_key"), *[F.col(n).alias(f"_{n}") for n in [*numbers, "groups_sha256"]])
    own = df.select(df[id_column].alias("doc_id"), text_key(text_column).alias("key"))
    joined = own.join(measures, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", *[F.coalesce(f"_{n}", F.lit(0)).cast(T.LongType()).alias(n) for n in numbers], F.coalesce("_groups_sha256", F.lit("")).alias("groups_sha256"))
