"""Passages that an earlier document already has, found from word windows at the positions of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import lanes_for, text_of
from kinelane.llm.exchange import Spool, by_lane, census, deal, deal_stream, meet, read_with_answers, row_key, text_bytes, with_answers
from kinelane.llm.rolling import window_hashes, word_hashes

#: A null id comes after all others.
LAST = np.iinfo(np.int64).max
#: Bytes of text whose entries make a bucket or whose rows make a lane.
BUCKET_BYTES, LANE_BYTES = 24_000_000, 8_000_000
ANSWER = {"row": "i8", "at": "i4"}
ENTRY = {"key": "u8", "doc": "i8", "row": "i8", "at": "i4"}
CHECKED = {"key": "u8", "check": "u4", "doc": "i8", "row": "i8", "at": "i4"}


def difference_cover(period: int) -> np.ndarray:
    """Residues of which, for any shift, two differ by it: greedily, the residue that adds most differences."""
    chosen, have = [0, 1], {0, 1, period - 1}
    while len(have) < period:
        gain = {c: {(c - x) % period for x in chosen} | {(x - c) % period for x in chosen} for c in range(period) if c not in chosen}
        best = max(gain, key=lambda c: (len(gain[c] - have), -c))
        chosen.append(best)
        have |= gain[best]
    return np.array(sorted(chosen))


def cover_for(width: int) -> tuple[int, np.ndarray]:
    """Period and cover for windows of ``width`` words: anchors keep at least two fifths of the width.

    A perfect difference set of period q * q + q + 1 has q + 1 residues, the fewest that can be; those of q up to 5 are
    searched directly, other periods are covered greedily.
    """
    period = max(2, width * 3 // 5 + 1)
    for q in (5, 4, 3, 2):
        if q * q + q + 1 <= period:
            found = _perfect(q * q + q + 1, q + 1)
            if found is not None:
                return q * q + q + 1, found
    return period, difference_cover(period)


def _perfect(period: int, size: int) -> np.ndarray | None:
    def grow(chosen: list[int], have: set[int]) -> list[int] | None:
        if len(chosen) == size:
            return chosen
        for c in range(chosen[-1] + 1, period):
            new = [d for x in chosen for d in ((c - x) % period, (x - c) % period)]
            if len(set(new)) == len(new) and not have & set(new):
                found = grow([*chosen, c], have | set(new))
                if found:
                    return found
        return None

    found = grow([0], set())
    return np.array(found) if found else None


def anchors(hashes: np.ndarray, width: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover and the hashes of the anchor windows there."""
    size = width - period + 1
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = (np.arange(0, len(hashes) - size + 1, period)[:, None] + cover).ravel()
    at = at[at <= len(hashes) - size]
    return at, window_hashes(hashes, size, at)


def _many(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray] | None:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else None


def earlier_windows(texts: DataFrame, width: int, buckets: int, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Packed (row, at): the ``width``-word windows that start in a document with a smaller id as well.

    Second, the rows of ``texts`` by lane with the places of their shared anchors; rows without any hold no such window.

    1. Hash the anchor windows at cover positions; any two equal windows have an anchor at the same place in both.
    2. Keep anchors that two documents share; 3. extend: every window that holds one of them is hashed whole, and is
    the answer if the least document with that window is an earlier one.
    """
    period, cover = cover_for(width)
    reach = period - 1

    def anchor_entries(batch: pa.RecordBatch):
        parts = []
        for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc", "text")), strict=True):
            at, key = anchors(word_hashes(text.encode()), width, period, cover)
            parts.append({"key": key, "doc": np.full(len(at), doc), "row": np.full(len(at), row), "at": at.astype(np.int32)})
        return _many(parts)

    def shared_anchors(spool: Spool) -> Iterator[pa.RecordBatch]:
        found = census(spool, "doc")
        for chunk in spool.chunks():
            which = found.find(chunk["key"])
            keep = found.low[which] < found.high[which]
            if keep.any():
                yield by_lane({n: chunk[n][keep] for n in ANSWER}, ANSWER, lanes)

    packed_answer = "bucket int, row binary, at binary"
    shared = meet(deal(texts, anchor_entries, ENTRY, buckets), ENTRY, shared_anchors, packed_answer)

    def window_entries(batches: Iterator[pa.RecordBatch]):
        for batch, answers in read_with_answers(batches, ANSWER):
            parts = []
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc", "text")), strict=True):
                at = np.unique(answers.of(row)["at"])
                if not len(at):
                    continue
                hashes = word_hashes(text.encode())
                marks = np.zeros(len(hashes) - width + 2, np.int32)
                np.add.at(marks, np.clip(at - reach, 0, len(marks) - 1), 1)
                np.add.at(marks, np.minimum(at + 1, len(marks) - 1), -1)
                starts = np.flatnonzero(np.cumsum(marks[:-1]))
                parts.append({
                    "key": window_hashes(hashes, width, starts), "check": (window_hashes(hashes, width, starts, salt=1) >> np.uint64(32)).astype(np.uint32),
                    "doc": np.full(len(starts), doc), "row": np.full(len(starts), row), "at": starts.astype(np.int32),
                })
            yield _many(parts)

    def earlier(spool: Spool) -> Iterator[pa.RecordBatch]:
        found = census(spool, "doc")
        for chunk in spool.chunks():
            keep = found.low[found.find(chunk["key"], chunk["check"])] < chunk["doc"]
            if keep.any():
                yield by_lane({n: chunk[n][keep] for n in ANSWER}, ANSWER, lanes)

    together = with_answers(texts, shared, ANSWER, lanes)
    return meet(deal_stream(together, window_entries, CHECKED, buckets), CHECKED, earlier, packed_answer), together


def remove_earlier_passages(df: DataFrame, width: int = 50, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept`` with ``texts``): words inside no earlier window.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``width`` words that covers it also starts
    in a document with a smaller id, judged on the input. Ids are integers; a null id is later than all others, rows
    with the same id are not earlier than one another. Null text has no words; texts shorter than a window, an empty
    table and columns other than the two named change nothing.
    """
    kind = df.schema[id_column].dataType.simpleString()
    own = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    own = own.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), row_key("doc_id", "text").alias("row"), "text")
    size = text_bytes(own)
    buckets, lanes = lanes_for(size, BUCKET_BYTES), lanes_for(size, LANE_BYTES)
    found, together = earlier_windows(own.select("row", "doc", "doc_id", "text"), width, buckets, lanes)
    columns = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "string"}
    types = ", ".join(f"{n} {t}" for n, t in columns.items())
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def result(text: str, at: np.ndarray) -> tuple:
        words = text.encode().split()
        n = len(words)
        if len(at):
            marks = np.zeros(n + 1, np.int32)
            np.add.at(marks, np.unique(at), 1)
            np.add.at(marks, np.unique(at) + width, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
        kept = b" ".join(words)
        return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of rows without shared anchors; the others keep their text for the answers to come."""
        for batch, answers in read_with_answers(batches, ANSWER):
            raw = batch.column("text").to_pylist()
            waits = [len(answers.of(row)["at"]) > 0 for row in batch.column("row").to_pylist()]
            made = [(None,) * 4 if w else result(t, ()) for w, t in zip(waits, raw, strict=True)]
            text = pa.array([t if w else None for w, t in zip(waits, raw, strict=True)], pa.string())
            own = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), text, *own], names=["row", "doc_id", "text", *columns])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, answers in read_with_answers(batches, ANSWER):
            ready = list(zip(*(batch.column(n).to_pylist() for n in columns), strict=True))
            rows = zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), ready, strict=True)
            made = [r if text is None else result(text, answers.of(row)["at"]) for row, text, r in rows]
            own = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own], names=["doc_id", *columns])

    begun = together.mapInArrow(begin, f"row long, doc_id {kind}, text string, {types}")
    done = with_answers(begun, found, ANSWER, lanes).mapInArrow(finish, f"doc_id {kind}, {types}")
    return done if texts else done.drop("kept")
