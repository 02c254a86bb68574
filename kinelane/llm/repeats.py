"""Repeated byte strings of any documents, found by suffix arrays of shards that share a sampled anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import lanes_for, text_of
from kinelane.llm.exchange import Arrays, Spool, by_lane, deal, deal_stream, meet, read_with_answers, row_key, text_bytes, with_answers
from kinelane.llm.rolling import SEGMENT, byte_windows
from kinelane.llm.suffixes import SEPARATOR, suffix_array

#: Bytes hashed for an anchor; bytes of text that make a bucket of anchors, a bucket of stretches, a lane.
GRAM = 64
BUCKET_BYTES, SHARD_BYTES, LANE_BYTES = 96_000_000, 8_000_000, 8_000_000
#: Bytes sorted together, and stretches of one anchor beyond which its windows are counted one by one instead. A sort
#: holds some fifty times its bytes, so only an anchor that is larger by itself goes beyond SORTED.
SORTED, HOT = 500_000, 10_000
#: Bytes of stretches, and windows, that a task holds before it hands them on.
HELD_BYTES, HELD_WINDOWS = 12_000_000, 250_000

#: A stretch: ``starts`` consecutive window starts from ``at`` on whose windows have the same anchor.
STRETCH = {"key": "u8", "row": "i8", "at": "i4", "starts": "i4"}
SHARED = {"row": "i8", "at": "i4", "starts": "i4", "hot": "i1"}
FOUND = {"row": "i8", "at": "i4", "starts": "i4"}
TEXTS = {"key": "u8", "row": "i8", "at": "i4", "starts": "i4", "whole": "u8", "text": "u1"}


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` consecutive values, the first of equals, from blockwise minima.

    Values are compared by their high 44 bits; the low bits hold the position, which a segment leaves room for.
    """
    n, mask = len(values) - width + 1, np.uint64((1 << 20) - 1)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def stretches(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts) of all windows of a text, read in segments.

    The anchor of a window is the least hash among the grams inside it, the first of equals: equal windows have equal
    anchors at equal distances from their starts, so that no two windows of one stretch are equal.
    """
    grams = width - GRAM + 1
    keys, firsts, counts = [], [], []
    for begin in range(0, len(raw) - width + 1, SEGMENT):
        part = raw[begin : begin + SEGMENT + width - 1]
        hashes = byte_windows(part, GRAM)
        anchor = _least_ahead(hashes, grams)
        cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        keys.append(hashes[anchor[cuts]])
        firsts.append(cuts + begin)
        counts.append(np.diff(np.append(cuts, len(anchor))))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def _intervals(rows: np.ndarray, at: np.ndarray) -> Arrays:
    """Window starts as runs of consecutive ones."""
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)])) if len(rows) else np.empty(0, np.int64)
    return {"row": rows[cuts], "at": at[cuts].astype(np.int32), "starts": np.diff(np.append(cuts, len(rows))).astype(np.int32)}


def repeated_starts(texts: list[bytes], starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text, which of its first ``starts`` windows are found in another place of these texts too."""
    whole = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    places, prefixes = suffix_array(whole, width)
    same = np.flatnonzero(prefixes >= width)
    marked = np.zeros(len(whole), bool)
    marked[places[same]] = True
    marked[places[same - 1]] = True
    ends = np.cumsum([len(t) + 1 for t in texts])
    return [np.flatnonzero(marked[e - len(t) - 1 :][:n]) for e, t, n in zip(ends.tolist(), texts, starts.tolist(), strict=True)]


def _judge(entries: Arrays, text_of_entry, width: int) -> Iterator[Arrays]:
    """Repeated windows of the stretches of some anchors; ``text_of_entry`` gives the bytes of an entry."""
    key, whole, starts = entries["key"], entries["whole"], entries["starts"]
    order = np.lexsort((whole, key))
    k, w = key[order], whole[order]
    cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]))
    sizes = np.diff(np.append(cuts, len(k)))
    copies = order[np.repeat(sizes > 1, sizes)]  # found elsewhere as a whole
    yield {n: entries[n][copies] for n in FOUND}
    anchor = k[cuts]
    alone = sizes == 1
    bounds = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor)).tolist()
    # Every different text of an anchor is sorted, if any of them is not settled yet.
    held: list[tuple[int, bool]] = []
    size = 0

    def sort_held() -> Arrays:
        chosen = [e for e, _ in held]
        found = repeated_starts([text_of_entry(e) for e in chosen], starts[chosen], width)
        rows = [np.full(len(offsets), entries["row"][e]) for (e, still), offsets in zip(held, found, strict=True) if still]
        places = [entries["at"][e] + offsets for (e, still), offsets in zip(held, found, strict=True) if still]
        return _intervals(np.concatenate(rows), np.concatenate(places))

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < 2 or not alone[a:b].any():
            continue
        mine = order[cuts[a:b]]
        more = int(starts[mine].sum()) + width * len(mine)
        if held and size + more > SORTED:
            yield sort_held()
            held, size = [], 0
        held += zip(mine.tolist(), alone[a:b].tolist(), strict=True)
        size += more
    if held:
        yield sort_held()


def _packed_texts(parts: list[dict], buckets: int) -> pa.RecordBatch:
    """Stretches with their bytes, a row for each bucket."""
    whole = {n: np.concatenate([p[n] for p in parts]) for n in TEXTS if n != "text"}
    texts = [t for p in parts for t in p["text"]]
    bucket = ((whole["key"] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    groups = [order[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
    columns = [pa.array(bucket[order][cuts])]
    for n, kind in TEXTS.items():
        blobs = [b"".join([texts[e] for e in g.tolist()]) for g in groups] if n == "text" else [whole[n][g].astype(kind).tobytes() for g in groups]
        columns.append(pa.array(blobs, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *TEXTS])


def remove_repeats(df: DataFrame, width: int = 400, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``df``; with ``texts`` also ``kept``, the text that
    is left, without the remains of characters that a removal cuts.

    Every byte goes that a string of ``width`` bytes covers which also starts anywhere else, in the same document or
    another; strings overlap and are judged on the input. Null text is empty; repeated rows are copies of one another;
    null ids stay; texts shorter than the width, an empty table and other columns change nothing.

    1. Windows are grouped into stretches by anchor, and anchors with one stretch only are done. 2. Stretches meet by
    anchor; equal ones are copies, the others of the anchor are sorted by ``suffix_array`` and repeat where the common
    prefix of neighbours reaches the width. 3. Where an anchor has over HOT stretches, its windows are dealt by their
    own hash and counted, so that no task gets them all.
    """
    kind = df.schema[id_column].dataType.simpleString()
    own = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    own = own.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    size = text_bytes(own)
    buckets, shards, lanes = lanes_for(size, BUCKET_BYTES), lanes_for(size, SHARD_BYTES), lanes_for(size, LANE_BYTES)

    def stretch_entries(batch: pa.RecordBatch) -> Arrays:
        parts = []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key, at, n = stretches(text.encode(), width)
            parts.append((key, np.full(len(key), row, np.int64), at, n))
        return {n: np.concatenate(c) for n, c in zip(STRETCH, zip(*parts, strict=True), strict=True)}

    def shared(spool: Spool) -> Iterator[pa.RecordBatch]:
        counted: dict[str, np.ndarray] = {"keys": np.empty(0, np.uint64), "n": np.empty(0, np.int64)}
        for chunk in spool.chunks():
            keys, n = np.unique(np.concatenate([counted["keys"], chunk["key"]]), return_inverse=True)
            weight = np.concatenate([counted["n"], np.ones(len(chunk["key"]), np.int64)])
            counted = {"keys": keys, "n": np.bincount(n, weight, len(keys)).astype(np.int64)}
        for chunk in spool.chunks():
            n = counted["n"][np.searchsorted(counted["keys"], chunk["key"])]
            keep = n > 1
            if keep.any():
                yield by_lane({**{f: chunk[f][keep] for f in FOUND}, "hot": (n[keep] > HOT).astype(np.int8)}, SHARED, lanes)

    first = meet(deal(own.select("row", "text"), stretch_entries, STRETCH, buckets), STRETCH, shared, _blobs(SHARED))
    together = with_answers(own, first, SHARED, lanes)

    def stretch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, answers in read_with_answers(batches, SHARED):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = answers.of(row)
                cold = mine["hot"] == 0
                if not cold.any():
                    continue
                raw = text.encode()
                key, at, n = stretches(raw, width)
                chosen = np.flatnonzero(np.isin(at, mine["at"][cold]))
                pieces = [raw[a : a + k - 1 + width] for a, k in zip(at[chosen].tolist(), n[chosen].tolist(), strict=True)]
                digest = np.array([int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") for p in pieces], np.uint64)
                parts.append({"key": key[chosen], "row": np.full(len(chosen), row, np.int64), "at": at[chosen], "starts": n[chosen], "whole": digest, "text": pieces})
                held += sum(map(len, pieces))
                if held > HELD_BYTES:
                    yield _packed_texts(parts, shards)
                    parts, held = [], 0
        if parts:
            yield _packed_texts(parts, shards)

    def judge(spool: Spool) -> Iterator[pa.RecordBatch]:
        chunks = list(spool.chunks(entries=1 << 60))
        whole = chunks[0]
        ends = np.cumsum(whole["starts"].astype(np.int64) + width - 1)
        raw = whole["text"]
        def bytes_of(e: int) -> bytes:
            return raw[ends[e] - whole["starts"][e] - width + 1 : ends[e]].tobytes()

        for found in _judge(whole, bytes_of, width):
            if len(found["row"]):
                yield by_lane(found, FOUND, lanes)

    cold = meet(together.mapInArrow(stretch_texts, "bucket int, " + ", ".join(f"{n} binary" for n in TEXTS)), TEXTS, judge, _blobs(FOUND))

    def hot_windows(batches: Iterator[pa.RecordBatch]):
        parts, held = [], 0
        for batch, answers in read_with_answers(batches, SHARED):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = answers.of(row)
                warm = mine["hot"] == 1
                if not warm.any():
                    continue
                raw = text.encode()
                for a, n in zip(mine["at"][warm].tolist(), mine["starts"][warm].tolist(), strict=True):
                    hashes = byte_windows(raw[a : a + n - 1 + width], width)
                    parts.append((hashes, np.full(n, row, np.int64), np.arange(a, a + n, dtype=np.int32), np.ones(n, np.int32)))
                    held += n
                    if held >= HELD_WINDOWS:
                        yield {f: np.concatenate(c) for f, c in zip(STRETCH, zip(*parts, strict=True), strict=True)}
                        parts, held = [], 0
        if parts:
            yield {f: np.concatenate(c) for f, c in zip(STRETCH, zip(*parts, strict=True), strict=True)}

    def hot_repeats(spool: Spool) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for chunk in spool.chunks():
            keys, which = np.unique(np.concatenate([keys, chunk["key"]]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n, np.ones(len(chunk["key"]), np.int64)]), len(keys)).astype(np.int64)
        for chunk in spool.chunks():
            keep = n[np.searchsorted(keys, chunk["key"])] > 1
            if keep.any():
                yield by_lane({f: chunk[f][keep] for f in FOUND}, FOUND, lanes)

    hot = meet(deal_stream(together, hot_windows, STRETCH, buckets), STRETCH, hot_repeats, _blobs(FOUND))
    return _finish(together, cold.unionByName(hot), width, lanes, kind, texts)


def _blobs(fields: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in fields)


def _result(text: str, at: np.ndarray, starts: np.ndarray, width: int, texts: bool) -> tuple:
    raw = text.encode()
    n, spans, kept = len(raw), 0, raw
    if len(at):
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, at.astype(np.int64), 1)
        np.add.at(marks, at.astype(np.int64) + starts + width - 1, -1)
        gone = np.cumsum(marks[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if texts else None


def _finish(together: DataFrame, found: DataFrame, width: int, lanes: int, kind: str, texts: bool) -> DataFrame:
    """Results per row: at once for rows without shared stretches, for the others when the answers are there."""
    columns = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string"}
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    types = ", ".join(f"{n} {t}" for n, t in columns.items())
    none = np.empty(0, np.int64)

    def made(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, answers in read_with_answers(batches, SHARED):
            raw = batch.column("text").to_pylist()
            waits = [len(answers.of(row)["at"]) > 0 for row in batch.column("row").to_pylist()]
            rows = [(None,) * 5 if w else _result(t, none, none, width, texts) for w, t in zip(waits, raw, strict=True)]
            text = pa.array([t if w else None for w, t in zip(waits, raw, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), text, *made(rows)], names=["doc_id", "row", "text", *columns])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, answers in read_with_answers(batches, FOUND):
            ready = list(zip(*(batch.column(n).to_pylist() for n in columns), strict=True))
            rows = []
            for row, text, done in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), ready, strict=True):
                mine = answers.of(row)
                rows.append(done if text is None else _result(text, mine["at"], mine["starts"], width, texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made(rows)], names=["doc_id", *columns])

    begun = together.mapInArrow(begin, f"doc_id {kind}, row long, text string, {types}")
    done = with_answers(begun, found, FOUND, lanes).mapInArrow(finish, f"doc_id {kind}, {types}")
    return done if texts else done.drop("kept")
