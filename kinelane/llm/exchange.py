"""Packed exchange: fixed-width entries travel as arrays, one row per (batch, bucket), and meet by bucket.

A row of a table per entry would cost more than the entries themselves. Buckets are hashes of a key and their number
grows with the data, so that a bucket fits a task; what exceeds memory is spooled to the task's scratch file, which
goes with the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import small

#: Entries a task holds before it hands them on, and bytes of a bucket kept in memory.
FLUSH, IN_MEMORY = 600_000, 48_000_000

Fields = dict[str, str]  # name to numpy type; "key" comes first and is "u8"
Arrays = dict[str, np.ndarray]


def _packed(held: list[Arrays], fields: Fields, buckets: int, by: str) -> pa.RecordBatch:
    whole = {n: np.concatenate([h[n] for h in held]) for n in fields}
    bucket = ((whole[by].view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    columns = [pa.array(bucket[cuts])]
    for n, kind in fields.items():
        values = whole[n][order].astype(kind)
        columns.append(pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *fields])


def deal(df: DataFrame, make: Callable[[pa.RecordBatch], Arrays | None], fields: Fields, buckets: int, by: str = "key") -> DataFrame:
    """Entries that ``make`` finds in batches of ``df``, packed by the bucket of the 64-bit field ``by``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[Arrays | None]:
        for batch in batches:
            for part in small(batch):
                yield make(part)

    return deal_stream(df, stream, fields, buckets, by)


def deal_stream(
    df: DataFrame, stream: Callable[[Iterator[pa.RecordBatch]], Iterator[Arrays | None]], fields: Fields, buckets: int, by: str = "key"
) -> DataFrame:
    """The same for a generator over the batches of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in stream(batches):
            if found is not None and len(found[by]):
                held.append(found)
                n += len(found[by])
            if n >= FLUSH:
                yield _packed(held, fields, buckets, by)
                held, n = [], 0
        if held:
            yield _packed(held, fields, buckets, by)

    return df.mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in fields))


class Spool:
    """The packed rows of one bucket; may be read several times, whatever its size."""

    def __init__(self, fields: Fields):
        self.fields, self.rows, self.file = fields, [], tempfile.SpooledTemporaryFile(IN_MEMORY)  # noqa: SIM115
        self.entries = 0

    def add(self, blobs: list[bytes]) -> None:
        self.rows.append([len(b) for b in blobs])
        self.entries += len(blobs[0]) // np.dtype(next(iter(self.fields.values()))).itemsize
        for blob in blobs:
            self.file.write(blob)

    def chunks(self, entries: int = 1_000_000) -> Iterator[Arrays]:
        """Groups of packed rows of about ``entries`` entries."""
        self.file.seek(0)
        held, n = [], 0
        for sizes in self.rows:
            found = {name: np.frombuffer(self.file.read(size), kind) for (name, kind), size in zip(self.fields.items(), sizes, strict=True)}
            held.append(found)
            n += len(found[next(iter(self.fields))])
            if n >= entries:
                yield {k: np.concatenate([h[k] for h in held]) for k in self.fields}
                held, n = [], 0
        if held:
            yield {k: np.concatenate([h[k] for h in held]) for k in self.fields}

    def close(self) -> None:
        self.file.close()


def meet(packed: DataFrame, fields: Fields, work: Callable[[Spool], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """One shuffle by bucket; ``work`` sees the buckets one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, at = None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                bucket = columns[0][k].as_py()
                if bucket != at:
                    if spool is not None:
                        yield from work(spool)
                        spool.close()
                    spool, at = Spool(fields), bucket
                spool.add([c[k].as_buffer().to_pybytes() for c in columns[1:]])
        if spool is not None:
            yield from work(spool)
            spool.close()

    dealt = packed.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)


class Census:
    """Distinct (key, check) of a bucket with the number of entries and the least and greatest owner."""

    def __init__(self) -> None:
        self.keys, self.checks, self.n = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)
        self.low, self.high = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, checks: np.ndarray, owners: np.ndarray) -> None:
        ones = np.ones(len(owners), np.int64)
        keys, checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        order = np.lexsort((checks, keys)) if checks.any() else np.argsort(keys, kind="stable")
        keys, checks = keys[order], checks[order]
        if not len(keys):
            return
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]))
        self.n = np.add.reduceat(np.concatenate([self.n, ones])[order], cuts)
        self.low = np.minimum.reduceat(np.concatenate([self.low, owners])[order], cuts)
        self.high = np.maximum.reduceat(np.concatenate([self.high, owners])[order], cuts)
        self.keys, self.checks = keys[cuts], checks[cuts]

    def find(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Places of entries that were added."""
        at = np.searchsorted(self.keys, keys)
        while checks is not None and (other := self.checks[at] != checks).any():
            at[other] += 1
        return at


def census(spool: Spool, owner: str) -> Census:
    """Counts of a bucket; memory holds its distinct keys, not its entries."""
    out = Census()
    for chunk in spool.chunks():
        out.add(chunk["key"], chunk["check"] if "check" in chunk else np.zeros(len(chunk["key"]), np.uint32), chunk[owner])
    return out


def by_lane(found: Arrays, fields: Fields, lanes: int) -> pa.RecordBatch:
    """Answers packed for the lanes of the rows that they belong to."""
    return _packed([found], fields, lanes, "row")


def lane_of(row: F.Column, lanes: int) -> F.Column:
    """The lane of a row key, as ``_packed`` deals it."""
    return F.pmod(F.shiftrightunsigned(row, 24), F.lit(lanes)).cast("int")


def row_key(*columns: str) -> F.Column:
    """Equal rows have equal keys and, being equal, equal results."""
    return F.xxhash64(*columns)


class Answers:
    """What came back for the rows of one lane: field arrays by row key."""

    def __init__(self, fields: Fields, blobs: list[list[bytes]]):
        joined = {n: np.frombuffer(b"".join(b[i] for b in blobs), kind) for i, (n, kind) in enumerate(fields.items())}
        order = np.argsort(joined["row"], kind="stable")
        self.values = {n: v[order] for n, v in joined.items()}

    def of(self, row: int) -> Arrays:
        rows = self.values["row"]
        a, b = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
        return {n: v[a:b] for n, v in self.values.items()}


def with_answers(texts: DataFrame, answers: DataFrame, fields: Fields, lanes: int) -> DataFrame:
    """Rows of ``texts`` (which have ``row``) and packed answers together by lane, answers first."""
    blank = [F.lit(None).cast("binary").alias(n) for n in fields]
    own = [c for c in texts.columns]
    a = answers.select(F.col("bucket"), F.lit(0).alias("kind"), *[F.lit(None).cast(texts.schema[c].dataType).alias(f"t_{c}") for c in own], *[F.col(n).alias(f"a_{n}") for n in fields])
    t = texts.select(lane_of(F.col("row"), lanes).alias("bucket"), F.lit(1).alias("kind"), *[F.col(c).alias(f"t_{c}") for c in own], *[b.alias(f"a_{n}") for b, n in zip(blank, fields, strict=True)])
    return a.unionByName(t).repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")


def read_with_answers(batches: Iterator[pa.RecordBatch], fields: Fields) -> Iterator[tuple[pa.RecordBatch, Answers]]:
    """Small batches of text rows, each with the answers of its lane."""
    at, held, ready = None, [], None
    for batch in batches:
        names = batch.schema.names
        buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(buckets, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
        if not cuts or cuts[0] != 0:
            cuts = [0, *cuts]
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if buckets[a] != at:
                at, held, ready = buckets[a], [], None
            if kinds[a] == 0:
                columns = [part.column(names.index(f"a_{n}")) for n in fields]
                held += [[c[k].as_buffer().to_pybytes() for c in columns] for k in range(part.num_rows)]
            else:
                if ready is None:
                    ready = Answers(fields, held)
                    held = []
                texts = pa.RecordBatch.from_arrays(
                    [part.column(i) for i, n in enumerate(names) if n.startswith("t_")], names=[n[2:] for n in names if n.startswith("t_")]
                )
                for piece in small(texts):
                    yield piece, ready


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
