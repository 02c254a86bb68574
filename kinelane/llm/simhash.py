"""Near-duplicates by SimHash: fingerprints meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import arrow_pass, lanes_for, stored, text_of
from kinelane.llm.components import components
from kinelane.llm.exchange import Spool, deal, meet

#: Text hashed at a time, and shingles whose bits are counted at a time.
SEGMENT, COUNTED = 1 << 20, 1 << 15
#: Different fingerprints whose replicas make a bucket; members of one anchor compared in one task.
BUCKET_PRINTS, TILE = 40_000, 20_000


def shingle_bits(raw: bytes, size: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each of the 64 bits, and how many shingles there are; any length of text."""
    import xxhash

    digest = xxhash.xxh64_digest
    ones, n, at, carried = np.zeros(64, np.int64), 0, 0, b""
    total = 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = (carried + b" " + raw[at:end]).split()
        total += len(words) - len(carried.split())
        at = end
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.zeros(len(words), np.int64)
        np.cumsum(lengths[:-1] + 1, out=starts[1:])
        ends = (starts + lengths)[size - 1 :].tolist()
        for k in range(0, len(ends), COUNTED):
            made = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[k : k + COUNTED].tolist(), ends[k : k + COUNTED])])
            ones += np.unpackbits(np.frombuffer(made, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(ends)
        carried = b" ".join(words[-(size - 1) :]) if size > 1 else b""
    if not n and total:
        ones += np.unpackbits(np.frombuffer(digest(b" ".join(raw.split()), 42), np.uint8)).astype(np.int64)
        n = 1
    return ones, n


def fingerprint(text: str, size: int = 3) -> int:
    """A bit is 1 if set in over half the hashes of the word shingles, repeats included; no words: 0."""
    ones, n = shingle_bits(text.encode().lower(), size)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


# The Hamming code of length 31: perfect, covering radius 1. Bit i of a word stands at position i + 1; the exclusive or
# of the positions of its ones is the syndrome, 0 for code words.
LENGTH, RADIUS = 31, 1
_POSITION_BITS = np.array([sum(1 << i for i in range(LENGTH) if (i + 1) >> k & 1) for k in range(5)], np.uint64)
_UNIT = np.array([0] + [1 << i for i in range(LENGTH)], np.uint64)


def anchors(halves: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Code words within RADIUS + ``threshold`` (1 or less) of each 31-bit word: (index of the word, code word)."""
    syndrome = np.zeros(len(halves), np.int64)
    for k, mask in enumerate(_POSITION_BITS):
        syndrome |= (np.bitwise_count(halves & mask).astype(np.int64) & 1) << k
    index, code = [np.arange(len(halves))], [halves ^ _UNIT[syndrome]]
    if threshold:
        # Two flips whose positions have the syndrome as their exclusive or: each pair once; none from a code word.
        for first in range(1, LENGTH + 1):
            second = syndrome ^ first
            at = np.flatnonzero((syndrome > 0) & (second > first))
            index.append(at)
            code.append(halves[at] ^ _UNIT[first] ^ _UNIT[second[at]])
    return np.concatenate(index), np.concatenate(code)


REPLICA = {"key": "u8", "print": "u8"}


def replicas(prints: np.ndarray, distance: int) -> dict[str, np.ndarray]:
    """Every print at every anchor of its parts.

    The 64 bits are two parts of 32. Prints within ``distance`` bits are within ``distance // 2`` in one part, so each
    part is covered by itself: an anchor within the covering radius of one print's part is within radius plus that
    threshold of the other's. 31 bits of a part are coded; the last bits only take part in the final comparison.
    """
    keys, found = [], []
    for part in (0, 1):
        half = (prints >> np.uint64(32 * part)) & np.uint64((1 << LENGTH) - 1)
        index, code = anchors(half, distance // 2)
        keys.append(code << np.uint64(1) | np.uint64(part))
        found.append(prints[index])
    return {"key": np.concatenate(keys), "print": np.concatenate(found)}


def _spread(key: np.ndarray) -> np.ndarray:
    from kinelane.llm.rolling import mix

    return mix(key)


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly the members (different prints) that steps of at most ``distance`` bits connect.

    Members leave the list once reached, so a dense group costs little more than one comparison with each member.
    """
    links, rest = [], members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        reached = [root]
        while reached and len(rest):
            near = np.bitwise_count(rest ^ reached.pop()) <= distance
            if near.any():
                new = rest[near]
                links += [(int(root), int(x)) for x in new.tolist()]
                reached += list(new)
                rest = rest[~near]
    return links


def _group_links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """Links within groups of equal keys, and the groups too large for one task."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(cuts, len(keys)))
    links, large = [], []
    # Groups of up to 8 members by shifting the whole column against itself, larger ones one by one.
    few = np.repeat(sizes <= 8, sizes)
    for shift in range(1, 8):
        same = (keys[shift:] == keys[:-shift]) & few[shift:]
        near = np.flatnonzero(same & (np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= distance))
        links += zip(prints[near].tolist(), prints[near + shift].tolist(), strict=True)
    for k in np.flatnonzero(sizes > 8).tolist():
        members = prints[cuts[k] : cuts[k] + sizes[k]]
        if sizes[k] > TILE:
            large.append((int(keys[cuts[k]]), members))
        else:
            links += forest(members, distance)
    return links, large


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def near_links(prints: DataFrame, distance: int, buckets: int) -> DataFrame:
    """``a, b``: links between different prints (column ``print``, 64-bit) that join all prints within ``distance``.

    Groups of over TILE members are not compared where they meet: they are handed on in tiles, and every pair of tiles
    is a task of its own.
    """

    def entries(batch: pa.RecordBatch):
        found = replicas(batch.column("print").to_numpy().view(np.uint64), distance)
        return {"key": _spread(found["key"]), "print": found["print"]}

    def compare(spool: Spool) -> Iterator[pa.RecordBatch]:
        chunks = list(spool.chunks())
        links, large = _group_links(np.concatenate([c["key"] for c in chunks]), np.concatenate([c["print"] for c in chunks]), distance)
        a, b = [x for x, _ in links], [y for _, y in links]
        empty = pa.array([None] * len(a), pa.binary())
        yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), empty, empty], names=names)
        for _, members in large:
            tiles = [members[i : i + TILE].tobytes() for i in range(0, len(members), TILE)]
            for i in range(len(tiles)):
                for j in range(i, len(tiles)):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([tiles[i]], pa.binary()), pa.array([tiles[j]], pa.binary())], names=names)

    def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                members = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other)]))
                links = forest(members, distance)
                yield pa.RecordBatch.from_arrays([_signed([x for x, _ in links]), _signed([y for _, y in links])], names=["a", "b"])

    names = ["a", "b", "tile", "other"]
    met = stored(meet(deal(prints, entries, REPLICA, buckets), REPLICA, compare, "a long, b long, tile binary, other binary"), "met")
    tiled = met.filter(F.col("tile").isNotNull()).select("tile", "other")
    spread = tiled.repartition(F.xxhash64("tile", "other"))
    return met.filter(F.col("tile").isNull()).select("a", "b").union(spread.mapInArrow(compare_tiles, "a long, b long"))


def fingerprints(df: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, print``: the 64-bit fingerprint of each row as a signed number."""

    def work(rows: dict[str, list]) -> dict[str, object]:
        found = np.array([fingerprint(t, shingle) for t in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "print": pa.array(found.view(np.int64))}

    kind = df.schema[id_column].dataType.simpleString()
    return arrow_pass(df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text")), work, f"doc_id {kind}, print long")


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``df``.

    Fingerprints at ``distance`` (at most 3) or fewer differing bits are linked; ``component_id`` is the least id
    reachable. Null and empty texts have fingerprint zero and are linked like any other. Null ids keep their row and do
    not become a component's id unless it has no other; repeated rows repeat; an empty table gives no rows; other
    columns are not read.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two parts with a code of radius 1 serve distances of 0 to 3 bits")
    own = stored(fingerprints(df, shingle, id_column, text_column), "prints")
    least = stored(own.groupBy("print").agg(F.min("doc_id").alias("least")), "least")
    links = near_links(least.select("print"), distance, lanes_for(least.count(), BUCKET_PRINTS))
    roots = stored(components(links), "roots")
    labelled = least.join(roots, least["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = labelled.join(smallest, "root").select("print", "component_id")
    return own.join(ids, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
