"""Near-duplicates by SuperMinHash signatures, banding, and verification on whole sets of word shingles."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelane.llm.common import lanes_for, small, stored, text_of
from kinelane.llm.components import components
from kinelane.llm.rolling import mix, window_hashes, word_hashes

#: Slots of a signature and slots of a band: two sets of similarity 0.8 miss each other in all 32 bands once in 2e7.
SLOTS, ROWS = 128, 4
#: Elements whose permutations are drawn together.
CHUNK = 50_000
#: A round of stars in which fewer of the compared pairs are links is the last; the rest is compared in tiles.
FRUITFUL = 0.1
#: Sets and bytes of sets of a tile.
TILE, TILE_BYTES = 256, 8_000_000
#: Links whose trees are built in one part.
TOGETHER = 500_000
_STEP, _DRAWN = 0x9E3779B97F4A7C15, np.uint64(24)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``size``-word shingles of a lower-cased (A-Z) text; fewer words make one."""
    words = word_hashes(text.encode().lower())
    if 0 < len(words) < size:
        return window_hashes(words, len(words), salt=size)
    return np.unique(window_hashes(words, size))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: a row of SLOTS numbers per set (not empty), rank in the high 24 bits.

    Every element draws one permutation of the slots. In round j it offers rank j and 40 random bits to the slot in
    place j, and a slot keeps the least offer. A set whose slots all hold ranks up to j is done: later offers are greater.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    part = (np.cumsum(sizes) - 1) // CHUNK
    for p in np.unique(part).tolist():
        rows = np.flatnonzero(part == p)
        _draw(np.concatenate([sets[k] for k in rows.tolist()]), np.repeat(np.arange(len(rows)), sizes[rows]), out[rows[0] : rows[-1] + 1])
    return out


def _draw(elements: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    flat = out.reshape(-1)
    places = np.empty((0, SLOTS), np.uint8)
    for j in range(SLOTS):
        draw = mix(elements + np.uint64(_STEP * (j + 1) % (1 << 64)))
        at = j + ((draw & np.uint64((1 << 24) - 1)) % np.uint64(SLOTS - j)).astype(np.int64)
        offer = np.uint64(j << 40) | (draw >> _DRAWN)
        own = np.arange(len(elements))
        slot = at if j == 0 else places[own, at].astype(np.int64)
        np.minimum.at(flat, owner * SLOTS + slot, offer)
        open_ = (out.max(axis=1) >> np.uint64(40)) > j
        left = open_[owner]
        if not left.any():
            return
        if j == 0:
            places = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(left.sum()), 1))
            places[np.arange(len(places)), at[left]] = 0
        else:
            places[own, at] = places[own, j]
            places = places[left]
        elements, owner = elements[left], owner[left]


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = found.reshape(len(found), -1, ROWS)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for r in range(ROWS):
        keys = mix((keys + np.uint64(_STEP)) ^ bands[:, :, r])
    return keys


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signed_sets(df: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, row, node, n_shingles, keys``: 128 bits of the shingle set, its size and its band keys; null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                sets = [shingle_set(t, size) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full)).view(np.int64).tolist()) if full else iter(())
                columns = [
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "row", "node", "n_shingles", "keys"])

    text = text_of(text_column)
    slim = df.select(df[id_column].alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    schema = T.StructType([T.StructField("doc_id", df.schema[id_column].dataType), *T.StructType.fromDDL("row long, node binary, n_shingles long, keys array<long>")])
    return slim.mapInArrow(run, schema)


def sets_of(df: DataFrame, wanted: DataFrame, size: int, text_column: str) -> DataFrame:
    """``node, set`` for the nodes of ``wanted`` (``node, row``), from the text of one row each; sets as packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                right = [k for k, (s, node) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if _digest(s) == node]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.array([sets[k].tobytes() for k in right], pa.binary())], names=["node", "set"])

    text = text_of(text_column)
    texts = df.select(F.xxhash64(text).alias("row"), text.alias("text")).join(wanted.select("row", "node"), "row")
    # Rows of equal text are one; a chance collision of the 64-bit row key leaves the text whose set is the node's.
    one = texts.groupBy("node", "text").agg(F.count("*").alias("copies"))
    return one.select("node", "text").mapInArrow(run, "node binary, set binary")


def _alike(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes with ``link``: whether their whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                links.append(bool(_alike(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.bool_())], names=["a", "b", "link"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, link boolean")


def _find(parent: dict[bytes, bytes], x: bytes) -> bytes:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def tile_links(table: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join what is alike among some sets of different roots, no more than a tree of them.

    Sets of the commonest root are compared with those of other roots only, not with one another.
    """
    nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
    commonest = max(roots, key=Counter(roots).__getitem__)
    others = np.array([k for k, r in enumerate(roots) if r != commonest], np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(np.arange(len(sets)), sizes)[order]
    common, begin = np.zeros((len(others), len(sets))), 0
    while begin < len(column):  # the sets as rows of ones, some thousand shingles at a time
        end = int(np.searchsorted(column, column[begin] + 8192))
        ones = np.zeros((len(sets), 8192), np.float32)
        ones[row[begin:end], column[begin:end] - column[begin]] = 1
        common += ones[others] @ ones.T
        begin = end
    parent = {r: r for r in roots}
    links = []
    for i, j in np.argwhere(_alike(common.astype(np.int64), sizes[others, None], sizes[None, :], percent)).tolist():
        one, other = _find(parent, roots[others[i]]), _find(parent, roots[j])
        if one != other:
            parent[one] = other
            links.append((nodes[others[i]], nodes[j]))
    return links


def compared_in_tiles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among the members (``key, node, n, root``) of each bucket; any two of different roots meet in a tile.

    The members of a bucket's commonest root, and those of all others, are dealt to tiles of bounded number and bytes of sets
    by a hash of the node. Each two tiles are a task, but for two of the commonest root, where nothing is left to find.
    """
    roots = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = roots.groupBy("key").agg(F.max(F.struct("c", "s", "root")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def tiles(count: F.Column, shingles: F.Column) -> F.Column:
        return F.ceil(F.greatest(count / TILE, shingles * 8 / TILE_BYTES)).cast("int")

    own, most = tiles(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")), tiles(F.col("most.c"), F.col("most.s"))
    sizes = sizes.select("key", F.col("most.root").alias("common"), own.alias("own"), most.alias("most"))
    dealt, turn = members.join(sizes, "key"), F.xxhash64("node")
    place = F.when(F.col("root") == F.col("common"), F.col("own") + F.pmod(turn, F.col("most"))).otherwise(F.pmod(turn, F.col("own"))).cast("int")
    upto = F.when(F.col("root") == F.col("common"), F.col("own")).otherwise(F.col("own") + F.col("most")) - 1
    dealt = dealt.select("key", "node", "root", place.alias("place"), F.explode(F.sequence(F.lit(0), upto)).alias("with"))
    dealt = dealt.select("key", F.least("place", "with").alias("i"), F.greatest("place", "with").alias("j"), "node", "root")

    def run(table: pa.Table) -> pa.Table:
        links = tile_links(table, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def grouped(links: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of ``links``: union-find within parts of bounded size, then rounds over the trees left.

    Links of one part are settled by its union-find alone; the root of a tree is its least node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, other = _find(parent, parent.setdefault(a, a)), _find(parent, parent.setdefault(b, b))
                parent[max(one, other)] = min(one, other)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([_find(parent, x) for x in nodes], pa.binary())], names=["node", "root"])

    parts = lanes_for(links.count(), TOGETHER)
    trees = links.repartition(parts).mapInArrow(run, "node binary, root binary")
    return trees if parts == 1 else components(trees.select(F.col("node").alias("a"), F.col("root").alias("b")))


def similar_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``node, root`` for the nodes of ``met`` (``key, node, n``) that links join; None without links.

    Nodes of a bucket that are similar are linked, or joined by links. In a round, every bucket whose members have different
    roots compares one of them with all members of other roots. Groups of copies close in a few rounds, for any member is
    similar to many. When a round finds few links, the members of the buckets still open are compared in tiles.
    """
    links = tested = roots = None
    turn = 0
    while True:
        own = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = stored(own.select("key", "node", "n", "root"), "bucket-roots") if roots is not None else own
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n", "root")).alias("centre")
        centres = own.groupBy("key").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key", "centre")
        pairs = own.join(centres, "key").filter("root != centre.root")
        pairs = pairs.filter(100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
        pairs = pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        judged = stored(verified(pairs, sets, percent), "judged")
        n, found = judged.agg(F.count("*"), F.count(F.when(F.col("link"), 1))).first()
        if found:
            new = judged.filter("link").select("a", "b")
            links = new if links is None else links.union(new)
            roots = stored(grouped(links), "roots")
        tested = judged.select("a", "b") if tested is None else tested.union(judged.select("a", "b"))
        turn += 1
        if found < max(1, FRUITFUL * n):
            break
    own = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else met.withColumn("root", F.col("node"))
    own = stored(own.select("key", "node", "n", "root"), "bucket-roots")
    open_ = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    rest = stored(compared_in_tiles(own.join(open_, "key", "left_semi"), sets, percent), "tile-links")
    if not rest.isEmpty():
        roots = stored(grouped(rest if links is None else links.union(rest)), "roots")
    return roots


def near_duplicate_sets(df: DataFrame, shingle: int = 2, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``df``.

    Rows whose sets of ``shingle``-word shingles (64-bit hashes) have ``100 * common >= percent * all`` are linked;
    ``component_id`` is the least id reachable, and the row that has it is ``kept``. Equal sets are one node. Different sets
    meet in 32 bands of SuperMinHash slots (for ``percent`` of 80 or more) and are linked after a comparison of the whole
    sets only.

    Null and empty texts and texts without words have no shingles and are linked with nothing: their component is their own
    id. Null ids stay, get the least id of their component (null if there is none, and then they are kept); repeated
    rows repeat; an empty table gives no rows; other columns are not read.
    """
    own = stored(signed_sets(df, shingle, id_column, text_column), "sets")
    nodes = own.filter("node is not null").groupBy("node", "n_shingles", "keys").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    nodes = stored(nodes, "nodes")
    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    met = stored(entries.join(shared, "key").select("key", "node", "n"), "met")
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", "row")
    roots = similar_links(met, stored(sets_of(df, wanted, shingle, text_column), "whole-sets"), percent)
    if roots is not None:
        labelled = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        labelled = labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    else:
        labelled = nodes.select("node", F.col("least").alias("component"))
    joined = own.join(stored(labelled, "components").withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    return joined.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
