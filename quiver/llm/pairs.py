"""From signatures to components: neighbours in sorted order, confirmed links, distributed union-find, crowded regions.

Everything here works on tables of long ids. First candidates come from neighbours in a range-partitioned sort, which
splits a region of any size over many tasks. Regions of which that leaves pairs out are then compared whole, as far as
their rows aren't in one component yet: block against block, so that neither a task nor the driver holds a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.common import arrow_rows, partitions_for, sorted_distinct, written

#: Most bits of a filter that a driver sends to all tasks: 8 MB whatever the input.
BLOOM_BITS = 1 << 26

#: Rows of a sorted order that a task looks at together.
BLOCK_ROWS = 1 << 15

#: Links that a task joins by itself.
LINK_ROWS = 200_000

#: Rows, and bytes of their items, in one of the two blocks of a crowded region that a task compares.
BLOCK_ITEMS = 2000
BLOCK_BYTES = 8 << 20

#: A value that more rows of two blocks share is counted by a matrix product, others pair by pair.
FEW_HOLDERS = 16

#: Rows of a block that are compared with the rows of another at once.
TILE = 500

#: Values of a tile's candidate pairs that are sorted pair by pair; beyond, products count all pairs of the tile.
FEW_VALUES = 20_000_000

#: Bits of the bitmaps by which most pairs of unlike sets are told apart: four a value, within these bounds.
MAP_BITS = (1 << 9, 1 << 16)


@dataclass(frozen=True)
class NeighbourParams:
    """Which neighbours in one sorted order become candidates."""

    depth: int  # leading 32-bit units that two rows must share at least
    width: int = 8  # how many following rows a row meets; regions up to this size are met whole
    always: int = 2  # of those, how many need no more than the least depth in a crowded region
    percent: int | None = None  # least similarity, which bounds the ratio of two sets' sizes, if rows have them
    most_unlike: int | None = None  # bits of the sketches that may differ
    rows_per_partition: int = 400_000


def pair_schema() -> T.StructType:
    return T.StructType([T.StructField(x, T.LongType()) for x in ("a", "b")])


class Crowds:
    """Which rows of a sorted partition are in a region that their neighbours don't cover.

    Those of more than ``width`` rows, and the first and the last one, which other partitions may have rows of.
    """

    def __init__(self, width: int):
        self.width = width
        self.hot = True  # whether the rows of the region that is still open have been given out
        self.region, self.waiting = None, np.zeros(0, np.int64)

    def add(self, regions: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Regions and ids that are known to be crowded by now."""
        before = self.region
        if len(self.waiting):
            regions = np.concatenate([np.full(len(self.waiting), before, regions.dtype), regions])
            ids = np.concatenate([self.waiting, ids])
        start = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1]]))
        size = np.diff(np.append(start, len(regions)))
        hot = size > self.width
        hot[0] |= self.hot and (before is None or before == regions[0])
        self.region, self.hot = regions[-1], bool(hot[-1])
        self.waiting = ids[:0] if self.hot else ids[start[-1] :]
        mask = np.repeat(hot, size)
        return regions[mask], ids[mask]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(self.waiting), self.region if len(self.waiting) else 0, np.uint64), self.waiting


def region_of(units: np.ndarray, depth: int) -> np.ndarray:
    """A hash of each row's first ``depth`` units; of two units it is the units themselves."""
    out = np.zeros(len(units), np.uint64)
    for k in range(depth):
        if k > 1:
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out = (out << np.uint64(32) | units[:, k]) if k < 2 else out + units[:, k]
    return out


def neighbour_rows(rows: DataFrame, n_rows: int, keys: list[str], params: NeighbourParams) -> DataFrame:
    """Pairs (a < b) of rows near each other in the order of ``keys`` (longs of two 32-bit units each), region null.

    And, with b null, the rows a of the regions (of ``depth`` equal units) in which such pairs aren't all pairs.

    ``rows`` has the keys, id, with ``percent`` the set's size, with ``most_unlike`` the sketch s1, s2. A row meets the rows that follow it
    while they share at least ``depth`` units; where more than ``width`` rows do, the depth asked for grows to one at
    which fewer than ``width`` remain, so crowded regions are cut finer than thin ones. Ranges of the sort are tasks;
    regions at the border of two ranges are taken for crowded. Which rows of equal keys follow each other is left open,
    so the result has to be written before it is read twice. See ``candidate_pairs`` and ``crowded_rows``.
    """
    sketch = ["s1", "s2"] if params.most_unlike is not None else []
    longs_of = ["id", "size"] if params.percent is not None else ["id"]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("a", "b", "region")])
    n = partitions_for(rows.sparkSession, n_rows, params.rows_per_partition)
    ordered = rows.repartitionByRange(n, *keys, "id").sortWithinPartitions(*keys)
    width = params.width

    def emit(c: dict[str, np.ndarray], stop: int) -> pa.RecordBatch:
        """Pairs of each row before ``stop`` with those that follow it."""
        units, total = c["units"], len(c["id"])

        def shared(i: np.ndarray, j: int) -> np.ndarray:
            return np.logical_and.accumulate(units[i] == units[i + j], axis=1).sum(1)

        # prefixes only get shorter further away: what doesn't share enough with the next row is done
        near = np.arange(min(stop, total - 1))
        near = near[(units[near, : params.depth] == units[near + 1, : params.depth]).all(1)]
        last = near[near + width < total]
        asked = np.full(stop, params.depth, np.int64)
        deep = shared(last, width)
        asked[last[deep >= params.depth]] = deep[deep >= params.depth] + 1
        left, right = [], []
        for j in range(1, width + 1):
            near = near[near + j < total]
            depth = shared(near, j)
            near, depth = near[depth >= params.depth], depth[depth >= params.depth]
            i = near if j <= params.always else near[depth >= asked[near]]
            fine = c["id"][i] != c["id"][i + j]
            if params.percent is not None:
                x, y = c["size"][i], c["size"][i + j]
                fine &= 100 * np.minimum(x, y) >= params.percent * np.maximum(x, y)
            if sketch:
                unlike = sum(np.bitwise_count(c[s][i] ^ c[s][i + j]).astype(np.int64) for s in sketch)
                fine &= unlike <= params.most_unlike
            left.append(c["id"][i[fine]])
            right.append(c["id"][i[fine] + j])
        a, b = np.concatenate(left), np.concatenate(right)
        columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def crowd(regions: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(regions.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The same rows in larger blocks."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        crowds = Crowds(width)
        for block in gathered(batches):
            new = {x: block.column(x).to_numpy() for x in longs_of}
            new |= {x: block.column(x).to_numpy().view(np.uint64) for x in sketch}
            longs = np.stack([block.column(x).to_numpy().view(np.uint64) for x in keys], 1)
            units = np.stack([longs >> np.uint64(32), longs & np.uint64(0xFFFFFFFF)], 2).astype(np.uint32)
            new["units"] = units.reshape(len(longs), -1)
            yield crowd(*crowds.add(region_of(new["units"], params.depth), new["id"]))
            kept = {x: np.concatenate([kept[x], new[x]]) for x in new} if kept else new
            stop = len(kept["id"]) - width
            if stop > 0:
                yield emit(kept, stop)
                kept = {x: v[stop:] for x, v in kept.items()}
        if kept:
            yield emit(kept, len(kept["id"]))
            yield crowd(*crowds.end())

    return ordered.select(*keys, *longs_of, *sketch).mapInArrow(run, schema)


def candidate_pairs(met: DataFrame) -> DataFrame:
    """The pairs (a, b, votes) of ``neighbour_rows``; votes: in how many orders a pair met."""
    return met.filter(F.col("b").isNotNull()).groupBy("a", "b").agg(F.count("*").alias("votes"))


def crowded_rows(met: DataFrame) -> DataFrame:
    """The rows (id, region) of ``neighbour_rows`` whose regions are to be compared whole."""
    return met.filter(F.col("b").isNull()).select(F.col("a").alias("id"), "region")


# -- a filter of bounded size


def bloom(keys: DataFrame, column: str, n_keys: int) -> np.ndarray:
    """Words of a Bloom filter over a column of hashed longs: 16 bits a key as far as BLOOM_BITS go.

    A filter that is too small for its keys passes more rows on; what it passes is looked up exactly.
    """
    bits = min(BLOOM_BITS, 1 << max(16, (16 * n_keys - 1).bit_length()))
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(bits - 1))
    at = keys.select(F.explode(F.array(low, high)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each hashed long may be in the filter; never wrong about one that is."""
    k, last = keys.view(np.uint64), np.uint64((len(words) << 6) - 1)
    low, high = k & last, (k >> np.uint64(32)) & last
    six, rest, one = np.uint64(6), np.uint64(63), np.uint64(1)
    return ((words[low >> six] >> (low & rest)) & (words[high >> six] >> (high & rest)) & one) == one


# -- union-find


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find of one partition's links: each node with the smallest id that it reaches there."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (nxt := up.setdefault(root, root)) != root:
            root = nxt
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if find(x) != x]
    columns = [pa.array(nodes, pa.int64()), pa.array([up[x] for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["hi", "lo"])


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node that links join to a smaller id; root: the smallest id that it reaches.

    Each task of about LINK_ROWS links first joins its own. Then, round by round, every node hooks to its smallest neighbour,
    chains of hooks are halved until all point at a root, and the links are drawn between roots. The links that are
    left fall at least by half each round; a round's tables are written, so lost executors cost one round at most.
    """
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("hi", "lo")])
    links = written(links.select("a", "b"), f"{name}-given")
    n = partitions_for(links.sparkSession, links.count(), LINK_ROWS)
    dealt = links.repartition(n) if n > 1 else links.coalesce(1)
    left = written(dealt.mapInArrow(_local_forest, schema).distinct(), f"{name}-links")
    levels: list[DataFrame] = []
    while True:
        hooks = written(left.groupBy("hi").agg(F.min("lo").alias("up")), f"{name}-hooks")
        if hooks.isEmpty():
            break
        while True:
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            jumped = hooks.join(above, "up", "left").select(
                "hi", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
            )
            jumped = written(jumped, f"{name}-jumps")
            hooks = jumped.select("hi", "up")
            if jumped.filter("moved").isEmpty():
                break
        levels.append(hooks)
        root = lambda c: hooks.select(F.col("hi").alias(c), F.col("up").alias(f"{c}_root"))  # noqa: B023, E731
        drawn = left.join(root("hi"), "hi", "left").join(root("lo"), "lo", "left")
        x, y = F.coalesce("hi_root", "hi"), F.coalesce("lo_root", "lo")
        drawn = drawn.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
        left = written(drawn.distinct(), f"{name}-links")
    if not levels:
        return links.sparkSession.createDataFrame([], "node long, root long")
    out = levels[-1]
    for lower in reversed(levels[:-1]):
        above = out.select(F.col("hi").alias("up"), F.col("up").alias("top"))
        out = lower.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("up")).unionByName(out)
    return written(out.select(F.col("hi").alias("node"), F.col("up").alias("root")), f"{name}-components")


# -- confirmation

#: Whether the items of each pair are alike enough.
Alike = Callable[[list, list], np.ndarray]


def confirm(pairs: DataFrame, items: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b) whose items, looked up in ``items`` (id, item), pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = alike(batch.column("x").to_pylist(), batch.column("y").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    x = items.select(F.col("id").alias("a"), F.col("item").alias("x"))
    y = items.select(F.col("id").alias("b"), F.col("item").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, pair_schema())


def linked_components(pairs: DataFrame, items: DataFrame, alike: Alike, name: str, first: int = 3) -> DataFrame:
    """Components (node, root) of the candidate pairs whose items are alike.

    First each node's ``first`` likeliest pairs (by votes) are confirmed. Of the others only those matter whose ends
    are still in different components, and all of those are confirmed then: within a group of near copies, most
    pairs need no look, and none that could join two components is left out.
    """
    both = pairs.select("a", "b", "votes", F.col("a").alias("node")).unionByName(
        pairs.select("a", "b", "votes", F.col("b").alias("node"))
    )
    # a node has a bounded number of pairs: width x 2 in each sorted order
    order = Window.partitionBy("node").orderBy(F.desc("votes"), F.xxhash64("a", "b"), "a", "b")
    top = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= first)
    top = written(top.select("a", "b").distinct(), f"{name}-first")
    found = components(confirm(top, items, alike), name)
    at = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = pairs.join(top, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = rest.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    more = written(confirm(rest, items, alike), f"{name}-second")
    if more.isEmpty():
        return found
    joined = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(joined, name)


# -- crowded regions

#: Items' sets of 64-bit values: all items' values, one item after the other, and how many each has. Values may repeat.
SetsOf = Callable[[list], tuple[np.ndarray, np.ndarray]]


def overlaps(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set numbered in ``left`` has in common with each other one in ``right``; none repeats."""
    n, shape = len(sizes), (len(left), len(right))
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values)
    owner, values = owner[order], values[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    at = np.cumsum(new) - 1
    holders = np.bincount(at)
    # values that few hold: each pair of holders
    few = (holders[at] > 1) & (holders[at] <= FEW_HOLDERS)
    o, c = owner[few], at[few]
    row, column = np.full(n, -1), np.full(n, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(shape[0] * shape[1], np.int64)
    for d in range(1, FEW_HOLDERS):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        for i, j in ((o[same], o[same + d]), (o[same + d], o[same])):
            fine = (row[i] >= 0) & (column[j] >= 0)
            cells, times = np.unique(row[i[fine]] * shape[1] + column[j[fine]], return_counts=True)
            out[cells] += times
    out = out.reshape(shape)
    # values that many hold: products of 0-1 matrices, exact in 32-bit floats
    many = holders[at] > FEW_HOLDERS
    o, c = owner[many], at[many]
    c = np.cumsum(np.concatenate([[True], c[1:] != c[:-1]])) - 1 if len(c) else c
    for low in range(0, int(c[-1]) + 1 if len(c) else 0, 4096):
        a, b = np.searchsorted(c, [low, low + 4096])
        matrix = np.zeros((n, 4096), np.float32)
        matrix[o[a:b], c[a:b] - low] = 1
        out += (matrix[left] @ matrix[right].T).astype(np.int64)
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def common(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[k] and b[k] have in common, for each k; values are below 2 ** 32."""
    out = np.zeros(len(a), np.int64)
    low = 0
    for end in np.searchsorted(np.cumsum(sizes[a] + sizes[b]) // 1_000_000, np.arange(1, 2 + (sizes[a] + sizes[b]).sum() // 1_000_000)):
        x, y = a[low:end], b[low:end]
        pair = np.arange(len(x), dtype=np.uint64) << np.uint64(32)
        union = np.concatenate([np.repeat(pair, sizes[z]) | values[spread(starts[z], sizes[z])] for z in (x, y)])
        union.sort()
        out[low:end] = np.bincount((union[1:][union[1:] == union[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x))
        low = end
    return out


def bitmaps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bitmap of each item's values (items x 64-bit words): bits at the values' low bits."""
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << int(4 * counts.mean()).bit_length())) if len(counts) else MAP_BITS[0]
    out, per = np.zeros((len(counts), bits >> 6), np.uint64), max(1, (1 << 22) // bits)
    ends = np.cumsum(counts)
    for low in range(0, len(counts), per):
        some = counts[low : low + per]
        at = values[ends[low] - counts[low] : ends[low + len(some) - 1]] & np.uint64(bits - 1)
        marks = np.zeros(len(some) * bits, bool)
        marks[np.repeat(np.arange(len(some)) * bits, some) + at.astype(np.int64)] = True
        out[low : low + per] = np.packbits(marks).view(np.uint64).reshape(len(some), -1)
    return out


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits matching bitmaps differ. So many values at least are in one of two sets only."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def similar(
    values: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, roots: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i in left, j in right) of sets in different components whose similarity is ``percent`` or more.

    Two sets of m and n values at most that are so alike differ in (100 - percent) (m + n) / (100 + percent) values at
    most, and so do their bitmaps, in bits. Pairs that pass this are counted in full.
    """
    maps, on_left, on_right = bitmaps(values, counts), np.zeros(len(counts), bool), np.zeros(len(counts), bool)
    on_left[left], on_right[right] = True, True
    both_sides = on_left & on_right
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x in (left[k : k + TILE] for k in range(0, len(left), TILE)):
        for y in (right[k : k + TILE] for k in range(0, len(right), TILE)):
            bits = np.zeros((len(x), len(y)), np.int64)
            step = max(1, (1 << 20) // bits.size)  # words at a time
            for w in range(0, maps.shape[1], step):
                bits += unlike(maps[x, None, w : w + step], maps[None, y, w : w + step])
            fine = (100 + percent) * bits <= (100 - percent) * (counts[x][:, None] + counts[y][None, :])
            fine &= roots[x][:, None] != roots[y][None, :]
            # where both rows are on both sides, each pair once
            fine &= (x[:, None] < y[None, :]) | ~(both_sides[x][:, None] & both_sides[y][None, :])
            i, j = np.nonzero(fine)
            if len(i):
                out.append(_counted(values, counts, x, y, i, j, percent))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _counted(
    values: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x[i], y[j]) that are alike enough, by their full sets."""
    i, j = x[i], y[j]
    used = np.unique(np.concatenate([i, j]))
    starts = np.cumsum(counts) - counts
    rank = np.unique(values[spread(starts[used], counts[used])], return_inverse=True)[1].astype(np.uint64)
    owner = np.repeat(np.arange(len(used), dtype=np.uint64), counts[used])
    sets = sorted_distinct(owner << np.uint64(32) | rank)
    begin = np.searchsorted(sets >> np.uint64(32), np.arange(len(used) + 1, dtype=np.uint64))
    sets, sizes, begin = sets & np.uint64(0xFFFFFFFF), np.diff(begin), begin[:-1]
    a, b = np.searchsorted(used, i), np.searchsorted(used, j)
    if (sizes[a] + sizes[b]).sum() > FEW_VALUES:
        left, right = np.unique(a), np.unique(b)
        both = overlaps(sets, sizes, left, right)[np.searchsorted(left, a), np.searchsorted(right, b)]
    else:
        both = common(sets, begin, sizes, a, b)
    fine = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    return i[fine], j[fine]


def crowded_components(
    found: DataFrame, crowded: DataFrame, items: DataFrame, sets_of: SetsOf, percent: int, name: str
) -> DataFrame:
    """The components (node, root) of ``found`` joined by every pair of a crowded region whose sets are alike.

    All pairs of a region are compared whose ends are in different components. A region's largest component isn't
    compared with itself, so a region that is nearly one component costs little. The others' rows and the largest's
    are dealt to blocks by hashes of their ids; a task has two blocks. Regions of the same rows are compared once.
    """
    roots = found.select(F.col("node").alias("id"), "root")
    rows = crowded.join(roots, "id", "left").select("id", "region", F.coalesce("root", "id").alias("root"))
    by_root = rows.groupBy("region", "root").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("print")
    )
    regions = by_root.groupBy("region").agg(
        F.count("*").alias("components"), F.max(F.struct("n", "root")).alias("top"),
        F.sum("n").alias("n"), F.expr("bit_xor(print)").alias("print"),
    )
    regions = regions.filter(F.col("components") > 1).groupBy("n", "print").agg(F.min(F.struct("region", "top")).alias("r"))
    regions = regions.select("r.region", F.col("r.top.root").alias("top"))
    rows = rows.join(regions, "region").select("id", "region", "root", (F.col("root") == F.col("top")).alias("main"))
    sizes = items.select("id", F.octet_length("item").alias("bytes"))
    rows = written(rows.join(sizes, "id"), f"{name}-crowds")
    # blocks of the other components' rows, then those of the largest one's; all in one where one is enough
    n, size = F.count("*"), F.sum("bytes")
    count = lambda on: F.greatest(
        F.ceil(F.count_if(on) / BLOCK_ITEMS), F.ceil(F.sum(F.when(on, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)
    )
    one = (n <= BLOCK_ITEMS) & (size <= BLOCK_BYTES)
    dealt = rows.groupBy("region").agg(
        F.when(one, 1).otherwise(count(~F.col("main"))).cast("int").alias("others"),
        F.when(one, 0).otherwise(count(F.col("main"))).cast("int").alias("mains"),
    )
    rows = rows.join(dealt, "region")
    hashed = F.xxhash64("id")
    apart = F.col("main") & (F.col("mains") > 0)
    own = F.when(apart, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others")))
    rows = rows.select("*", own.cast("int").alias("own"))
    last = F.when(apart, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.select("id", "region", "root", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.select("id", "region", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = rows.join(items, "id").select("region", "x", "y", "own", "root", "item")

    def of_blocks(t: pa.Table) -> pa.RecordBatch:
        own, roots = t.column("own").to_numpy(), t.column("root").to_numpy()
        left = np.flatnonzero(own == t.column("x")[0].as_py())
        right = np.flatnonzero(own == t.column("y")[0].as_py())
        values, counts = sets_of(t.column("item").to_pylist())
        i, j = similar(values, counts, left, right, roots, percent)
        a, b = roots[i], roots[j]
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pair of blocks, whose rows follow each other, once they are all there."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            keys = np.stack([held.column(c).to_numpy() for c in ("region", "x", "y")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for at, end in zip(starts, starts[1:], strict=False):
                yield of_blocks(held.slice(at, end - at))
            held = held.slice(starts[-1])
        if held:
            yield of_blocks(held)

    arrow_rows(rows.sparkSession)
    rows = rows.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y")
    links = rows.mapInArrow(run, pair_schema())
    more = written(links.distinct(), f"{name}-crowded")
    if more.isEmpty():
        return found
    joined = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(joined, f"{name}-whole")


def sketch_limit(bits: int, percent: int) -> int:
    """How many of ``bits`` one-bit hashes may differ: five standard deviations beyond what is expected at the threshold."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(bits * p + 5 * (bits * p * (1 - p)) ** 0.5))


def empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long, votes long")
