"""Exact top-k inner products over norm-sorted vectors, with rotated partial sums and Cauchy-Schwarz bounds.

Vectors are quantised to integers and stored by descending length. The directions of an SVD of a bounded sample
rotate them so that leading coordinates carry most of an inner product. For a block of queries, a task walks its
vectors: a block of vectors whose longest can't reach a query's k-th best score is skipped for that query; of the
others, the leading coordinates' partial sum plus the product of the residual lengths bounds every score, and only
pairs whose bound reaches the k-th best are computed exactly, in integers. The longest vectors of the whole table
give every task its first thresholds. Rotation and sample affect speed, never results.

Queries go in blocks of a fixed size; several blocks are under way at a
time, each a pass whose results are written, so that the driver holds a fixed number of blocks and a task one. A pass
reads only vectors that are long enough for some query of its block: the least length is a filter on the scan, and as
files are ranges of lengths, those of shorter vectors aren't read.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an
id; shorter vectors count as padded with zeros. A query has every row with another id as candidate; rows that repeat
an id are candidates each on their own, and for a repeated query the smallest of its vectors is taken. Components and
scores saturate at the ends of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.common import arrow_rows, partitions_for, scratch, written

LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class TopkParams:
    k: int = 10
    scale: int = 1024
    block: int = 2048  # queries in a pass
    passes: int = 4  # under way at a time
    head: int = 2048  # longest vectors, for first thresholds
    sample: int = 4096  # vectors that the rotation is fitted on
    leading: int = 24  # rotated coordinates in the first bound
    rows_per_partition: int = 50_000


def quantised(vectors: DataFrame, params: TopkParams) -> DataFrame:
    """vec_id, v (array of long), norm (Euclidean length of v) of the rows that take part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(params.scale))).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(~odd)
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return rows.withColumn("norm", F.sqrt(square))


def _matrix(lists: list | pa.Array, width: int) -> np.ndarray:
    """Rows of one width, padded with zeros."""
    array = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.int64()))
    sizes = np.diff(array.offsets.to_numpy())
    flat = array.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of a sample, as columns, by falling singular value."""
    if not sample.size:
        return np.eye(sample.shape[1])
    return np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T


def _exact(q: np.ndarray, v: np.ndarray, small: bool) -> np.ndarray:
    """All inner products of the rows of q and v. small: floats hold every sum exactly."""
    if small:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    full = q.astype(object) @ v.astype(object).T
    return np.clip(full, LONG.min, LONG.max).astype(np.int64)


def _pairwise(q: np.ndarray, v: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of matching rows."""
    if small:
        return np.einsum("ij,ij->i", q, v)
    full = (q.astype(object) * v.astype(object)).sum(1)
    return np.clip(full, LONG.min, LONG.max).astype(np.int64)


class Scan:
    """One task's pass over vectors for a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, turn: np.ndarray, params: TopkParams):
        self.ids, self.q, self.turn, self.params = ids, q, turn, params
        self.least = least.copy()  # no score below it can be among a query's k best
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.lead = (q @ turn)[:, : params.leading]
        self.rest = np.sqrt(np.maximum(0, self.norm**2 - (self.lead**2).sum(1)))
        self.best = [np.zeros(0, np.int64)] * 3  # query's row, vec_id, score
        self.computed = self.seen = 0

    def block(self, ids: np.ndarray, v: np.ndarray) -> None:
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        small = bool(norm.max(initial=0) * self.norm.max(initial=0) < 2.0**52)
        slack = 1e-9 * norm.max(initial=0) * self.norm + 1e-3
        self.seen += len(ids) * len(self.ids)
        live = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.least)
        if not len(live):
            return
        turned = v @ self.turn
        lead = turned[:, : self.params.leading]
        rest = np.sqrt(np.maximum(0, norm**2 - (lead**2).sum(1)))
        for at in range(0, len(live), 256):
            some = live[at : at + 256]
            bound = self.lead[some] @ lead.T + np.outer(self.rest[some], rest)
            row, col = np.nonzero(bound + slack[some, None] >= self.least[some, None])
            if not len(row):
                continue
            if len(row) * 4 > bound.size:
                score = _exact(self.q[some], v, small)[row, col]
            else:
                score = _pairwise(self.q[some[row]], v[col], small)
            self.computed += len(row)
            row = some[row]
            fine = (score >= self.least[row]) & (ids[col] != self.ids[row])
            self._add(row[fine], ids[col[fine]], score[fine])

    def _add(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        row, vec, score = (np.concatenate([a, b]) for a, b in zip(self.best, (row, vec, score), strict=True))
        order = np.lexsort((vec, ~score, row))  # ~ reverses the order of longs
        row, vec, score = row[order], vec[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.params.k
        self.best = [row[keep], vec[keep], score[keep]]
        last = np.flatnonzero(np.arange(len(row)) - first == self.params.k - 1)
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])

    def result(self) -> pa.RecordBatch:
        row, vec, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(vec), pa.array(score)], PAIRS.names)


PAIRS = T.StructType([T.StructField(x, T.LongType()) for x in ("query_id", "vec_id", "score")])


def first_thresholds(ids: np.ndarray, q: np.ndarray, head_ids: np.ndarray, head: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the longest vectors, the smallest long if there are fewer."""
    norms = [np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0) for x in (q, head)]
    score = _exact(q, head, norms[0] * norms[1] < 2.0**52)
    score[ids[:, None] == head_ids] = LONG.min
    if score.shape[1] < k:
        return np.full(len(q), LONG.min)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def top_k(vectors: DataFrame, is_query: Column, params: TopkParams = TopkParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    plain = quantised(vectors, params)
    n = partitions_for(spark, plain.count(), params.rows_per_partition)
    # the id spreads vectors of equal length over ranges
    by_norm = plain.repartitionByRange(n, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    base = written(by_norm, "vectors")
    width = base.agg(F.max(F.size("v"))).first()[0]
    if not width or width < 0:
        width = 1
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(params.sample).select("v").toArrow()
    turn = rotation(_matrix(sample.column("v").combine_chunks(), width))
    head = base.orderBy(F.desc("norm"), "vec_id").limit(params.head).select("vec_id", "v").toArrow()
    head_ids, head_v = head.column("vec_id").to_numpy(), _matrix(head.column("v").combine_chunks(), width)
    asked = written(base.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    path = scratch(spark, "found")
    spark.createDataFrame([], PAIRS).withColumn("rank", F.lit(0)).write.parquet(f"{path}/pass=-1")

    def search(nth: int, ids: np.ndarray, q: np.ndarray) -> None:
        least = first_thresholds(ids, q, head_ids, head_v, params.k)
        long_enough = base.filter(F.col("norm") >= least_length(q, least))
        _scan(long_enough, ids, q, least, turn, params).write.parquet(f"{path}/pass={nth}")

    with ThreadPoolExecutor(params.passes) as pool:
        under_way: set[Future] = set()
        for nth, (ids, q) in enumerate(_blocks(asked, width, params)):
            under_way.add(pool.submit(search, nth, ids, q))
            if len(under_way) >= params.passes:
                done, under_way = wait(under_way, return_when=FIRST_COMPLETED)
                for each in done:
                    each.result()
        for each in under_way:
            each.result()
    found = spark.read.schema(T.StructType([*PAIRS.fields, T.StructField("rank", T.IntegerType())])).parquet(path)
    return found.select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, width: int, params: TopkParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries by id, a block at a time."""
    after = None
    while True:
        left = asked if after is None else asked.filter(F.col("vec_id") > after)
        block = left.orderBy("vec_id").limit(params.block).toArrow()  # of bounded size
        if not block.num_rows:
            return
        ids = block.column("vec_id").to_numpy()
        yield ids, _matrix(block.column("v").combine_chunks(), width)
        after = int(ids[-1])


def least_length(q: np.ndarray, least: np.ndarray) -> float:
    """No vector shorter than this has an inner product of ``least`` or more with its row of q (Cauchy-Schwarz)."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    need = least.astype(np.float64) - 1e-3
    if (need <= 0).any() or not len(q):
        return 0.0
    # a query without length has only scores of 0, so its threshold isn't above 0
    return float((need / norm).min() * (1 - 1e-9))


def _scan(base: DataFrame, ids: np.ndarray, q: np.ndarray, least: np.ndarray, turn: np.ndarray, params: TopkParams) -> DataFrame:
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(ids, q, least, turn, params)
        for batch in batches:
            if batch.num_rows:
                scan.block(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width))
        yield scan.result()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = base.select("vec_id", "v").mapInArrow(run, PAIRS).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= params.k)


