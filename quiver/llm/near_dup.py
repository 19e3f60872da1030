"""MinHash near-dedup with an LSH forest over sets of word shingles.

Each distinct set of shingles has a MinHash signature. The forest's trees are sorted orders of different parts of
the signature; candidates are neighbours by longest common prefix, to a depth that adapts to how crowded the region
of the order is (see :mod:`quiver.llm.pairs`). One-bit sketches of the whole signature drop unlike candidates before
anything large moves; links are confirmed on full sets; components come from distributed union-find. Regions too
crowded for that are compared whole afterwards, as far as their documents are in different components.

Defined results: a text without words has an empty set and is linked with nothing; one with fewer words than a
shingle has its whole sequence as its only shingle. Documents with equal sets are linked. Rows that repeat a doc_id
are each given their component; a null doc_id is linked with nothing and kept. ``keep_documents`` decides by doc_id and
text: of different texts under one id each goes or stays for itself, of rows equal in both any one stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from quiver.llm.common import map_batches, passing, sorted_distinct, texts_of, written
from quiver.llm.pairs import (
    NeighbourParams,
    bloom,
    candidate_pairs,
    crowded_components,
    crowded_rows,
    linked_components,
    maybe_in,
    neighbour_rows,
    sketch_limit,
)

UNITS = 6  # signature values in a tree's key
SKETCH_BITS = 128


@dataclass(frozen=True)
class ForestParams:
    words: int = 5  # in a shingle
    percent: int = 80  # least Jaccard similarity
    trees: int = 20
    depth: int = 3  # least common prefix of candidates
    seed: int = 11

    @property
    def values(self) -> int:
        return max(SKETCH_BITS, self.trees * UNITS)


class Shingler:
    """Sets of hashed word shingles; the hashes of words met are kept up to a bound."""

    def __init__(self, words: int, memo: int = 400_000):
        self.words, self.memo = words, memo
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's distinct shingles as sorted 64-bit hashes."""
        split = [(t or "").encode("utf-8").lower().split() for t in texts]  # bytes: lowers A-Z only
        if len(self.known) > self.memo:
            self.known.clear()
        self.known.update((w, xxh3_64_intdigest(w)) for w in set().union(*split) - self.known.keys())
        return [self._set(np.fromiter(map(self.known.__getitem__, x), np.uint64, len(x))) for x in split]

    def _set(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return hashes
        n = min(self.words, len(hashes))
        m = len(hashes) - n + 1
        mixed = np.full(m, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return sorted_distinct(mixed ^ (mixed >> np.uint64(32)))


def signature(hashes: np.ndarray, params: ForestParams) -> np.ndarray:
    """MinHash values of a set, each spread over 32 bits."""
    rng = np.random.default_rng(params.seed)
    a = rng.integers(1 << 31, size=(params.values, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(1 << 32, size=(params.values, 1), dtype=np.uint32)
    x = (hashes >> np.uint64(16)).astype(np.uint32)[None, :]
    out = np.full(params.values, 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 2048):
        out = np.minimum(out, (a * x[:, k : k + 2048] + b).min(1))
    return out * np.uint32(0x9E3779B1)


_shinglers: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    return _shinglers.get(words) or _shinglers.setdefault(words, Shingler(words))


def signatures(documents: DataFrame, params: ForestParams) -> DataFrame:
    """Per document: doc_id, its text's hash, size (of its set), the set's fingerprint f1, f2, and its signature."""
    schema = T.StructType(
        [T.StructField(x, T.LongType()) for x in ("doc_id", "text_hash", "size", "f1", "f2")]
        + [T.StructField("signature", T.BinaryType())]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingler(params.words).sets(texts_of(batch))
        prints = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64)
        columns = [
            batch.column("doc_id"),
            batch.column("text_hash"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(prints[::2].copy()),
            pa.array(prints[1::2].copy()),
            pa.array([signature(s, params).tobytes() if len(s) else None for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, run, schema)


def _tree_rows(distinct: DataFrame, params: ForestParams) -> DataFrame:
    """A row for each set and tree: the key (with the tree in its leading bits), id, size and sketch."""
    names = ["k1", "k2", "k3", "id", "size", "s1", "s2"]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])
    trees, values = params.trees, params.values

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        values_of = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, values)
        bits = np.packbits((values_of[:, :SKETCH_BITS] >> np.uint32(13)) & np.uint32(1), axis=1).view(np.int64)
        units = values_of[:, : trees * UNITS].reshape(n, trees, UNITS).astype(np.uint64)
        units[:, :, 0] = (units[:, :, 0] >> np.uint64(6)) | (np.arange(trees, dtype=np.uint64) << np.uint64(26))
        keys = ((units[:, :, ::2] << np.uint64(32)) | units[:, :, 1::2]).view(np.int64).reshape(n * trees, 3)
        columns = [keys[:, 0].copy(), keys[:, 1].copy(), keys[:, 2].copy()]
        columns += [np.repeat(batch.column(x).to_numpy(), trees) for x in ("id", "size")]
        columns += [np.repeat(bits[:, 0], trees), np.repeat(bits[:, 1], trees)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return map_batches(distinct.select("id", "size", "signature"), run, schema)


def _alike(percent: int):  # noqa: ANN202
    def alike(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(xs), bool)
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            together = np.sort(np.concatenate([a, b]))
            both = int((together[1:] == together[:-1]).sum())
            out[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return out

    return alike


def _sets_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint64), np.fromiter(map(len, items), np.int64, len(items)) // 8


def near_duplicates(documents: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is component_id)."""
    return _decided(documents, params).drop("text_hash")


def _decided(documents: DataFrame, params: ForestParams) -> DataFrame:
    if params.trees > 64:
        raise ValueError("a key has room for 64 trees")
    signed = written(signatures(documents, params), "signatures", lasting=True)
    found = signed.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    with passing():
        groups = written(_linked_sets(documents, signed.count(), found, params), "groups", lasting=True)
    sets = signed.select("doc_id", "text_hash", "size", "f1", "f2").join(groups, ["f1", "f2"], "left")
    own = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    component = F.coalesce(own, F.col("doc_id"))
    return sets.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
    )


def _linked_sets(documents: DataFrame, n_rows: int, found: DataFrame, params: ForestParams) -> DataFrame:
    """The sets (f1, f2) that several documents have or that are linked, and their component."""
    # equal sets are linked by their fingerprint; one document stands for all of them from here on
    distinct = found.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "size", "signature")).alias("first"))
    distinct = distinct.select(F.col("first.doc_id").alias("id"), "first.size", "first.signature")
    near = NeighbourParams(
        depth=params.depth, percent=params.percent, most_unlike=sketch_limit(SKETCH_BITS, params.percent)
    )
    rows = _tree_rows(distinct, params)
    met = written(neighbour_rows(rows, n_rows * params.trees, ["k1", "k2", "k3"], near), "near-neighbours")
    pairs, crowded = written(candidate_pairs(met), "near-pairs"), crowded_rows(met)
    ends = written(pairs.select("a").union(pairs.select("b")).union(crowded.select("id")).distinct(), "near-ends")
    wanted = bloom(ends.select(F.xxhash64("a").alias("h")), "h", ends.count())

    def full_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(maybe_in(wanted, batch.column("h").to_numpy())))
        sets = shingler(params.words).sets(texts_of(batch))
        columns = [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "item"])

    texts = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("item", T.BinaryType())])
    items = written(map_batches(texts.withColumn("h", F.xxhash64("id")), full_sets, schema), "sets")
    joined = linked_components(pairs, items, _alike(params.percent), "near")
    joined = crowded_components(joined, crowded, items, _sets_of, params.percent, "near")
    # only sets with copies or links need a look-up; other documents are their own components
    groups = found.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    groups = groups.join(joined, "node", "left").filter((F.col("n") > 1) | F.col("root").isNotNull())
    return groups.select("f1", "f2", F.coalesce("root", "node").alias("component"))


def keep_documents(documents: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """One document of each component, with all its columns."""
    decided = written(_decided(documents, params).select("doc_id", "text_hash", "n_shingles", "kept"), "decided")
    text_hash = F.xxhash64(documents["text"])

    def with_rows(rows: DataFrame, among: DataFrame, how: str) -> DataFrame:
        same = (rows["doc_id"] == among["doc_id"]) & (text_hash == among["text_hash"])
        return rows.join(among, same, how)

    left = with_rows(documents, decided.filter(~F.col("kept")).select("doc_id", "text_hash").distinct(), "left_anti")
    told = decided.filter(F.col("kept") & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    again = told.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select("doc_id", "text_hash"), "repeated")
    if again.isEmpty():
        return left
    once = with_rows(left, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return with_rows(left, again, "left_anti").unionByName(once)
