"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept of each component.

Distinct lines (by 128-bit hash) get MinHash values of their character shingles, joined into bands. Lines that share
a band are neighbours in the sorted order of the bands' hashes, candidates' texts are compared exactly, and
distributed union-find joins them. Bands that many lines share
are then compared whole, as far as their lines are in different components. Of all occurrences of a
component's lines the first, by (doc_id, line number, hash of the row's text), stays.

Defined results: lines without a word are never compared and stay; a document whose lines with words all go is
dropped, one that had none stays as it is. A null text stays null. Rows that share a doc_id, or have none, are told
apart by a 64-bit hash of their texts; of rows with the same doc_id and text one keeps lines, the others lose all that
have a word. Rows with a null doc_id come last in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from quiver.llm.common import map_batches, passing, sorted_distinct, texts_of, written
from quiver.llm.pairs import (
    NeighbourParams,
    bitmaps,
    bloom,
    candidate_pairs,
    crowded_components,
    crowded_rows,
    linked_components,
    maybe_in,
    neighbour_rows,
    spread,
    unlike,
)


@dataclass(frozen=True)
class LineParams:
    shingle: int = 8  # characters
    percent: int = 80  # least Jaccard similarity
    bands: int = 12  # of 3 values each: of pairs just at the threshold one in 5,000 is missed, at 0.9 one in 6 million
    values: int = 3  # in a band
    seed: int = 5


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Numbers and texts of the lines that have a word."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]


def shingles(line: str, n: int) -> set[str]:
    return {line[i : i + n] for i in range(len(line) - n + 1)} if len(line) >= n else {line}


def rolled(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the n-character windows of the joined lines, each line's first window and number of windows.

    Every line has at least n characters. Windows that cross two lines lie between the lines' own.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    base, out, width = 0x9E3779B97F4A7C15, codes, 1
    for bit in bin(n)[3:]:  # windows of twice the width, then of one more
        out = out[:-width] * np.uint64(pow(base, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(base) + codes[width:]
            width += 1
    out = out.copy() if n == 1 else out
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out, np.cumsum(sizes) - sizes, sizes - n + 1


def blocks(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of items whose sizes add up to about ``limit`` at most."""
    out, at, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            out.append((at, i))
            at, total = i, 0
        total += size
    return [*out, (at, len(sizes))] if sizes else out


def min_hashes(lines: list[str], params: LineParams) -> np.ndarray:
    """MinHash values (lines x bands*values) of lines that have at least one full shingle."""
    total = params.bands * params.values
    rng = np.random.default_rng(params.seed)
    odd = rng.integers(1 << 31, size=total, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(lines), total), np.uint32)
    for at, end in blocks([*map(len, lines)], 40_000):  # what stays in a core's cache
        hashes, first, counts = rolled(lines[at:end], params.shingle)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        borders = np.stack([first, first + counts], 1).ravel()  # windows across lines don't count
        if borders[-1] == len(x):
            borders = borders[:-1]
        for k in range(total):
            out[at:end, k] = np.minimum.reduceat(x * odd[k], borders)[::2]
    return out


def _fingerprints(lines: list[str]) -> np.ndarray:
    """128-bit hashes as two longs each."""
    return np.frombuffer(b"".join(xxh3_128_digest(x.encode("utf-8")) for x in lines), np.int64).reshape(-1, 2)


def band_keys(values: np.ndarray, params: LineParams) -> np.ndarray:
    """A 64-bit hash of each band's values and its number (lines x bands)."""
    values = values.astype(np.uint64)
    key = np.tile(np.arange(1, params.bands + 1, dtype=np.uint64), (len(values), 1))
    for k in range(params.values):
        key = key * np.uint64(0x9E3779B97F4A7C15) + values[:, k :: params.values]
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def line_table(documents: DataFrame, params: LineParams) -> DataFrame:
    """Every line that has a word: doc_id, row (hash of the text it is in), line, fingerprint f1, f2 and bands' keys b0, ...

    Within a batch only the first of equal lines carries the keys, and only if it has a full shingle.
    """
    bands = [f"b{k}" for k in range(params.bands)]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("line", T.IntegerType())]
        + [T.StructField(x, T.LongType()) for x in ("f1", "f2", *bands)]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, number, texts = [], [], []
        for i, text in enumerate(texts_of(batch)):
            for k, line in lines_of(text):
                row.append(i)
                number.append(k)
                texts.append(line)
        prints = _fingerprints(texts)
        first = {x: i for i, x in reversed(list(enumerate(texts))) if len(x) >= params.shingle}
        at, keys = np.full(len(texts), -1), np.zeros((0, params.bands), np.int64)
        if first:
            at[[*first.values()]] = np.arange(len(first))
            keys = band_keys(min_hashes([*first], params), params)
        of_doc, of_line = pa.array(row, pa.int32()), pa.array(at, pa.int32(), mask=at < 0)
        columns = [
            batch.column("doc_id").take(of_doc), batch.column("row").take(of_doc), pa.array(number, pa.int32()),
            pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()),
            *(pa.array(keys[:, k].copy()).take(of_line) for k in range(params.bands)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return map_batches(rows, run, schema)


#: Low bits of a shingle's hash that are compared; the high ones number lines and pairs of a block.
HASH_BITS = 53


def alike(xs: list[str], ys: list[str], params: LineParams) -> np.ndarray:
    """Whether the Jaccard similarity of each pair's sets of character shingles reaches the threshold.

    Sets are of the shingles' 53-bit hashes. Pairs whose bitmaps differ in more bits than two such sets may differ in
    values are out. Of the others in a block the sets are sorted together, and so are the pairs' unions, in which what
    stands twice is common to both.
    """
    out = np.zeros(len(xs), bool)
    shift, mask = np.uint64(HASH_BITS), np.uint64((1 << HASH_BITS) - 1)
    for at, end in blocks([len(x) + len(y) for x, y in zip(xs, ys, strict=True)], 400_000):
        for low in range(at, end, 1000):
            x, y = xs[low : min(end, low + 1000)], ys[low : min(end, low + 1000)]
            number = {line: i for i, line in enumerate(dict.fromkeys([*x, *y]))}
            hashes, first, counts = rolled([*number], params.shingle)
            hashes = hashes[spread(first, counts)] & mask
            a, b = (np.fromiter(map(number.__getitem__, z), np.int64, len(z)) for z in (x, y))
            maps = bitmaps(hashes, counts)
            near = (100 + params.percent) * unlike(maps[a], maps[b]) <= (100 - params.percent) * (counts[a] + counts[b])
            near = np.flatnonzero(near)
            used = np.unique(np.concatenate([a[near], b[near]]))
            a, b = np.searchsorted(used, a[near]), np.searchsorted(used, b[near])
            first = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(used), dtype=np.uint64), counts[used])
            sets = sorted_distinct(owner << shift | hashes[spread(first[used], counts[used])])
            starts = np.searchsorted(sets >> shift, np.arange(len(used) + 1, dtype=np.uint64))
            size = np.diff(starts)
            pair = np.arange(len(near), dtype=np.uint64)
            union = np.concatenate(
                [np.repeat(pair, size[z]) << shift | sets[spread(starts[z], size[z])] & mask for z in (a, b)]
            )
            union.sort()
            both = np.bincount((union[1:][union[1:] == union[:-1]] >> shift).astype(np.int64), minlength=len(near))
            out[low + near] = 100 * both >= params.percent * (size[a] + size[b] - both)
    return out


def shingles_of(lines: list[str], params: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """The lines' 53-bit shingle hashes, one line after the other, and how many each has, repeats included."""
    hashes, first, counts = rolled(lines, params.shingle)
    return hashes[spread(first, counts)] & np.uint64((1 << HASH_BITS) - 1), counts


def line_components(documents: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """Per line of a component of several occurrences: doc_id, row, line, and whether it is the first occurrence."""
    bands = [f"b{k}" for k in range(params.bands)]
    lines = written(line_table(documents, params), "lines")
    distinct = lines.groupBy("f1", "f2").agg(F.count("*").alias("n"), *(F.max(b).alias(b) for b in bands))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    # a whole band in common: both units of its hash
    near = NeighbourParams(depth=2)
    rows = distinct.filter(F.col(bands[0]).isNotNull()).select(F.explode(F.array(*bands)).alias("k1"), "id")
    n_lines = distinct.count()
    met = written(neighbour_rows(rows, n_lines * params.bands, ["k1"], near), "line-neighbours")
    crowded, pairs = crowded_rows(met), written(candidate_pairs(met), "line-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded.select("id")).distinct()
    needed = written(distinct.select("id", "f1", "f2").join(ends, "id"), "needed-lines")
    wanted = bloom(needed, "f1", needed.count())

    def candidate_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list({x for t in texts_of(batch) for _, x in lines_of(t) if len(x) >= params.shingle})
        prints = _fingerprints(texts)
        hit = np.flatnonzero(maybe_in(wanted, prints[:, 0].copy()))
        columns = [pa.array(prints[hit, 0]), pa.array(prints[hit, 1]), pa.array([texts[i] for i in hit], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["f1", "f2", "item"])

    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("f1", "f2")] + [T.StructField("item", T.StringType())])
    texts = map_batches(documents.select("text"), candidate_texts, schema)
    texts = texts.groupBy("f1", "f2").agg(F.min("item").alias("item"))
    items = written(needed.join(texts, ["f1", "f2"]).select("id", "item"), "line-texts")
    joined = linked_components(pairs, items, lambda x, y: alike(x, y, params), "lines")
    joined = crowded_components(joined, crowded, items, lambda x: shingles_of(x, params), params.percent, "lines")
    # the distinct lines that occur twice or are linked, by the smallest linked one
    linked = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    several = distinct.select("id", "f1", "f2", "n").join(linked.withColumnRenamed("node", "id"), "id", "left")
    several = several.filter((F.col("n") > 1) | F.col("root").isNotNull())
    several = several.select("f1", "f2", F.coalesce("root", "id").alias("root"))
    found = written(lines.select("doc_id", "row", "line", "f1", "f2").join(several, ["f1", "f2"]).drop("f1", "f2"), "places")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line", "row")
    firsts = written(found.groupBy("root").agg(F.min(place).alias("first")), "first-places")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    is_first &= (F.col("line") == F.col("first.line")) & (F.col("row") == F.col("first.row"))
    return found.join(firsts, "root").select("doc_id", "row", "line", is_first.alias("is_first"))


def removed_lines(documents: DataFrame, params: LineParams) -> DataFrame:
    """Per row that loses a line or stands there again: _doc, _row, _gone (numbers of lines) and _again."""
    found = line_components(documents, params)
    # a row that is there twice has each of its lines twice
    gone = found.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_set(F.when(~F.col("is_first"), F.col("line"))).alias("_gone"),
        (F.count("*") > F.size(F.collect_set("line"))).alias("_again"),
    )
    return gone.filter((F.size("_gone") > 0) | F.col("_again"))


def dedup_lines(documents: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The documents without repeated lines, with n_lines and n_removed (lines with a word) after their columns.

    ``text`` and, where there is one, ``n_chars`` follow what is left; emptied documents aren't dropped here.
    """
    with passing():
        gone = written(removed_lines(documents, params), "removed-lines", lasting=True)
    repeated = not gone.filter("_again").isEmpty()
    # names of its own, whatever the documents' columns are called
    mark = "_"
    while any(c.startswith(mark) for c in documents.columns):
        mark += "_"
    doc, row, lost, again, copy = (f"{mark}{x}" for x in ("doc", "row", "gone", "again", "copy"))
    gone = gone.toDF(doc, row, lost, again)
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    same = documents["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(documents["text"]) == gone[row])
    placed = documents.select(*names).join(gone, same, "left").withColumn(copy, F.lit(False))
    if repeated:
        nth = F.row_number().over(Window.partitionBy(doc, row).orderBy(doc))
        several = placed.filter(again).withColumn(copy, nth > 1)
        placed = placed.filter(~F.coalesce(again, F.lit(False))).unionByName(several)
    schema = T.StructType(
        [documents.schema[c] for c in names] + [T.StructField(x, T.LongType()) for x in ("n_lines", "n_removed")]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, total, removed = [], [], []
        of_rows = (batch.column(c).to_pylist() for c in (lost, copy))
        for text, numbers, is_copy in zip(texts_of(batch), *of_rows, strict=True):
            n = len(lines_of(text))
            if numbers or is_copy:
                drop = {i for i, _ in lines_of(text)} if is_copy else set(numbers)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            out.append(text)
            total.append(n)
            removed.append(n - len(lines_of(text)))
        columns = {c: batch.column(c) for c in names}
        columns["text"] = pa.array(out, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(
                columns["n_chars"].type
            )
        columns |= {"n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        return pa.RecordBatch.from_arrays([*columns.values()], schema.names)

    return map_batches(placed.select(*names, lost, copy), run, schema)


def keep_documents(documents: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The documents without repeated lines and with their own columns, less those that lost every line."""
    done = dedup_lines(documents, params)
    left = done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select(*documents.columns) if set(documents.columns) <= set(done.columns) else left.drop("n_lines", "n_removed")
