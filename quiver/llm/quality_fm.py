"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x. Its score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

where the second sum is all pairwise interactions of rank ``factors``, found in time linear in the non-zeros
by the sum-of-squares identity. Words are hashed into buckets with the logarithm of their counts (scaled to unit
length); statistics of the text's structure and its metadata (``n_chars``) are one-hot bins. Ids, source,
language and labels are no inputs.

Defined results: a null text scores as an empty one; repeated rows score alike; very long texts are read whole;
of rows or labels that repeat a doc_id the model learns from one, the smallest; a missing or null ``n_chars`` has
a bin of its own; without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

import operator
import tempfile
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cmp_to_key
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.common import SYMBOLS, in_fold, map_batches, texts_of

BINS = 16
STATISTICS = (
    "words", "symbols", "upper", "bang", "bars", "digits", "distinct", "word_length", "line_length", "run",
    "repeated_lines", "top_word", "chars",
)

#: Non-zeros of a batch of documents that a fit works on at once.
PART_VALUES = 500_000


@dataclass(frozen=True)
class FmParams:
    """Size of the model and of the bounded labelled sample that it is fitted on."""

    word_buckets: int = 1 << 14
    factors: int = 8
    sample: int = 8000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.15
    l2: float = 1e-4
    threshold: float = 0.3
    seed: int = 7

    @property
    def width(self) -> int:
        return len(STATISTICS) * BINS + self.word_buckets


def _share(x: float) -> int:
    """Bin of a share of 0 to 1: none, then finer near 0."""
    return 0 if x <= 0 else min(BINS - 1, 1 + int(14 * min(1.0, x) ** 0.5))


def _log(x: float) -> int:
    return min(BINS - 1, int(np.log2(x + 1)))


def features(text: str | None, n_chars: int | None, params: FmParams) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's non-zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    bins = (
        _log(len(words)),
        _share((len(raw) - len(raw.translate(None, SYMBOLS))) / size),
        _share(sum(c for w, c in counts.items() if w.isupper()) / n),
        _share(raw.count(b"!") / n),
        _share(raw.count(b"|") / n),
        _share((len(raw) - len(raw.translate(None, b"0123456789"))) / size),
        _share(len(counts) / n),
        min(BINS - 1, len(raw) // n),
        _log(n / max(1, len(lines))),
        _share(sum(map(operator.eq, words, islice(words, 1, None))) / n),
        _share(1 - len(set(lines)) / max(1, len(lines))),
        _share(max(counts.values(), default=0) / n),
        BINS - 1 if n_chars is None else min(BINS - 2, _log(max(0, n_chars) / 16)),
    )
    index = np.empty(len(bins) + len(counts), np.int32)
    value = np.ones(len(index), np.float32)
    index[: len(bins)] = np.arange(len(bins)) * BINS + bins
    if counts:
        hashed = np.fromiter(map(crc32, counts), np.uint32, len(counts)) % np.uint32(params.word_buckets)
        index[len(bins) :] = hashed.astype(np.int32) + len(bins) * BINS
        weight = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        value[len(bins) :] = weight / np.sqrt((weight * weight).sum())
    return index, value


@dataclass(frozen=True)
class Fm:
    bias: float
    w: np.ndarray  # width
    v: np.ndarray  # width x factors

    @classmethod
    def blank(cls, params: FmParams) -> Fm:
        return cls(0.0, np.zeros(params.width, np.float32), np.zeros((params.width, params.factors), np.float32))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One number for each document; every document has non-zeros, those from its start on."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        vx *= vx
        squares = np.add.reduceat(vx.sum(1), starts)
        linear = np.add.reduceat(self.w[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of 0 to 1, in blocks of bounded size."""
        out, k = np.zeros(len(docs)), 0
        while k < len(docs):
            end, size = k, 0
            while end < len(docs) and (end == k or size + len(docs[end][0]) <= 200_000):
                size += len(docs[end][0])
                end += 1
            starts = np.cumsum([0, *(len(x) for x, _ in docs[k : end - 1])])
            margin = self.margins(
                np.concatenate([x for x, _ in docs[k:end]]), np.concatenate([v for _, v in docs[k:end]]), starts
            )
            out[k:end] = 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))
            k = end
        return out

    def gradient(
        self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The features that documents of a batch of ``n`` use, and the loss's slopes by their w, their v and the bias."""
        sizes = np.array([len(x) for x, _ in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        index = np.concatenate([x for x, _ in docs])
        value = np.concatenate([x for _, x in docs])
        margin = self.margins(index, value, starts)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels).astype(np.float32) / n
        per = np.repeat(error, sizes)
        vx = self.v[index] * value[:, None]
        sums = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
        used, inverse = np.unique(index, return_inverse=True)
        each = (per * value)[:, None] * (sums - vx)
        dv = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(each.shape[1])], 1)
        return used, np.bincount(inverse, per * value, len(used)), dv, float(error.sum())

    @classmethod
    def fit(cls, docs: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, params: FmParams) -> Fm:
        """Logistic loss, AdaGrad over shuffled batches; a batch of long documents is worked on part by part."""
        if len(set(labels.tolist())) < 2:
            return cls.blank(params)
        rng = np.random.default_rng(params.seed)
        w = np.zeros(params.width, np.float32)
        v = rng.normal(0, 0.02, (params.width, params.factors)).astype(np.float32)
        bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
        for _ in range(params.epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), params.batch):
                chosen = order[at : at + params.batch]
                model = cls(bias, w, v)
                batch = [docs[i] for i in chosen]
                parts = [model.gradient(batch[x], labels[chosen[x]], len(chosen)) for x in _parts(batch)]
                used = parts[0][0] if len(parts) == 1 else np.unique(np.concatenate([x for x, *_ in parts]))
                dw, dv, db = np.zeros(len(used)), np.zeros((len(used), params.factors)), 0.0
                for x, of_w, of_v, of_bias in parts:
                    at_used = np.searchsorted(used, x)
                    dw[at_used] += of_w
                    dv[at_used] += of_v
                    db += of_bias
                dw = dw.astype(np.float32) + params.l2 * w[used]
                dv = dv.astype(np.float32) + params.l2 * v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += db * db
                w[used] -= params.rate * dw / np.sqrt(gw[used])
                v[used] -= params.rate * 0.3 * dv / np.sqrt(gv[used])
                bias -= params.rate * db / gb**0.5
        return cls(bias, w, v)


def _parts(batch: list[tuple[np.ndarray, np.ndarray]]) -> list[slice]:
    """Runs of a batch's documents with PART_VALUES non-zeros at most, but with one document at least."""
    out, at, size = [], 0, 0
    for k, (index, _) in enumerate(batch):
        if k > at and size + len(index) > PART_VALUES:
            out.append(slice(at, k))
            at, size = k, 0
        size += len(index)
    return [*out, slice(at, len(batch))]


class Spooled(Sequence):
    """Labelled documents' non-zeros in a file of this process, in the order of (label, indices, values).

    Long documents have many, so neither Spark's driver nor this process holds all of them at once. The file has no name
    and goes with the object; only this process reads it.
    """

    def __init__(self, rows: Iterable[tuple[int, bytes, bytes]]):
        self._file = tempfile.TemporaryFile(prefix="quiver-")  # noqa: SIM115 - lives as long as the object
        labels, heads, places, at = [], [], [], 0
        for label, index, value in rows:
            labels.append(label)
            heads.append(bytes(index[:256]))
            places.append((at, len(index)))
            self._file.write(index)
            self._file.write(value)
            at += len(index) + len(value)
        self._places = places

        def compared(i: int, j: int) -> int:
            x, y = (labels[i], heads[i]), (labels[j], heads[j])
            if x == y:
                x, y = ([part.tobytes() for part in self._read(k)] for k in (i, j))
            return (x > y) - (x < y)

        order = sorted(range(len(labels)), key=cmp_to_key(compared))
        self._places = [places[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.float64)

    def _read(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, size = self._places[i]
        self._file.seek(at)
        raw = self._file.read(2 * size)  # as many bytes of values as of indices
        return np.frombuffer(raw, np.int32, size // 4), np.frombuffer(raw, np.float32, size // 4, size)

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self._read(i)


def _with_chars(documents: DataFrame, *more: str) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    return documents.select(*more, "text", chars.alias("n_chars"))


def fit_quality(documents: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> Fm:
    """Fit on at most ``params.sample`` labelled documents outside the held-out fold, by smallest hash of their id."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & ~in_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.sample)
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, c, params) for t, c in zip(texts_of(batch), batch.column("n_chars").to_pylist(), strict=True)]
        columns = [batch.column("quality"), pa.array([x.tobytes() for x, _ in found]), pa.array([v.tobytes() for _, v in found])]
        return pa.RecordBatch.from_arrays(columns, ["quality", "at", "value"])

    # the chosen rows number at most params.sample, so they are small enough to broadcast; of rows that share an id one counts
    taken = _with_chars(documents, "doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    rows = map_batches(
        taken.agg(F.min(F.struct("quality", "text", "n_chars")).alias("row")).select("row.*"),
        run,
        T.StructType(
            [T.StructField("quality", T.IntegerType())] + [T.StructField(x, T.BinaryType()) for x in ("at", "value")]
        ),
    )
    # one partition after the other: the driver's heap never has all of them
    docs = Spooled((r.quality, r["at"], r["value"]) for r in rows.toLocalIterator())
    return Fm.fit(docs, docs.labels, params)


def _scores(batch: pa.RecordBatch, model: Fm, params: FmParams) -> np.ndarray:
    chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
    return model.scores([features(t, c, params) for t, c in zip(texts_of(batch), chars, strict=True)])


def score_documents(documents: DataFrame, model: Fm, params: FmParams = FmParams()) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = _scores(batch, model, params)
        columns = [
            batch.column("doc_id"), batch.column("held_out"), pa.array(score),
            pa.array((score >= params.threshold).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    plain = documents.select("*") if "held_out" not in documents.columns else documents.drop("held_out")
    return map_batches(
        _with_chars(plain.withColumn("held_out", in_fold(F.col("doc_id"))), "doc_id", "held_out"), run, schema
    )


def keep_documents(documents: DataFrame, model: Fm, params: FmParams = FmParams()) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(batch, model, params) >= params.threshold))

    return map_batches(documents, run, documents.schema)
