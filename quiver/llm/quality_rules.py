"""Quality rules: counts of words, symbols and repeats, then a linear-chain CRF over a document's lines.

Every line is labelled content or boilerplate by Viterbi decoding; the share of a document's words that
stand in content lines decides whether it is kept. The CRF's weights are learnt by maximum likelihood
(forward-backward, gradient ascent) from a bounded sample of labelled documents whose lines take the document's
label; the chain then sorts out which lines of a mixed document agree with their neighbours. No list of words takes part.

Defined results: a null or blank text has no words, fails the base rules and isn't kept. Repeated rows are
judged each on their own, very long texts whole; of rows or labels that repeat a doc_id the CRF learns from one, the
smallest. Without labelled rows of both kinds the CRF is untrained and every line is content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.common import SYMBOLS, in_fold, map_batches, texts_of

CONTENT, BOILERPLATE = 0, 1

FEATURES = (
    "one", "under_4_words", "over_30_words", "some_symbols", "many_symbols", "most_words_symbols", "some_upper",
    "most_upper", "some_bang", "most_bang", "some_bars", "most_bars", "some_digits", "many_digits", "repeats_words",
    "mostly_repeats", "equals_earlier_line", "no_end_mark", "first_line", "last_line",
)


@dataclass(frozen=True)
class RuleParams:
    """Limits of the base rules, the kept share, and how the CRF is fitted."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_content_share: float = 0.5
    sample: int = 3000  # labelled documents that the CRF learns from
    steps: int = 120
    rate: float = 0.5
    l2: float = 1e-3
    l2_transition: float = 0.1  # holds the chain's stickiness back, or one odd line would turn a short document


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    repeated = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= repeated
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and words of each line that has a word."""
    lines = [(x, w) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if (w := x.split())]
    out = np.zeros((len(lines), len(FEATURES)), np.float64)
    n_words = np.zeros(len(lines), np.int64)
    seen: set[bytes] = set()
    for i, (line, words) in enumerate(lines):
        n = n_words[i] = len(words)
        symbols = (len(line) - len(line.translate(None, SYMBOLS))) / n
        upper = sum(map(bytes.isupper, words)) / n
        bang = line.count(b"!") / n
        bars = line.count(b"|") / n
        digits = (len(line) - len(line.translate(None, b"0123456789"))) / len(line)
        repeats = 1 - len(set(words)) / n
        out[i] = (
            1, n < 4, n > 30, symbols > 0, symbols > 0.5, symbols > 1.5, upper > 0.25, upper > 0.6, bang > 0.2,
            bang > 1, bars > 0.1, bars > 0.4, digits > 0.05, digits > 0.3, n > 3 and repeats > 0.4,
            n > 3 and repeats > 0.75, line in seen, line[-1:] not in (b".", b"!", b"?", b":", b'"'),
            i == 0, i == len(lines) - 1,
        )
        seen.add(line)
    return out, n_words


@dataclass(frozen=True)
class Crf:
    """Score of a labelling: the lines' emissions plus the transitions between neighbours."""

    emission: np.ndarray  # FEATURES x 2
    transition: np.ndarray  # 2 x 2

    @classmethod
    def blank(cls) -> Crf:
        """Every line is content."""
        emission = np.zeros((len(FEATURES), 2))
        emission[0, CONTENT] = 1.0
        return cls(emission, np.zeros((2, 2)))

    def decode(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each document's lines; of equally likely ones, content at the last line they differ."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sizes = np.array([len(docs[i]) for i in order], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
        if not len(sizes) or not sizes[0]:
            return out
        starts = np.concatenate([[0], np.cumsum(sizes)])
        emitted = np.concatenate([docs[i] for i in order if len(docs[i])]) @ self.emission
        best = np.zeros((len(order), 2))
        back = np.zeros((len(emitted), 2), np.int8)
        labels = np.zeros(len(emitted), np.int64)
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # documents with a line t
        for t, n in enumerate(live):
            at = starts[:n] + t
            if t:
                ways = best[:n, :, None] + self.transition
                back[at] = ways.argmax(1)
                best[:n] = ways.max(1) + emitted[at]
            else:
                best[:n] = emitted[at]
        ends = starts[1:][sizes > 0] - 1
        labels[ends] = best[: len(ends)].argmax(1)
        for t in range(len(live) - 1, 0, -1):
            at = starts[: live[t]] + t
            labels[at - 1] = back[at, labels[at]]
        for k, i in enumerate(order):
            out[i] = labels[starts[k] : starts[k + 1]]
        return out

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: list[int], params: RuleParams) -> Crf:
        """Maximum likelihood with an L2 penalty; lines carry their document's label.

        Documents weigh the same however many lines they have, and both kinds weigh the same in all.
        """
        pairs = [(x, y) for x, y in zip(docs, labels, strict=True) if len(x)]
        if len({y for _, y in pairs}) < 2:
            return cls.blank()
        pairs.sort(key=lambda p: -len(p[0]))
        sizes = np.array([len(x) for x, _ in pairs])
        gold = np.array([y for _, y in pairs])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        features = np.concatenate([x for x, _ in pairs]).astype(np.float64)
        owner = np.repeat(np.arange(len(pairs)), sizes)
        weight = np.where(gold == 1, 0.5 / (gold == 1).sum(), 0.5 / (gold == 0).sum()) / sizes
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
        line_gold = gold[owner]
        one_hot = np.eye(2)[line_gold]
        inner = np.ones(len(features), bool)
        inner[starts[:-1]] = False
        later = np.flatnonzero(inner)
        follows = np.zeros((2, 2))
        np.add.at(follows, (line_gold[later - 1], line_gold[later]), weight[owner[later]])
        w, tr = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
        speed = [np.zeros_like(w), np.zeros_like(tr)]
        for _ in range(params.steps):
            emitted = features @ w
            alpha, beta = np.zeros_like(emitted), np.zeros_like(emitted)
            for t, n in enumerate(live):
                at = starts[:n] + t
                alpha[at] = emitted[at] + (_logsum(alpha[at - 1][:, :, None] + tr, 1) if t else 0)
            for t in range(len(live) - 1, 0, -1):
                at = starts[: live[t]] + t
                beta[at - 1] = _logsum(tr[None] + (emitted[at] + beta[at])[:, None, :], 2)
            total = _logsum(alpha[starts[1:] - 1], 1)
            expected = np.exp(alpha + beta - total[owner, None])
            ahead = (emitted[later] + beta[later])[:, None, :]
            joint = np.exp(alpha[later - 1][:, :, None] + tr + ahead - total[owner[later], None, None])
            up = (
                features.T @ ((one_hot - expected) * weight[owner, None]) - params.l2 * w,
                follows - (joint * weight[owner[later], None, None]).sum(0) - params.l2_transition * tr,
            )
            for s, g, x in zip(speed, up, (w, tr), strict=True):
                s += g * g
                x += params.rate * g / np.sqrt(s + 1e-12)
        return cls(w, tr)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit_line_labels(documents: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> Crf:
    """Fit the CRF on at most ``params.sample`` labelled documents, those with the smallest hash of their id."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & ~in_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.sample)
    )
    width = len(FEATURES)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [line_features(t)[0].astype(np.int8).tobytes() for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], ["quality", "lines"])

    # the chosen rows number at most params.sample, so they are small enough to broadcast; of rows that share an id one counts
    taken = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    rows = map_batches(
        taken.agg(F.min(F.struct("quality", "text")).alias("row")).select("row.*"),
        features,
        T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("lines", T.BinaryType())]),
    ).collect()
    rows = sorted((r.quality, bytes(r.lines)) for r in rows)
    docs = [np.frombuffer(x, np.int8).reshape(-1, width) for _, x in rows]
    return Crf.fit(docs, [1 - q for q, _ in rows], params)


def judge(texts: list[str | None], crf: Crf, params: RuleParams) -> dict[str, np.ndarray]:
    """Counts and verdict of each text."""
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
    lines = [line_features(t) for t in texts]
    labels = crf.decode([x for x, _ in lines])
    content = np.array([int(n[y == CONTENT].sum()) for (_, n), y in zip(lines, labels, strict=True)], np.int64)
    failed = (base[:, 0] < params.min_words) | (100 * base[:, 4] > params.max_repeat_percent * base[:, 0])
    share = content / np.maximum(base[:, 0], 1)
    return {
        **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), base.T, strict=True)),
        "base_failed": failed,
        "kept": ~failed & (share >= params.min_content_share),
        "content_share": share,
    }


def quality_rules(documents: DataFrame, crf: Crf, params: RuleParams = RuleParams()) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept and content_share (words in content lines)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType)]
        + [T.StructField(x, T.LongType()) for x in names]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
        + [T.StructField("content_share", T.DoubleType())]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judge(texts_of(batch), crf, params)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(found[f.name]) for f in schema.fields[1:])], schema.names
        )

    return map_batches(documents.select("doc_id", "text"), run, schema)


def keep_documents(documents: DataFrame, crf: Crf, params: RuleParams = RuleParams()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(texts_of(batch), crf, params)["kept"]))

    return map_batches(documents, run, documents.schema)
