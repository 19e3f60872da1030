"""Best-fit packing: a configuration linear program over the histogram of lengths, then rounding.

Documents are encoded, closed with an end id and cut only where they exceed a sequence. What is left to decide
depends on the histogram of piece lengths alone, of at most ``capacity`` bins, however many documents there are.
On the driver, multiplicative weights solve the covering program "how often is each configuration (multiset of
lengths that fits a sequence) used": a knapsack dynamic program prices the configurations, the best are used a
little, and the prices of the lengths that they cover fall exponentially. Each round's prices also give a lower bound.
The fractional counts are rounded, in a few ways of which the best is taken, as far as demand lasts; each length left
over starts a sequence, largest first, that another knapsack fills best.

The pieces find their places without meeting: a piece's rank among those of its length follows from its rank within
its own partition and the counts of earlier partitions, and the plan maps (length, rank) to sequence and offset.

Defined results: a null text is an empty one, a single end id; repeated rows are packed each on their own. A very long
text is cut into full pieces, each a sequence by itself. Which of several pieces of one length goes where follows from
the order of the rows written; every choice fills the sequences alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.byte_bpe import SURE
from quiver.llm.common import arrow_rows, texts_of, written


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    end_id: int = 2
    rounds: int = 60  # in which coverage rises from nothing to all, for each rate and to cover
    rates: tuple[float, ...] = (16.0, 4.0, 1.0, 0.25, 0.0625)  # a price falls by exp(-rate) until its length is covered
    slack: float = 0.01  # how much worse than the best one a configuration may be that a round uses
    loose: float = 0.001  # how much less than 1 a configuration may be worth that is rounded in the stricter ways
    shares: tuple[float | None, ...] = (1.0, 0.9, 0.6, None)  # ways of rounding, of which the best is taken


# -- the plan, on the driver

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value that fits each room up to ``capacity``, any number of each length, and the length taken last.

    Where nothing is taken, a room is worth what the next smaller one is.
    """
    worth = np.full(capacity + 1, -np.inf)  # by length
    worth[lengths] = values
    number = np.full(capacity + 1, -1)
    number[lengths] = np.arange(len(lengths))
    back = np.zeros(capacity + 1)  # the rooms' values from the largest room down: slices run the same way
    last = np.zeros(capacity + 1, np.int64)
    ways = np.empty(capacity + 1)
    for c in range(1, capacity + 1):
        np.add(back[capacity - c + 1 :], worth[1 : c + 1], out=ways[:c])
        k = ways[:c].argmax()
        before = back[capacity - c + 1]
        if ways[k] > before:
            back[capacity - c], last[c] = ways[k], k + 1
        else:
            back[capacity - c] = before
    return back[::-1].copy(), number[last]


def choice(take: np.ndarray, room: int, lengths: np.ndarray) -> Counter[int]:
    """What a knapsack of ``room`` holds: copies by the length's number."""
    held: Counter[int] = Counter()
    while room > 0:
        k = int(take[room])
        if k < 0:
            room -= 1
        else:
            held[k] += 1
            room -= int(lengths[k])
    return held


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the greatest value that fits."""
    _, take = knapsack(values, lengths, capacity)
    return {int(lengths[k]): n for k, n in choice(take, capacity, lengths).items()}


def cover(
    need: np.ndarray, lengths: np.ndarray, prices: np.ndarray, rate: float, whole: bool, params: PackParams
) -> tuple[dict[Config, float], np.ndarray, float]:
    """Rounds of multiplicative weights: counts of configurations, the prices of the best lower bound, this bound.

    A length's weight is its demand times its price, which falls as exp(-rate * covered share). In each round one
    knapsack prices all configurations; those that hold a length behind the round's level and are worth (1 - slack)
    of the best are used until the level is reached. Prices by which no configuration is worth more than 1 are a
    solution of the dual program, so what they make the demand worth bounds every packing from below. With ``whole``
    nothing is covered twice, and a length that is covered is dropped, until all are.
    """
    covered = np.zeros(len(lengths))
    used: dict[Config, float] = {}
    dual, bound, rounds = prices, 0.0, params.rounds
    for turn in range(rounds * (3 if whole else 1)):
        open_ = np.flatnonzero(covered < 1 - 1e-9) if whole else np.arange(len(lengths))
        if not len(open_):
            break
        level = (turn + 1) / rounds
        values, sizes = prices[open_] * np.exp(-rate * covered[open_]), lengths[open_]
        best, take = knapsack(values, sizes, params.capacity)
        if float(need[open_] @ values) / best[-1] > bound:
            bound = float(need[open_] @ values) / best[-1]
            dual = np.zeros(len(lengths))
            dual[open_] = values / best[-1]
        top, before = min(1.0, level) if whole else level, covered.copy()
        worth = values + best[params.capacity - sizes]
        behind = np.flatnonzero((covered[open_] < top - 1e-12) & (worth >= (1 - params.slack) * best[-1]))
        for k in behind[np.argsort(covered[open_][behind], kind="stable")].tolist():
            if covered[open_[k]] >= top - 1e-12:
                continue  # covered by this round's other configurations
            held = choice(take, params.capacity - int(sizes[k]), sizes)
            held[k] += 1
            rows = open_[[*held]]
            copies = np.array([*held.values()], np.float64)
            most = np.full(len(rows), min(1.0, level + 1 / rounds)) if whole else before[rows] + 2 / rounds
            most[rows == open_[k]] = top
            amount = float(((most - covered[rows]) * need[rows] / copies).min())
            if amount > 0:
                covered[rows] += amount * copies / need[rows]
                config = tuple(sorted(((int(sizes[i]), n) for i, n in held.items()), reverse=True))
                used[config] = used.get(config, 0.0) + amount
    return used, dual, bound


def solve(demand: dict[int, int], params: PackParams) -> tuple[dict[Config, float], float, dict[int, float]]:
    """Fractional counts of configurations that cover the demand, a lower bound on how many any packing needs, its prices.

    Prices start as the lengths themselves, the best ones where nothing need be wasted. Rounds with ever slower
    prices, each from the best found before, only find prices; the last ones cover the demand by them.
    """
    lengths = np.array(sorted(demand), np.int64)
    need = np.array([demand[x] for x in lengths.tolist()], np.float64)
    prices, bound = lengths.astype(np.float64), 0.0
    for rate in params.rates:
        _, dual, found = cover(need, lengths, prices, rate, False, params)
        if found > bound:
            prices, bound = dual, found
    used, dual, found = cover(need, lengths, prices, params.rates[-1], True, params)
    if found > bound:
        prices, bound = dual, found
    return used, bound, dict(zip(lengths.tolist(), prices.tolist(), strict=True))


def fill(room: int, left: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The fullest choice for ``room`` from what is left, larger lengths first: bounded subset sums as bits of an integer."""
    reach = [1]
    mask = (1 << (room + 1)) - 1
    usable = [x for x in lengths if x <= room and left[x]]
    tried = []
    for x in usable:
        have = reach[-1]
        for _ in range(min(left[x], room // x)):
            wider = (have | have << x) & mask
            if wider == have:
                break
            have = wider
        reach.append(have)
        tried.append(x)
        if have >> room & 1:
            break
    c, config = reach[-1].bit_length() - 1, {}
    for i in range(len(tried) - 1, -1, -1):
        x, n = tried[i], 0
        while not reach[i] >> c & 1:
            c, n = c - x, n + 1
        if n:
            config[x] = n
    return config


def rounded(counts: dict[Config, float], demand: dict[int, int], capacity: int, share: float | None) -> list[tuple[Config, int]]:
    """Whole counts that hold the demand exactly: each count's whole part, or, with ``share``, so much of the counts' sum.

    In the latter case what one count loses another, of like lengths, gains. What is left over is filled largest first.
    """
    left, out, owed = dict(demand), [], 0.0
    for config, amount in sorted(counts.items(), reverse=True):
        owed = amount if share is None else owed + share * amount
        times = min(int(owed + 1e-9), *(left[x] // n for x, n in config))
        owed = min(owed - times, 1.0)
        if times > 0:
            out.append((config, times))
            for x, n in config:
                left[x] -= n * times
    lengths = sorted((x for x, n in left.items() if n), reverse=True)
    while lengths:
        top = lengths[0]
        left[top] -= 1
        held = Counter({top: 1}) + Counter(fill(capacity - top, left, lengths))
        left[top] += 1
        times = min(left[x] // n for x, n in held.items())
        out.append((tuple(sorted(held.items(), reverse=True)), times))
        for x, n in held.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def plan(histogram: dict[int, int], params: PackParams) -> list[tuple[Config, int]]:
    """Configurations and how many sequences use each; they hold the histogram exactly."""
    demand = {x: n for x, n in histogram.items() if n > 0}
    out: list[tuple[Config, int]] = []
    if full := demand.pop(params.capacity, 0):
        out.append((((params.capacity, 1),), full))
    if not demand:
        return out
    counts, _, prices = solve(demand, params)
    # in a best solution every configuration is worth 1 by the best prices; those made late of what was left aren't
    tight = {c: n for c, n in counts.items() if sum(prices[x] * k for x, k in c) >= 1 - params.loose}
    ways = [rounded(x, demand, params.capacity, share) for x in (counts, tight) for share in params.shares]
    return out + min(ways, key=lambda found: sum(times for _, times in found))


def places(configs: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: where pieces go."""
    rows, ranks, sequence = [], Counter(), 0
    for config, times in configs:
        offset = 0
        for length, copies in config:
            for _ in range(copies):
                rows.append((length, ranks[length], sequence, offset))
                ranks[length] += times
                offset += length
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


# -- pieces and places, on the executors


class Encoder:
    """Ids as the tokenizers library gives them, by a faster library with the same vocabulary where both agree."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from quiver.llm.byte_bpe import WORDS, byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("pack", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow = path, None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SURE.fullmatch(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its regular expressions give up on about a million blanks in a row
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than a sequence."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def piece_schema(documents: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")]
        + [T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
    )


def pieces(documents: DataFrame, path: str, params: PackParams = PackParams()) -> DataFrame:
    """All pieces, with the partition they are made in and their rank there among pieces of their length.

    These two hold only in a table once written, not when the rows are made again from a source dealt otherwise.
    """
    arrow_rows(documents.sparkSession)
    schema = piece_schema(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(params.capacity + 1, np.int64)
        end = np.array([params.end_id], np.uint32)
        for batch in batches:
            row, piece, start, length, check, nth = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                ids = np.concatenate([encoder.ids(text), end]).astype("<u4")
                at = 0
                for k, size in enumerate(cut(len(ids), params.capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    check.append(crc32(ids[at : at + size].tobytes()))
                    nth.append(seen[size])
                    seen[size] += 1
                    at += size
            longs = [pa.array(np.array(x, np.int64)) for x in (start, length, check)]
            columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *longs]
            columns += [pa.array([part] * len(row), pa.int32()), pa.array(np.array(nth, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pack(documents: DataFrame, path: str, params: PackParams = PackParams()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(documents, path, params), "pieces")
    # how many pieces of each length earlier partitions have: rows only for (length, partition), not for pieces
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(plan(histogram, params))  # its size depends on the capacity, not on the number of documents
    key = slots[:, 0] << 40 | slots[:, 1]
    schema = T.StructType(
        piece_schema(documents).fields[:5] + [T.StructField(x, T.LongType()) for x in ("sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            slot = slots[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            columns = [batch.column(x) for x in schema.names[:5]]
            columns += [pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    placed = made.join(counts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    return placed.select(*schema.names[:5], "rank").mapInArrow(run, schema)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: pieces' sizes rounded so that no sequence's sizes add up to more than 1.

    For k = 0 the sizes are the lengths; for k > 0 a length x counts as floor((k + 1) x / capacity) / k, or, where that
    is a whole number before rounding, as x / capacity (the dual feasible functions of Fekete and Schepers).
    """
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    for k in range(1, min(100, capacity) + 1):
        # in units of 1 / (k * capacity), so that all is whole
        sizes = {x: k * x if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity for x in histogram}
        least = max(least, -(-sum(sizes[x] * n for x, n in histogram.items()) // (k * capacity)))
    return least


def tokens_path(spark: SparkSession, name: str) -> str:
    """Where a public tokenizer's file is; it is at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
