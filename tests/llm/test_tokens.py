from __future__ import annotations

from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quiver.llm import byte_bpe, packing, token_counts
from quiver.llm.common import table
from tests.llm.tables import awkward_texts, documents

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
ids_of = lambda t: byte_library.encode(t or "", add_special_tokens=False).ids
texts = st.text(st.one_of(st.sampled_from(list("aeths nid'  \n\t0123=-_*é")), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(BYTE)


def test_awkward_texts(codec):
    for t, ids in zip(awkward_texts(), codec.encode(awkward_texts()), strict=True):
        assert ids.tolist() == ids_of(t) and codec.decode(ids) == (t or "")
    assert 0 < codec.failed < codec.proposed  # both ways are taken


@settings(max_examples=300, deadline=None)
@given(texts)
def test_any_text(text):
    bpe = byte_bpe.codec(BYTE)
    (ids,) = bpe.encode([text])
    assert ids.tolist() == ids_of(text) and bpe.decode(ids) == text
    assert packing.Encoder(BYTE).ids(text).tolist() == ids.tolist()


@settings(max_examples=150, deadline=None)
@given(texts)
def test_any_length(text):
    encoder = token_counts._encoders.setdefault(WORD, token_counts.LengthEncoder(WORD))
    n_bytes, n_tokens = encoder.lengths([text])
    assert n_bytes == [len(text.encode())] and n_tokens == [len(word_library.encode(text, add_special_tokens=False).ids)]


def test_long_runs(codec):
    hard = ["a" * 3000, "ab" * 2000, " " * 999 + "x", "=" * 700, "\n" * 50, "é" * 500, "a<|endoftext|>b<|endoftext|>", "<|endoftext", "🙂" * 99]
    assert [x.tolist() for x in codec.encode(hard)] == [ids_of(t) for t in hard]
    assert [codec.merge(t.encode()) for t in ("aaaa", "hello", "thththth")] == [ids_of(t) for t in ("aaaa", "hello", "thththth")]


def test_compatibility_is_exact(codec):
    """A pair of tokens is compatible exactly if their text merges into the two."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2000, 4000), rng.integers(0, 2000, 4000)
    for x, y, fine in zip(a, b, codec.compatible(a, b), strict=True):
        if codec.merge(codec.bytes_of[x]) == [x] and codec.merge(codec.bytes_of[y]) == [y]:
            assert fine == (codec.merge(codec.bytes_of[x] + codec.bytes_of[y]) == [x, y])


def test_memo_is_bounded():
    bpe = byte_bpe.ByteBpe(BYTE, memo=50)
    for t in awkward_texts() * 2:
        assert bpe.encode([t])[0].tolist() == ids_of(t)
    encoder = token_counts.LengthEncoder(WORD, batch_bytes=64, memo=20)
    for t in awkward_texts() * 2:
        assert encoder.lengths([t])[1] == [len(word_library.encode(t or "", add_special_tokens=False).ids)]


def test_long_pieces():
    """Long texts without blanks are encoded in parts, with the same count."""
    import base64

    rng = np.random.default_rng(0)
    code = "if(x1<=y2&&a.b['s']!=c){d=e+'t';}//it's<|endoftext|>" * 1500
    prose = "".join(rng.choice(list("日本語のテキスト、です。本文！ガガé"), 60_000))
    long = [base64.b64encode(rng.bytes(90_000)).decode(), code, prose, "x" * 70_000, "0123456789" * 9000, "Ünï.cö'dé1" * 9000]
    encoder = token_counts.LengthEncoder(WORD)
    assert encoder.lengths(long)[1] == [len(word_library.encode(t, add_special_tokens=False).ids) for t in long]
    sizes = [[*map(len, token_counts.parts(t.encode()))] for t in long]
    # neither a run of letters nor text whose only marks stand beside letters beyond ASCII has a place that is sure
    assert [max(s) < 40_000 for s in sizes] == [True, True, True, False, True, False]


def test_byte_batches():
    assert [len(b) for b in token_counts.byte_batches([b"aa", b"bb", b"c" * 9, b"d"], 4)] == [2, 1, 1]


def test_tables(spark):
    docs = documents(spark)
    for r, t in zip(sorted(token_counts.count_tokens(docs, WORD).collect()), awkward_texts(), strict=True):
        n = len(word_library.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 2048)
    for r, t in zip(sorted(byte_bpe.round_trip(docs, BYTE).collect()), awkward_texts(), strict=True):
        ids = ids_of(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert [r.ids for r in sorted(byte_bpe.encode_documents(docs, BYTE).collect())] == [ids_of(t) for t in awkward_texts()]
    for op in (lambda d: token_counts.count_tokens(d, WORD), lambda d: byte_bpe.round_trip(d, BYTE), lambda d: packing.pack(d, BYTE)):
        assert op(docs.limit(0)).count() == 0


def check_packing(rows, texts_by_doc, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts_by_doc.keys()
    for d, found in by_doc.items():
        ids = [*ids_of(texts_by_doc[d]), 2]
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        at = 0
        for r in found:
            assert r.start == at and r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in found[1:]) and (len(found) == 1) == (len(ids) <= capacity)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs.repartition(5, "doc_id"), BYTE).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert used <= 1.02 * packing.lower_bound(Counter(r.length for r in rows), 1024)


def test_packing_awkward_rows(spark):
    docs = documents(spark)
    rows = packing.pack(docs, BYTE).collect()
    check_packing(rows, dict(enumerate(awkward_texts())))
    assert sorted(rows)[2][:4] == (2, 0, 0, 1)  # a null text is its end id


def test_packing_a_long_run_of_blanks():
    text = "one" + " " * 2_000_000 + "word"
    assert packing.Encoder(BYTE).ids(text).tolist() == ids_of(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_any_histogram(histogram):
    params = packing.PackParams(capacity=60, rounds=20)
    got, used = Counter(), 0
    for config, times in packing.plan(histogram, params):
        assert times > 0 and sum(x * n for x, n in config) <= 60
        used += times
        for x, n in config:
            got[x] += n * times
    assert got == Counter(histogram)
    assert used <= 1.25 * packing.lower_bound(histogram, 60) + 1
    slots = packing.places(packing.plan(histogram, params))
    assert len(slots) == len({(a, b) for a, b, _, _ in slots.tolist()})


@pytest.mark.parametrize("kind", ["few lengths", "nothing wasted", "large ones", "thirds"])
def test_plan_against_its_certificate(kind):
    """Sequences used, against bounds that hold for any packing: the dual's value and the rounded sizes."""
    rng = np.random.default_rng(1)
    histogram = {
        "few lengths": {341: 900, 342: 900, 343: 900, 500: 500, 171: 800},
        "nothing wasted": Counter(np.clip(np.exp(rng.normal(5.5, 0.9, 20_000)).astype(int), 1, 1023).tolist()),
        "large ones": Counter(rng.integers(300, 1024, 20_000).tolist()),
        "thirds": Counter(rng.integers(200, 500, 20_000).tolist()),
    }[kind]
    params = packing.PackParams()
    counts, dual, prices = packing.solve(histogram, params)
    # no configuration is worth more than 1 by the dual's prices: no packing of the demand beats its value
    lengths = np.array(sorted(histogram))
    assert packing.knapsack(np.array([prices[x] for x in lengths.tolist()]), lengths, 1024)[0][-1] <= 1 + 1e-9
    assert abs(sum(prices[x] * n for x, n in histogram.items()) - dual) < 1e-6 * dual
    used = sum(times for _, times in packing.plan(histogram, params))
    covered = Counter()
    for config, amount in counts.items():
        for x, n in config:
            covered[x] += n * amount
    assert all(covered[x] <= n * (1 + 1e-9) for x, n in histogram.items())
    assert dual <= used and packing.lower_bound(histogram, 1024) <= used
    assert used <= 1.02 * max(dual, packing.lower_bound(histogram, 1024)) + len(histogram)
    assert used <= 1.01 * sum(counts.values()) + len(histogram)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4))
def test_bounds_hold(histogram):
    """Neither bound exceeds the fewest sequences, found by trying every placement."""
    pieces = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)[:8]

    def fewest(rest, rooms, best):
        if len(rooms) >= best:
            return best
        if not rest:
            return len(rooms)
        for i, room in enumerate(dict.fromkeys(rooms)):
            if rest[0] <= room:
                at = rooms.index(room)
                best = min(best, fewest(rest[1:], [*rooms[:at], room - rest[0], *rooms[at + 1 :]], best))
        return min(best, fewest(rest[1:], [*rooms, 12 - rest[0]], best))

    want = fewest(pieces, [], len(pieces) + 1)
    found = Counter(pieces)
    assert packing.lower_bound(found, 12) <= want
    assert packing.solve(found, packing.PackParams(capacity=12, rounds=10))[1] <= want + 1e-6
    assert sum(t for _, t in packing.plan(found, packing.PackParams(capacity=12, rounds=10))) <= want + 1


def test_pricing_is_a_knapsack():
    import itertools

    lengths, values = np.array([2, 3, 7]), np.array([2.0, 3.5, 9.0])
    best = max((sum(n * v for n, v in zip(c, values, strict=True)) for c in itertools.product(range(8), repeat=3) if sum(n * x for n, x in zip(c, lengths, strict=True)) <= 15))
    config = packing.price(values, lengths, 15)
    assert sum(n * values[list(lengths).index(x)] for x, n in config.items()) == best


def test_on_all_cores_of_few_row_groups(spark, tmp_path):
    """A table of one row group goes to all cores whole; one of enough files, an empty one and one without files stay whole too."""
    from quiver.llm.common import on_all_cores

    rows = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('x', 1 + id % 3) END AS text")
    few, many, none = (str(tmp_path / x) for x in ("few", "many", "none"))
    rows.coalesce(1).write.parquet(few)
    rows.repartition(6).write.parquet(many)
    rows.filter("false").write.parquet(none)
    cores = spark.sparkContext.defaultParallelism
    read = spark.read.parquet(few)
    assert on_all_cores(read).rdd.getNumPartitions() == cores
    assert on_all_cores(read).exceptAll(rows).isEmpty() and on_all_cores(read).count() == 1000
    assert "Exchange" not in on_all_cores(spark.read.parquet(many))._jdf.queryExecution().executedPlan().toString()
    assert on_all_cores(spark.read.parquet(none)).count() == 0
    assert on_all_cores(rows).count() == 1000
