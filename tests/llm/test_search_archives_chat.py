from __future__ import annotations

import base64
import gzip
import hashlib
import io
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.llm import preferences, queries, topk, warc
from quiver.llm.common import table
from quiver.llm.common import written as common_written

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    names = sorted(got.columns)
    done = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in done.description]
    assert sorted(order) == names
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(row[order.index(n)] for n in names) for row in done.fetchall()), key=key)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == want


def brute_top(rows, is_query, k, scale=1024):
    clean = [(i, np.floor(np.array(v, np.float64) * scale)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in clean), default=0)
    clean = [(i, np.pad(v, (0, width - len(v)))) for i, v in clean]
    out = []
    for q in sorted({i for i, _ in clean if is_query(i)}):
        v = min((tuple(x) for i, x in clean if i == q))
        best = sorted(((-int(np.dot(v, x)), i) for i, x in clean if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def found(df, params):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, params).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))


@pytest.mark.parametrize("kind", ["even", "long_tailed", "ties"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(400, 12))
    if kind == "long_tailed":
        v *= rng.pareto(1.5, (400, 1))
    if kind == "ties":
        v = np.round(v)
    rows = [(i, [float(x) for x in np.float32(w)]) for i, w in enumerate(v)]
    params = topk.TopkParams(k=7, block=16, head=20, sample=50, leading=4, rows_per_partition=60)  # several blocks and tasks
    assert found(vectors(spark, rows), params) == brute_top(rows, lambda i: i % 5 == 0, 7)


def test_top_k_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]), (7, []), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (10, [3.0]), (15, [0.0, 0.0])]
    assert found(vectors(spark, rows), topk.TopkParams(k=3)) == brute_top(rows, lambda i: i % 5 == 0, 3)
    assert found(vectors(spark, rows).limit(0), topk.TopkParams()) == []
    assert found(vectors(spark, [(5, [1.0])]), topk.TopkParams()) == []
    huge = [(i, [1e12 * (i + 1), -3.0]) for i in range(6)]
    got = found(vectors(spark, huge), topk.TopkParams(k=2))
    assert [r[2] for r in got] == [1, 2, 0, 1] and all(r[3] == 2**63 - 1 for r in got)  # saturated, so ties go by id


def test_least_length_prunes_no_answer(spark):
    """Vectors of lengths from 1 to 10,000: most are too short for any query, and blocks of 3 queries run side by side."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=8) * 10 ** rng.uniform(-3, 1)).astype(np.float32).tolist()) for i in range(400)]
    want = brute_top(rows, lambda i: i % 5 == 0, 4)
    assert found(vectors(spark, rows), topk.TopkParams(k=4, block=3, head=40, rows_per_partition=50)) == sorted(want)
    q = np.floor(np.array([v for i, v in rows if i % 5 == 0], np.float64) * 1024).astype(np.int64)
    v = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64)
    least = np.sort(q @ v.T, axis=1)[:, -5]
    length = topk.least_length(q, least)
    assert length > 0 and not ((np.sqrt((v**2).sum(1)) < length)[None] & (q @ v.T >= least[:, None])).any()
    assert topk.least_length(q, np.full(len(q), topk.LONG.min)) == 0


def test_pruning_prunes():
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(size=(4000, 16)) * rng.pareto(1.0, (4000, 1)) * 100).astype(np.int64)
    v = v[np.argsort(-(v**2).sum(1))]
    ids, params = np.arange(len(v)), topk.TopkParams(leading=6)
    q = v[rng.choice(len(v), 20)]
    least = topk.first_thresholds(np.full(20, -1), q, ids[:500], v[:500], 10)
    scan = topk.Scan(np.full(20, -1), q, least, topk.rotation(v[:500]), params)
    for k in range(0, len(v), 200):
        scan.block(ids[k : k + 200], v[k : k + 200])
    assert scan.computed < 0.2 * scan.seen
    exact = np.sort(q @ v.T, axis=1)[:, ::-1][:, :10]
    assert np.array_equal(np.array(scan.result().column("score")).reshape(20, 10), exact)


# -- archives


def member(payload=b"<p>x</p>", kind="response", **more):
    digest = warc.sha1_name(hashlib.sha1(payload).digest())
    return warc.record(kind, "urn:pages:1", more.get("url", "http://x/é y\r\nz"), "2020-01-01T00:00:00Z", payload, len(payload), digest, more.get("refers"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=6), st.integers(1, 400))
def test_reader_returns_what_was_written(payloads, chunk):
    stream = io.BytesIO(b"".join(map(member, payloads)))
    got = list(warc.WarcReader(stream, keep_payload=True, chunk=chunk))
    assert [r.payload for r in got] == payloads and [r.payload_bytes for r in got] == [*map(len, payloads)]
    sizes = [len(member(p)) for p in payloads]
    assert [r.offset for r in got] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_members_are_plain_gzip():
    raw = gzip.decompress(member() + member(b"y", "revisit", refers="urn:pages:2"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC-Record-ID") == 2 and b"http://x/%C3%A9%20y%0D%0Az" in raw
    revisit = list(warc.WarcReader(io.BytesIO(member(b"y", "revisit", refers="urn:pages:2"))))[0]
    assert (revisit.kind, revisit.payload_bytes, revisit.http["content-length"]) == ("revisit", 0, "1")


@pytest.mark.parametrize(
    "broken",
    [
        member()[:-9], member()[:40], b"plain text", gzip.compress(b"HTTP/1.1 no\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"),
        gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"), gzip.compress(gzip.decompress(member()).replace(b"<p>x", b"<p>y")),
        gzip.compress(gzip.decompress(member()) + b"more"), gzip.compress(b"WARC/1.1\r\nContent-Le"),
    ],
)
def test_broken_archives(broken):
    with pytest.raises(warc.WarcError):
        list(warc.WarcReader(io.BytesIO(broken)))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("mine"))


def test_records_of_unbounded_size_are_refused():
    """Headers without end and bytes after a record aren't inflated whole."""
    def member(raw):
        zipped = zlib.compressobj(9, zlib.DEFLATED, 31)
        return zipped.compress(raw) + zipped.flush()

    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n"
    http = b"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: 50000000\r\n\r\n"
    for raw in (head + b"X: " + b"x" * 50_000_000, head + b"\r\nabc\r\n\r\n" + b"y" * 50_000_000, http + b"z" * 50_000_000 + b"\r\n\r\n"):
        stream = io.BytesIO(member(raw))
        tracemalloc.start()
        with pytest.raises(warc.WarcError):
            [*warc.WarcReader(stream)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 << 20


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(1, "u", "same text"), (2, None, "same text"), (9, "u", "same text"), (3, "u", ""), (4, "u", None), (5, "u", "x" * 300_000), (6, "u\n", "é"), (7, "u", "é"), (None, "u", "lonely"), (8, "u", "own")]
    got = sorted(tuple(r)[:5] for r in warc.round_trip(pages(spark, rows), least).filter("page_id is not null").collect())
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == body and p is not None), default=None)
        copy = len(body) >= least and page != top
        if page is not None:
            want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if copy else "response", top if copy else None))
    assert got == sorted(want, key=lambda x: x[0])


def test_archives_rotate_and_empty_tables(spark):
    rows = pages(spark, [(i, "u", f"text {i} " * 200) for i in range(60)])
    folder = warc.scratch(spark, "rotating")
    archives = warc.write_archives(warc.plan_records(rows), folder, archive_bytes=2000)
    assert archives.count() > 4
    assert sorted(r.page_id for r in warc.read_archives(archives).collect()) == list(range(60))
    assert warc.round_trip(rows.limit(0)).count() == 0
    twice = warc.round_trip(pages(spark, [(1, "u", "x"), (1, "u", "x"), (0, "u", "x")])).collect()
    assert sorted((r.page_id, r.record_type) for r in twice) == [(0, "revisit"), (1, "response"), (1, "response")]


# -- preferences


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("mine"))


def segments(spark, rows):
    out = {}
    for r in sorted(preferences.preference_segments(preferences.adjacent_pairs(turns(spark, rows))).collect(), key=lambda r: (r.pair_id, r.turn, r.piece)):
        out.setdefault((r.pair_id, r.part), []).append((r.text, r.trained))
    return out


def test_preferences(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "same"), (0, 2, "user", "and"), (0, 3, "assistant", "good"),
        (1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "and"), (1, 3, "assistant", "bad"), (1, 4, "user", "more"),
    ]
    got = segments(spark, rows)
    text = lambda k: "".join(t for t, _ in got[k])
    mark = lambda role, said: f"<|im_start|>{role}\n{said}<|im_end|>\n"
    assert text((0, "prompt")) == mark("user", "q") + mark("assistant", "same") + mark("user", "and")
    assert text((0, "chosen")) == mark("assistant", "good") and text((0, "rejected")) == mark("assistant", "bad") + mark("user", "more")
    assert [m for _, m in got[0, "prompt"]] == [0] * 6 and [m for _, m in got[0, "rejected"]] == [0, 1, 0, 0]


def test_preferences_awkward_rows(spark):
    same = [(c, t, "user", f"x{t}") for c in (4, 5) for t in (0, 1)]
    rows = [*same, (6, 0, None, None), (7, 0, "unknown", ""), (8, 0, "user", "alone"), (None, 0, "user", "lost"), (10, None, "user", "first"), (11, 0, "user", "a"), (11, 0, "user", "a"), (-1, 0, "user", "n"), (-2, 0, "user", "n")]
    got = segments(spark, rows)
    assert {k for k in got if k[0] == 2} == {(2, "prompt")} and {k for k in got if k[0] == 3} == {(3, "prompt")}
    assert {k for k in got if k[0] == 4} == {(4, "chosen")} and {k for k in got if k[0] == 5} == {(5, "chosen"), (5, "rejected")}
    assert len(got[5, "rejected"]) == 2 and {k for k in got if k[0] == -1} == {(-1, "prompt")}
    assert segments(spark, []) == {}


def test_shared_folder_is_the_sessions(spark):
    kept = common_written(spark.range(3).toDF("x"), "kept")
    assert kept.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))
    assert table is not None
