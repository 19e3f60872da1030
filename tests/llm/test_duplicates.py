from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import line_dedup, near_dup, pairs
from quiver.llm.common import table
from tests.llm.tables import awkward_texts, documents, prose


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def links_of(sets, percent=80):
    holders, out = {}, []
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders.get(g, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                out.append((i, j))
        for g in s:
            holders.setdefault(g, []).append(i)
    return out


def word_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set())
    return out


def check_documents(df, words):
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    sets = word_sets([t for _, t in rows], words)
    found = roots(len(rows), links_of(sets))
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, near_dup.ForestParams(words=words)).collect()}
    for i, (d, _) in enumerate(rows):
        r = got[d]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), rows[found[i]][0], found[i] == i), d


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, sf, words):
    check_documents(table(spark, sf, "documents"), words)


def test_awkward_documents(spark):
    check_documents(documents(spark), 2)
    assert near_dup.near_duplicates(documents(spark).limit(0)).count() == 0
    kept = near_dup.keep_documents(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in near_dup.near_duplicates(documents(spark)).filter("kept").collect()}


def test_large_group_of_near_copies(spark):
    """Many different texts that are all alike, some only through others."""
    base = prose(9, 300).split(" ")
    texts = []
    for i in range(400):
        rng, w = np.random.default_rng(i), list(base)
        for k in rng.choice(len(w), 1 + i % 9, replace=False):
            w[k] = f"new{i}_{k}"
        texts.append(" ".join(w))
    check_documents(documents(spark, texts + [prose(100 + i, 60) for i in range(50)], extra=False), 2)


def star(n, changed):
    """A text of 300 words and ``n`` copies that are alike only through it: each with some words of its own."""
    base = prose(9, 300).split(" ")
    texts = []
    for i in range(n):
        rng, w = np.random.default_rng(i), list(base)
        for k in rng.choice(len(w) // 2, changed, replace=False):
            w[2 * k] = f"new{i}_{k}"
        texts.append(" ".join(w))
    return " ".join(base), texts


@pytest.mark.parametrize("block", [1000, 150])
def test_copies_that_are_alike_only_through_one_text(spark, block, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ITEMS", block)
    base, copies = star(1000, 14)
    sets = word_sets([base, *copies], 2)
    alike = lambda a, b: len(a & b) / len(a | b)
    assert all(0.8 <= alike(sets[0], s) < 0.85 for s in sets[1:])
    assert sum(alike(sets[i], sets[i + 1]) >= 0.8 for i in range(1, 1000)) < 10
    df = documents(spark, [*copies[:500], base, *copies[500:], prose(1, 60)], extra=False)
    got = Counter(r.component_id for r in near_dup.near_duplicates(df, near_dup.ForestParams(words=2)).collect())
    assert got == {0: 1001, 1001: 1}


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 40 + 400 * (i % 3), 60).tolist()) for i in range(70)]
    values = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    left, right = np.arange(0, 40), np.arange(30, 70)
    got = pairs.overlaps(values, np.array([*map(len, sets)]), left, right)
    assert all(got[i, j - 30] == len(sets[i] & sets[j]) for i in left for j in right if i != j)


@pytest.mark.parametrize("few", [1 << 30, 50])
def test_similar_blocks(few, monkeypatch):
    """Pairs counted one by one and by products, against all pairs."""
    monkeypatch.setattr(pairs, "FEW_VALUES", few)
    monkeypatch.setattr(pairs, "TILE", 9)
    rng = np.random.default_rng(2)
    bases = [rng.integers(0, 1 << 60, 50) for _ in range(6)]
    sets = []
    for i in range(60):
        s = bases[i % 6].copy()
        s[rng.choice(50, rng.integers(0, 9), replace=False)] = rng.integers(0, 500, 1)
        sets.append(set(s[: 50 - i % 4].tolist()))
    spread_out = lambda x: (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
    values = np.concatenate([spread_out([*s] + [*s][:3]) for s in map(sorted, sets)])  # some values stand twice
    sizes, roots_of = np.array([len(s) + 3 for s in sets]), rng.integers(0, 30, 60)
    for left, right in ((np.arange(40), np.arange(25, 60)), (np.arange(60), np.arange(60))):
        i, j = pairs.similar(values, sizes, left, right, roots_of, 80)
        got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        want = {
            (min(a, b), max(a, b)) for a in left.tolist() for b in right.tolist()
            if roots_of[a] != roots_of[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        }
        assert got == want and len(want) > 50


def test_crowds():
    """Regions of more than ``width`` rows and those at the ends, however the rows come in blocks."""
    regions = np.repeat(np.array([7, 8, 9, 10, 11, 12], np.uint64), [1, 3, 9, 2, 4, 1])
    ids = np.arange(len(regions))
    for step in (1, 2, 5, 30):
        crowds = pairs.Crowds(3)
        out = [crowds.add(regions[i : i + step], ids[i : i + step])[1] for i in range(0, len(ids), step)]
        found = np.concatenate([*out, crowds.end()[1]])
        assert found.tolist() == [i for i in ids if regions[i] in (7, 9, 11, 12)], step


def test_rows_without_an_id_and_repeated_rows(spark):
    text = prose(4, 80)
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (7, text), (9, None)], "doc_id long, text string")
    rows = near_dup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(3, 3, True), (3, 3, True), (7, 3, False), (9, 9, True)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(pairs, "LINK_ROWS", 40)  # several tasks, several rounds
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    want = roots(600, links)
    got = {r.node: r.root for r in pairs.components(df, "test").collect()}
    assert got == {i: r for i, r in enumerate(want) if i != r}
    assert pairs.components(df.limit(0), "none").count() == 0


def test_bloom(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    words = pairs.bloom(keys, "h", 1000)
    all_keys = spark.range(3000).select("id", F.xxhash64("id").alias("h")).toPandas()
    hit = pairs.maybe_in(words, all_keys["h"].to_numpy())
    assert hit[:1000].all() and hit[1000:].mean() < 0.01


def check_lines(df):
    params = line_dedup.LineParams()
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    places = {}
    for d, t in rows:
        for k, line in line_dedup.lines_of(t):
            places.setdefault(line, []).append((d, k))
    lines = sorted(places, key=lambda x: places[x][0])
    found = roots(len(lines), links_of([line_dedup.shingles(x, params.shingle) for x in lines]))
    first = {x: places[lines[found[i]]][0] for i, x in enumerate(lines)}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" \t\r\x0b\x0c") or first[x] == (d, k))
        n = len(line_dedup.lines_of(t))
        assert (got[d].text, got[d].n_lines, got[d].n_removed) == (want, n, n - len(line_dedup.lines_of(want)))


def test_lines(spark, sf):
    check_lines(table(spark, sf, "documents"))


def test_awkward_lines(spark):
    docs = documents(spark)
    check_lines(docs)
    kept = line_dedup.keep_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 not in ids and {0, 2, 3, 4} <= ids  # a copy loses every line; blank ones had none
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_fuzzy_lines(spark):
    line = "this is a line of a fair length that stands in several documents with small changes"
    texts = [line, line + "!", "own words here\n" + line.replace("fair", "fine"), line.upper(), "short", "short", "shorts"]
    check_lines(documents(spark, texts, extra=False))
    left = {r.doc_id: r.text for r in line_dedup.keep_documents(documents(spark, texts, extra=False)).collect()}
    assert left[0] == line and 1 not in left and left[4] == "short" and 5 not in left and left[6] == "shorts"


def test_lines_that_are_alike_only_through_one_line(spark):
    """Variants of a line, each with another small change: they are like the line, not like each other."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    line = "".join(rng.choice(letters, 117))
    variants = []
    for i in range(300):
        at = 8 + i % 100
        variants.append(line[:at] + f"{i:02d}"[:2] + line[at + 2 :] + f"{i:03d}")
    shingled = [line_dedup.shingles(x, 8) for x in [line, *variants]]
    assert all(100 * len(shingled[0] & s) >= 80 * len(shingled[0] | s) for s in shingled[1:])
    docs = documents(spark, [line, *variants], extra=False)
    check_lines(docs)
    assert [r.doc_id for r in line_dedup.keep_documents(docs).collect()] == [0]


def test_bands_that_pairs_at_the_threshold_share():
    params = line_dedup.LineParams()
    assert (1 - (params.percent / 100) ** params.values) ** params.bands < 1 / 5000


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    one, two, three, four = ("".join(np.random.default_rng(i).choice(list("abcdefgh "), 60)) for i in range(4))
    rows = [
        (1, one), (None, one + "\n" + two), (None, three), (None, three), (None, three + "\n" + four),
        (5, one), (5, "other words of its own"), (6, four), (6, four),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter((r.doc_id, r.text) for r in line_dedup.keep_documents(df).collect())
    assert left.pop((None, three)) == 1
    assert left == {(1, one): 1, (None, two): 1, (5, "other words of its own"): 1, (6, four): 1}


def test_exact_similarity():
    rng = np.random.default_rng(0)
    base = prose(1, 60).replace("\n", " ")
    xs = [base[: rng.integers(8, len(base))] for _ in range(300)]
    ys = [(lambda x: x[: rng.integers(8, len(x) + 1)] + "zzz" * rng.integers(0, 2))(x) for x in xs]
    want = [(lambda a, b: 100 * len(a & b) >= 80 * len(a | b))(line_dedup.shingles(x, 8), line_dedup.shingles(y, 8)) for x, y in zip(xs, ys, strict=True)]
    assert line_dedup.alike(xs, ys, line_dedup.LineParams()).tolist() == want
    assert line_dedup.blocks([5, 5, 20, 1], 10) == [(0, 2), (2, 3), (3, 4)]
