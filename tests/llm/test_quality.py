from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest

from quiver.llm import quality_fm, quality_rules
from quiver.llm.common import table
from tests.llm.tables import awkward_texts, documents, labels, prose

WS = " \t\n\x0b\x0c\r"


def split_words(text):
    out, now = [], ""
    for c in text or "":
        if c in WS:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def brute_counts(text):
    words = split_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if split_words(line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("text", [t for t in awkward_texts() if t is None or len(t) < 6000] + ["a b a b a b a", "a a a", "a a a a", "x\n\nx\n x\nx", "    \x1c"])
def test_base_counts(text):
    assert quality_rules.base_counts(text) == brute_counts(text)


def brute_viterbi(emitted, transition):
    import itertools

    return max(itertools.product((0, 1), repeat=len(emitted)), key=lambda y: (round(sum(emitted[i][v] for i, v in enumerate(y)) + sum(transition[a][b] for a, b in zip(y, y[1:], strict=False)), 9), [-v for v in y[::-1]]))


def test_viterbi():
    rng = np.random.default_rng(0)
    crf = quality_rules.Crf(rng.normal(size=(len(quality_rules.FEATURES), 2)), rng.normal(size=(2, 2)))
    docs = [(rng.random((n, len(quality_rules.FEATURES))) < 0.3).astype(float) for n in (3, 0, 1, 8, 5, 8)]
    for x, y in zip(docs, crf.decode(docs), strict=True):
        assert tuple(y) == (brute_viterbi(x @ crf.emission, crf.transition) if len(x) else ())


def test_likelihood_gradient_points_up():
    rng = np.random.default_rng(1)
    docs = [(rng.random((4, len(quality_rules.FEATURES))) < 0.3).astype(float) for _ in range(12)]
    gold = [i % 2 for i in range(12)]
    for x, y in zip(docs, gold, strict=True):
        x[:, 3] = y
    crf = quality_rules.Crf.fit(docs, gold, quality_rules.RuleParams(steps=60))
    assert [int(np.bincount(y).argmax()) for y in crf.decode(docs)] == gold


def test_rules_on_awkward_rows(spark):
    docs = documents(spark)
    crf = quality_rules.Crf.blank()
    rows = quality_rules.quality_rules(docs, crf).collect()
    assert len(rows) == docs.count()
    for r, t in zip(sorted(rows), awkward_texts(), strict=True):
        want = brute_counts(t) if t is None or len(t) < 6000 else quality_rules.base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    kept = quality_rules.keep_documents(docs, crf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality_rules.quality_rules(docs.limit(0), crf).count() == 0


def test_untrained_without_labels(spark):
    crf = quality_rules.fit_line_labels(documents(spark), labels(spark, []))
    assert crf.emission[0, 0] > crf.emission[0, 1]
    model = quality_fm.fit_quality(documents(spark), labels(spark, [(0, 1, 0), (None, 0, 0), (1, None, 0)]))
    rows = quality_fm.score_documents(documents(spark), model).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}


def test_rules_keep_clean_documents(spark, sf):
    docs, said = table(spark, sf, "documents"), table(spark, sf, "labels")
    crf = quality_rules.fit_line_labels(docs, said)
    got = quality_rules.quality_rules(docs, crf).filter("not base_failed").join(said, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    again = quality_rules.fit_line_labels(docs, said)
    assert np.allclose(crf.emission, again.emission)


def test_sum_of_squares():
    rng = np.random.default_rng(2)
    params = quality_fm.FmParams(word_buckets=64, factors=3)
    model = quality_fm.Fm(0.3, rng.normal(size=params.width), rng.normal(size=(params.width, 3)))
    docs = [(rng.choice(params.width, n, replace=False), rng.random(n)) for n in (1, 5, 9)]
    for (i, x), score in zip(docs, model.scores(docs), strict=True):
        y = 0.3 + model.w[i] @ x + sum(model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert score == pytest.approx(1 / (1 + np.exp(-y)))


def test_classifier(spark, sf):
    docs, said = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_fm.fit_quality(docs, said)
    rows = {r.doc_id: r for r in quality_fm.score_documents(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[r.doc_id].score, r.quality) for r in said.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([s >= 0.3 for s in good]) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.9  # held-out area under the curve


def test_only_text_and_metadata_count(spark):
    params = quality_fm.FmParams()
    text = prose(5, 200)
    docs = [(i, "### ***" * 50 if i % 2 else text, "en", "s", 100) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality_fm.fit_quality(df, labels(spark, [(i, 1 - i % 2, 0) for i in range(40)]), params)
    other = df.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'yy' as source", "n_chars")
    score = lambda d: sorted((r.doc_id % 1000, r.score) for r in quality_fm.score_documents(d, model, params).collect())
    assert score(df) == score(other)
    assert [s >= 0.3 for _, s in score(df)] == [i % 2 == 0 for i in range(40)]
    kept = quality_fm.keep_documents(df, model, params)
    assert {r.doc_id for r in kept.collect()} == set(range(0, 40, 2)) and kept.columns == df.columns


def test_classifier_on_awkward_rows(spark):
    docs = documents(spark)
    model = quality_fm.Fm.blank(quality_fm.FmParams())
    assert quality_fm.score_documents(docs, model).count() == docs.count()
    assert quality_fm.score_documents(docs.drop("n_chars"), model).count() == docs.count()
    assert quality_fm.keep_documents(docs, model).columns == docs.columns
    assert quality_fm.score_documents(docs.limit(0), model).count() == 0


def test_classifier_learns_from_long_documents_one_after_the_other(spark, monkeypatch):
    """The driver's heap never has the whole sample, and no batch's arrays are larger than PART_VALUES allows."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{x}" for x in rng.integers(0, 3000, 2000))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    said = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    params = quality_fm.FmParams(epochs=2, batch=16)
    whole = quality_fm.fit_quality(docs, said, params)

    def refused(*_):
        raise AssertionError("all rows at once")

    monkeypatch.setattr(type(docs), "collect", refused)
    monkeypatch.setattr(quality_fm, "PART_VALUES", 5000)
    sizes = []
    monkeypatch.setattr(quality_fm.Fm, "margins", lambda self, index, *a, f=quality_fm.Fm.margins: sizes.append(len(index)) or f(self, index, *a))
    parts = quality_fm.fit_quality(docs, said, params)
    assert sizes and max(sizes) <= 5000
    assert np.allclose(whole.w, parts.w, atol=1e-4) and np.allclose(whole.v, parts.v, atol=1e-4) and abs(whole.bias - parts.bias) < 1e-4


def test_spooled_rows_are_in_order():
    """As sorted() has them, also where the first bytes are equal."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        index = np.concatenate([np.arange(70), rng.integers(0, 3, rng.integers(0, 4))]).astype(np.int32)
        rows.append((int(k % 2), index.tobytes(), rng.integers(0, 2, len(index)).astype(np.float32).tobytes()))
    spooled = quality_fm.Spooled(iter(rows))
    assert [(int(y), x.tobytes(), v.tobytes()) for y, (x, v) in zip(spooled.labels, spooled, strict=True)] == sorted(rows)
    assert len(quality_fm.Spooled(iter([]))) == 0
