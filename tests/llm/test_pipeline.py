"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

import corpus_pipeline
from quiver.llm import line_dedup, quality_fm, quality_rules
from quiver.llm.common import table
from tests.llm.tables import documents, prose
from tests.llm.test_duplicates import links_of, roots, word_sets
from tests.llm.test_tokens import check_packing


def test_stages(spark, sf):
    docs = said = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == said.columns
    rules = quality_rules.judge([r.text for r in said.collect()], quality_rules.fit_line_labels(said, labels), quality_rules.RuleParams())
    kept = [r for r, k in zip(said.collect(), rules["kept"], strict=True) if k]
    assert sorted(kept) == sorted(out["quality_rules"])
    params, model = quality_fm.FmParams(), quality_fm.fit_quality(said, labels)
    kept = [r for r in sorted(kept) if model.scores([quality_fm.features(r.text, r.n_chars, params)])[0] >= params.threshold]
    assert kept == sorted(out["quality_classifier"])
    places = {}
    for r in kept:
        for k, line in line_dedup.lines_of(r.text):
            places.setdefault(line, []).append((r.doc_id, k))
    lines = sorted(places, key=lambda x: places[x][0])
    found = roots(len(lines), links_of([line_dedup.shingles(x, 8) for x in lines]))
    first = {x: places[lines[found[i]]][0] for i, x in enumerate(lines)}
    left = []
    for r in kept:
        rest = [x for k, x in enumerate(r.text.split("\n")) if not x.strip() or first[x] == (r.doc_id, k)]
        if any(x.strip() for x in rest):
            left.append((r.doc_id, "\n".join(rest)))
    assert left == sorted((r.doc_id, r.text) for r in out["line_dedup"])
    found = roots(len(left), links_of(word_sets([t for _, t in left], 5)))
    left = [x for i, x in enumerate(left) if found[i] == i]
    assert left == sorted((r.doc_id, r.text) for r in out["near_dedup"])
    check_packing(out["best_fit_packing"], dict(left))


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and rows.columns[:2] == ["doc_id", "piece"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_dedup", "best_fit_packing"]


def test_stages_of_awkward_rows(spark, sf):
    """Null and repeated ids, null and empty texts, clashing names; then tables without rows."""
    from pyspark.sql import functions as F

    rows = documents(spark)
    awkward = rows.unionByName(rows).unionByName(rows.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    awkward = awkward.withColumns({x: F.lit(1) for x in ("_doc", "_gone", "quality", "text_hash", "component", "root", "length")}).cache()
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, awkward.filter("doc_id < 0")):
            out = stage(spark, docs, sf)
            n = out.count()
            assert n == 0 if docs is not awkward else n > 0 or name in ("quality_rules", "quality_classifier")
            if name != "best_fit_packing":
                assert out.columns == docs.columns and out.schema == docs.schema


def test_near_duplicates_under_one_id(spark, sf):
    """Each text of an id goes or stays for itself, and a row told twice stays once."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, c), (7, c), (8, b), (None, a), (None, a), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, text_hash string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    said = sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()), key=str)
    assert said == sorted([(3, a), (5, b), (7, c), (None, a), (None, a), (9, None), (9, None), (9, "")], key=str)
