"""Cases that every operator answers: empty tables, very long texts, repeated rows, nulls, columns with its own names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldgrid.llm import bag_minhash, decontamination, licenses, packing, pii, quality_rules, rule_ensemble, suffix_dedup, token_rollup, url_reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "a test's key"


def _tables(spark, path, docs, items=(), labels=(), pages=()):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_every_query_takes_empty_tables(spark, tmp_path):
    import __spark_entry__ as e

    _tables(spark, tmp_path, [])
    for name, query in e.queries().items():
        if name == "pipeline" or re.match(r"op\d", name):
            assert query(spark, str(tmp_path)).collect() == [], name


def test_nulls_in_every_column(spark, tmp_path):
    import __spark_entry__ as e

    _tables(spark, tmp_path, [(None,) * 5, (None,) * 5, (1, None, None, None, None)], [(None, None)], [(None, None, None)], [(None, None, None)] * 2)
    rows = {name: query(spark, str(tmp_path)).count() for name, query in e.queries().items() if re.match(r"op\d", name)}
    assert rows.pop("op4_token_counts") == 1 and rows.pop("op2_url_filters") == 2 and set(rows.values()) == {3}
    assert e.queries()["pipeline"](spark, str(tmp_path)).collect() == []


def test_very_long_texts(spark):
    g = random.Random(1)
    words = [f"w{g.randint(0, 30_000)}" for _ in range(300_000)]
    long, leak = " ".join(words), "these ten words are the benchmark item that must be found"
    other = " ".join([*words[:-3], "x", "y", "z"])
    docs = spark.createDataFrame([(1, f"{long} {leak}"), (2, other), (3, f"{long} mail anna@corp.com. Released under the MIT License.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.decontaminate(docs, items).collect()} == {1: 11, 2: 0, 3: 0}
    assert {r.doc_id: r.n_entities for r in pii.report(docs, KEY).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.doc_id: list(r.licenses) for r in licenses.scan(docs).collect()} == {1: [], 2: [], 3: ["MIT"]}
    assert {r.doc_id: r.class_id for r in bag_minhash.dedupe_classes(docs).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs, order=quality_rules.RULES).collect()} == {1: 300_011, 2: 300_000, 3: 300_007}
    assert {r.doc_id: r.n_removed >= len(long) - 30 for r in suffix_dedup.cut_repeats(docs).collect()} == {1: True, 2: True, 3: True}
    packed = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert len(packed) == 3 and all(r.n == r.d > 300_000 for r in packed)
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    assert rule_ensemble.classify(docs, labels).count() == 3
    page = spark.createDataFrame([(1, "http://a.example.org/es/" + "x" * 100_000)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, n long, bad long")
    assert url_reputation.judge_pages(page, none).first().verdict == "block"


def test_columns_with_the_operators_own_names(spark):
    text = "A river bends twice before it meets another stream and nobody counts the boats there."
    names = {"_row": 1, "_n": "x", "_t": 2, "_w": 3, "_why": "y", "_key": 4, "_h": 5, "key": 6, "node": "z", "list": 7, "f": 8, "h3": 9, "seed": 10}
    docs = spark.createDataFrame([(k, text + f" word{k}" * 3) for k in range(3)] + [(0, text + " word0" * 3)], "doc_id long, text string").select("*", *[F.lit(v).alias(c) for c, v in names.items()])
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    for kept, rows in ((quality_rules.keep(docs), 4), (bag_minhash.keep_one(docs), 3), (decontamination.clean(docs, items), 0), (pii.scrub(docs, KEY), 4)):
        assert kept.columns == docs.columns and kept.count() == rows
    for out in (quality_rules.judge(docs), bag_minhash.dedupe_classes(docs), decontamination.decontaminate(docs, items), pii.report(docs, KEY), licenses.scan(docs), suffix_dedup.cut_repeats(docs)):
        assert out.count() == 4
    pages = spark.createDataFrame([(1, "http://a.b/", 1, "x")], "page_id long, url string, host long, bad string")
    assert url_reputation.judge_pages(pages, spark.createDataFrame([], "page_id long, n long, bad long")).count() == 1


def test_compiled_rules_score_like_their_matrix(spark):
    g = np.random.default_rng(5)
    x = g.normal(0, 1, (300, 4)).round(1)
    y = ((x[:, 0] > 0.2) & (x[:, 1] <= 0.5) | (x[:, 2] > 1)).astype(float)
    rules = rule_ensemble.grow_rules(x, y)
    weights, bias = rule_ensemble.fit_lasso(rule_ensemble.rule_matrix(x, rules), y)
    model = rule_ensemble.Ensemble(list("abcd"), rules, weights, bias)
    assert 0 < np.count_nonzero(weights) < len(rules) and ((model.score(x) >= 0.5) == y).mean() > 0.95
    got = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").select("*", model.column().alias("s")).collect()
    by_hand = {tuple(r): s for r, s in zip(x.tolist(), model.score(x).tolist(), strict=True)}
    assert all(r.s == pytest.approx(by_hand[tuple(r)[:4]], abs=1e-12) for r in got)
    # a rule holds where each of its tests does
    for j, rule in enumerate(rules[:20]):
        assert (rule_ensemble.rule_matrix(x, [rule])[:, 0] == [all((v[k] <= at) == below for k, below, at in rule) for v in x]).all(), j


def test_equal_splits_and_repeated_labels_give_one_model(spark):
    rows = [(i, "good words here and there, quite many of them." if i % 2 else "BAD!!! BAD!!!") for i in range(60)] + [(3, "good words here and there, quite many of them.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (rule_ensemble.fit(d, labels) for d in (docs, docs.repartition(7)))
    assert one.rules == two.rules and np.allclose(one.weights, two.weights)


def test_rollup_of_no_documents(spark, tmp_path):
    assert token_rollup.load_corpus(spark, spark.createDataFrame([], DOCS), str(tmp_path / "r")).collect() == []


def test_pipeline_names_its_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
