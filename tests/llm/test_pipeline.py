"""The corpus pipeline, stage by stage, against the operators' own decisions."""

from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F
from folia.llm import op4_decontaminate, op7_toxicity, op8_simhash
from folia.llm.common import materialize, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    cols = docs.columns
    labels, items = table(spark, sf, "labels"), table(spark, sf, "benchmark")

    kept = materialize(cp.toxicity(spark, docs, sf), "t1")
    bad = {r["doc_id"] for r in op7_toxicity.score(docs, labels).filter("predicted = 1").collect()}
    assert kept.columns == cols and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    unique = materialize(cp.near_dedup(spark, kept, sf), "t2")
    groups = {r["component_id"] for r in op8_simhash.simhash_groups(kept).collect()}
    assert unique.columns == cols and sorted(r["doc_id"] for r in unique.collect()) == sorted(groups)

    clean = materialize(cp.decontaminate(spark, unique, sf), "t3")
    hit = {r["doc_id"] for r in op4_decontaminate.contaminated(unique, items).collect()}
    assert clean.columns == cols and {r["doc_id"] for r in clean.collect()} == groups - hit

    safe = cp.secrets(spark, clean, sf)
    assert safe.columns == cols and safe.count() == clean.count()
    mixed = cp.mixing(spark, safe, sf)
    assert mixed.count() > 0 and set(cols) <= set(mixed.columns)


def test_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scans", "mixing"]
    assert cp.run(spark, sf).count() > 0


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "s", 18), (None, "another without an id", "en", None, 21), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (4, "same words here", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 1, 3]


def test_repeated_and_missing_ids(spark, sf):
    """Each row is judged by its own text: ids may repeat, or be missing."""
    item = table(spark, sf, "benchmark").select("text").first()["text"]
    leak = f"before {item} after"
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, leak), (None, "clean without an id"), (7, leak), (7, "clean beside a leak of the same id"), (8, "clean")]
    got = cp.decontaminate(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], ddl), sf)
    assert sorted(got.select("doc_id", "text").collect(), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    one, two = "a text of several words that two documents share", "some other text that is not at all like the first"
    rows = [(2, one), (5, one), (5, two), (None, one), (None, two), (6, two), (None, "a third text, of rows without an id"), (None, "a third text, of rows without an id")]
    got = cp.near_dedup(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], ddl), sf)
    assert sorted(got.select("doc_id", "text").collect(), key=str) == sorted([rows[0], rows[2], rows[6]], key=str)
    labels = [(k, k % 2) for k in range(200)]
    docs = [(k, f"nasty w{k}" if k % 2 else f"kind w{k}") for k in range(200)] + [(None, "nasty"), (None, "kind"), (3, "kind"), (4, "nasty")]
    scored = spark.createDataFrame([(*r, "en", "s", 1) for r in docs], ddl)
    kept = cp.drop_toxic(scored, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not [r for r in kept.collect() if "nasty" in r["text"]] and kept.count() == 102
    safe = cp.redact(scored.withColumn("text", F.concat("text", F.lit(" token=abcdefghijkl123"))))
    assert safe.count() == len(docs) and not [r for r in safe.collect() if "token" in r["text"]]
    mixed = cp.mix(scored)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= set(docs) | {(i, w) for i, t in docs for w in t.split()}


def test_clashing_columns(spark, sf):
    names = ("__text", "__doc", "__id", "__n", "__i", "__p", "__keep", "fp", "component_id", "pieces", "size", "item_id", "score")
    docs = table(spark, sf, "documents")
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    plain = docs
    for _, stage in cp.STAGES[:-1]:
        plain, more = materialize(stage(spark, plain, sf), "plain"), materialize(stage(spark, more, sf), "more")
        assert sorted(map(tuple, more.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert more.filter(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0
    a, b = cp.mixing(spark, plain, sf), cp.mixing(spark, more, sf)
    assert sorted(map(str, b.select(*a.columns).collect())) == sorted(map(str, a.collect()))
    assert b.filter("`__n` <> concat('__n', doc_id)").count() == 0


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
