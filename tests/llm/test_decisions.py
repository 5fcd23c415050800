"""Blocks of items against one automaton, letters, samples of repeated ids, toxicity categories, documents that share an id."""

import pytest
from pyspark.sql import functions as F

from netweave.llm import decontaminate, langid, ngram_join, toxicity


def test_blocks_find_what_one_automaton_finds(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumnRenamed("source", "a.source").unionByName(docs.limit(0).withColumnRenamed("source", "a.source"))
    one = sorted(map(tuple, decontaminate.hit_words(docs, items).drop("spans").collect()))
    many = sorted(map(tuple, decontaminate.hit_words(docs, items, block_words=700).drop("spans").collect()))
    assert one == many and any(r[2] for r in one)


def test_the_stage_cuts_passages_and_drops_contaminated(spark):
    words = [f"w{k}" for k in range(400)]
    items = spark.createDataFrame([(1, " ".join(words[:15]))], "item_id long, text string")
    rows = [(1, " ".join(words)), (2, " ".join(words[:100])), (3, "clean"), (4, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)), items).collect()
    assert {r.doc_id: r.text for r in kept} == {1: " " + " ".join(words[15:]), 3: "clean", 4: None}


@pytest.mark.parametrize("text", ["² ½", "①", "Ⅷ", "12 _", "́", "😀", "", None])
def test_no_letter_no_language(text):
    assert langid.counts(text) is None


def test_rows_of_one_id_train_once(spark):
    rows = [(k, f"{'der die das und' if k % 2 else 'the and of to'} {k}", "de" if k % 2 else "en") for k in range(40)] * 5 + [(1, "other text", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.fit(df.repartition(7), 30), langid.fit(df.repartition(2), 30)
    assert a.langs == b.langs and (a.scores == b.scores).all()


def test_every_category_is_told_apart(spark):
    """Out-of-fold probabilities rank the documents of each category above the others."""
    sf = "/root/testdata/sf0.01"
    seen = {}
    original = toxicity.fit_chain

    def watched(vocabulary, x, y, fold, apart=None):
        seen["y"], seen["chain"] = y, original(vocabulary, x, y, fold, apart)
        return seen["chain"]

    toxicity.fit_chain = watched
    try:
        toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    finally:
        toxicity.fit_chain = original
    for name, y, p in zip(toxicity.CATEGORIES, seen["y"].T, seen["chain"].outside.T, strict=True):
        above = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
        assert 0 < y.sum() < len(y) and above > 0.6, (name, above)


def test_documents_that_share_an_id_are_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (6, b + " more"), (7, a), (None, a), (8, None), (8, None), (9, "own words only here and now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x.y", F.lit(1))
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.link_components(df).collect())
    assert found == sorted([(5, 36, 5), (5, 36, 5), (6, 37, 5), (7, 36, 5), (0, 36, 5), (8, 0, 8), (8, 0, 8), (9, 2, 9)])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, a), (5, b), (8, ""), (8, ""), (9, "own words only here and now")]


def test_copies_without_any_id_link(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(None, text), (None, text + " more"), (1, "some other words that stand alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_shingles for r in ngram_join.link_components(df).collect()) == [2, 36, 37]
    assert len(ngram_join.keep_one(df).collect()) == 2
