"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netweave.llm import bpe, decontaminate, html, langid, lm, media, ngram_join, pii, tokenfiles, toxicity

LONG = "lorem Ipsum 4111111111111111 a@b.example " * 200 + "dolor " * 40_000
TEXTS = [(0, None), (1, ""), (2, " \n\t"), (3, LONG), (4, "the same text twice over here"), (5, "the same text twice over here"), (5, "the same text twice over here"), (7, "ÄÖ ß 中文 😀"), (None, "no id at all, +1 (301) 555-0346"), (9, "you idiot clown scum")]
LABELS = [(9, 1), (4, 0), (5, 0), (3, None), (None, 1), (77, 1)]
ITEMS = [(1, "the same text twice"), (2, None), (3, ""), (None, "idiot clown")]
#: Columns that operators use inside.
EXTRA = {"n_words": "x", "r": "y", "spans": "z", "base": "b", "score": "s", "node": "n", "_gone": "g", "_row": "w"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") < 5, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda d, l, b: decontaminate.hit_words(d, b), "bpe": lambda d, l, b: bpe.encode_documents(d), "lm": lambda d, l, b: lm.score_documents(d), "media": lambda d, l, b: media.media_facts(d),
    "tokenfiles": lambda d, l, b: tokenfiles.token_index(d), "pii": lambda d, l, b: pii.find(d), "langid": lambda d, l, b: langid.identify(d), "ngram_join": lambda d, l, b: ngram_join.link_components(d),
    "toxicity": lambda d, l, b: toxicity.classify(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, docs, labels, benchmark):
    found = OPERATORS[name](docs, labels, benchmark).collect()
    assert len(found) == len(TEXTS)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in found)
    assert ids == sorted(-1 if i is None else i for i, _ in TEXTS)
    twice = [r.asDict() for r in found if r["doc_id"] == 5]
    if name == "tokenfiles":
        twice = [r | {"start": 0} for r in twice]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels, benchmark):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("place", range(5))
def test_stages_keep_columns(place, spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[place]
    done = stage(spark, docs, str(tmp_path))
    if place < 4:
        assert done.columns == docs.columns
    rows = done.collect()
    assert len(rows) <= len(TEXTS)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_defined_results(docs, labels, benchmark):
    hit = {r.doc_id: r for r in decontaminate.hit_words(docs, benchmark).collect()}
    assert (hit[4].n_hit, hit[4].n_items, hit[4].contaminated) == (4, 1, True) and hit[9].n_items == 1 and (hit[0].n_words, hit[0].contaminated) == (0, False)
    lang = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert lang[0].lang_pred == lang[1].lang_pred == lang[2].lang_pred == "und"
    near = {r.doc_id: r for r in ngram_join.link_components(docs).collect()}
    assert near[5].component_id == 4 and near[0].component_id == 0 and near[2].n_shingles == 0
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 9] and sum(r.doc_id is None for r in kept) == 1
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (found[3].n_email, found[3].n_card, found[None].n_phone) == (200, 200, 1)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[None] == "no id at all, [PHONE]" and clean[0] is None and clean[3] == "lorem Ipsum [CARD] [EMAIL] " * 200 + "dolor " * 40_000


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.example/", ""), (3, "x", "<p>one<p>two"), (3, "x", "<p>one<p>two")], "page_id long, url string, html string").withColumn("host", F.lit("h"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()) == [(1, "", 0), (2, "", 0), (3, "one\ntwo", 7), (3, "one\ntwo", 7)]
    assert html.extract(pages.limit(0)).collect() == []
