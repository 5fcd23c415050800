"""The registered query of each training-data operator: production parameters, the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netweave.llm import bpe, decontaminate, html, langid, lm, media, ngram_join, permutation, pii, prefix_trie, spelling, tokenfiles, toxicity
from netweave.llm.common import prepare, table
from netweave.llm.oracles import OP1, OP9, OP12, OP13

Query = Callable[[SparkSession, str], DataFrame]


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(prepare(spark), sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_facts(table(prepare(spark), sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.hit_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_index(table(prepare(spark), sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(prepare(spark), sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(prepare(spark), sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(prepare(spark), sf_dir, "documents"), order=lm.DEEP)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(prepare(spark), sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(prepare(spark), sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest_neighbours(table(prepare(spark), sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(prepare(spark), sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(prepare(spark), sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_decontamination, op2_bpe, op3_language_model, op4_media, op5_token_files, op6_personal_data, op7_html, op8_language, op9_ngram_join, op10_toxicity, op11_nearest, op12_spelling, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op9_ngram_join": OP9, "op12_spelling": OP12, "op13_prefix_trie": OP13}
