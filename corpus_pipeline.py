"""A corpus cleaned in five stages: toxic documents go, one document of each group of near copies stays, contaminated
documents go, personal data is redacted, and the rest is encoded to token ids.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as docs, written as Parquet in between.
All stages keep null and empty texts, unless they are copies by id; a text of any length is read whole, and an empty
table stays empty. Columns besides doc_id and text may have any names and pass unchanged, but for n_chars, which
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import bpe, decontaminate, ngram_join, pii, toxicity
from netweave.llm.common import prepare, stored, table


def counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. Repeated rows stay or go together; null texts stay."""
    return toxicity.drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of the shingle join; repeated rows count as copies, rows without words stay each."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make less than a twentieth, with these passages cut out; repeated rows stay or go together."""
    return counted(decontaminate.drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    prepare(spark)
    return counted(pii.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text's token ids, and digests of the ids and of the text decoded from them; a null text has no tokens."""
    prepare(spark)
    return docs.select("doc_id", bpe.encode_and_digest(F.col("text")).alias("r")).select("doc_id", "r.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]

#: SQL expresses neither the trained models nor the components of the join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result but the last is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stored(docs)
    return docs
