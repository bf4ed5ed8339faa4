"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, ngram_join, pii, toxicity
from lodestone.llm.common import remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; the grammar is learned from labelled rows of the table.

    Every row is judged by its own text, whatever its id; null and empty texts stay. Repeated rows are judged alike. Other
    columns than those of documents, whatever their names, are left out.
    """
    labels = toxicity.train_rows(table(spark, sf_dir, "labels"))
    grammar = toxicity.learn(docs.select("doc_id", "text"), labels)
    marked = toxicity.mark(docs.select(*COLUMNS), grammar)
    return marked.where("predicted = 0").select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id.

    Texts without words are no one's duplicates and stay, every row. Different texts under one id, or under none, are
    judged apart; of rows that agree in id and text one stays.
    """
    return ngram_join.first_of_each_class(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged each, null ids too."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in angle brackets; n_chars is that of the new text.

    Null texts stay null, with null n_chars; repeated rows and null ids are rows as any other. Other columns than those of
    documents are left out.
    """
    found = pii.mask_rows(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the rate at which to draw each document. Domains are languages.

    The labelled table gives the domain of the documents whose id it has; all others, null ids among them, are classified
    by their text. Repeated rows have a rate each; null and empty texts have no tokens. Other columns are left out.
    """
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    mixed, _ = mixing.mix_to_targets(docs, known, TARGETS)
    return mixed.select("doc_id", "n_tokens", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("mixing", mix),
]

#: No stage but the row filters is SQL's to express: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again; of the written ones the last stays."""
    import uuid

    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before:
                remove(before)
            before = f"{folder}/{k}-{name}"
    return docs
