"""Registered queries of this subpackage, with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that the labelled table marks as of quality 1."""
    from .kneser_ney import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as tox
    from .common import crc_mod

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = tox.learn(docs, tox.train_rows(table(spark, sf_dir, "labels")))
    return tox.score(docs, grammar).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "clauses")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the fixed patterns, as base_sha256 is; spans and n_secret hold what the field adds."""
    from .pii import KINDS, find_pii, labelled_table

    found = find_pii(table(spark, sf_dir, "documents"), labelled_table(spark))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in KINDS], "base_sha256", joined.alias("spans"), "n_secret")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as domains: the labelled table has the language of the documents that `labels` names."""
    from .mixing import mix_to_targets

    docs = table(spark, sf_dir, "documents")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    mixed, names = mix_to_targets(docs, known, MIX_TARGETS)
    return mixed.select("doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(names)], "rate")


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two rows that say control strings, numbered -1."""
    from . import reply_trees as rt

    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return rt.digests(rt.format_paths(rt.best_paths(rt.from_turns(rows))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"))


MIX_TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}

QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_suffix_tree, op3_pii, op4_token_counts, op5_kneser_ney, op6_url_templates, op7_ngram_join, op8_toxicity, op9_decontamination, op10_mixing, op11_reply_trees, op12_whitening, op13_alignment)}
_OP1 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
 SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = id) AS n_links, min(c) AS component_id, min(c) = id AS kept FROM r GROUP BY id"""

_OP7 = """WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
 r AS (SELECT doc_id AS id, doc_id AS c FROM t UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
 SELECT id AS doc_id, min(c) AS class_id, (SELECT count(*) FROM l WHERE l.a = id) AS n_links, min(c) = id AS kept FROM r GROUP BY id"""

#: The others hold a trained or an iterative part that SQL does not express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_near_vectors": _OP1, "op7_ngram_join": _OP7}
