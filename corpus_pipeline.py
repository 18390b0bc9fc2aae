"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens; over the whole of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: null, empty and blank texts have no words and go in the first stage; of rows equal in doc_id and text
one stays; texts that share a doc_id and rows without doc_id are told apart by their texts; extra columns, of any name,
are carried along; an empty table gives an empty table; texts of any length are worked on whole. A passage of 200
bytes or more that two kept documents share is cut out of both, as the third operator defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paretide.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from paretide.llm.queries import tokenizer
from paretide.llm.shared import BROADCAST_KEYS, freed, only_keys, scratch, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))  # no name can clash
    judged = quality.judged(written(quality.features(packed).drop("text"), "quality"))
    return judged.filter("kept").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_k``, a key without nulls that equal rows share and rows with other texts don't.

    It is the doc_id where that names one text. Rows without doc_id, and all but one of the texts that share a doc_id,
    have a key of 62 bits made from doc_id and text, above 2 ** 62.
    """
    made = F.lit(2**62) + F.xxhash64("doc_id", "text").bitwiseAND(2**62 - 1)
    own = F.xxhash64("text")
    repeated = written(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), made).alias("_k"))
    several = only_keys(docs.select("doc_id", "text"), repeated, "doc_id").groupBy("doc_id").agg(F.min(own).alias("_first"))
    several = written(several, "several")
    small = several.count() <= BROADCAST_KEYS
    rows = docs.join(F.broadcast(several) if small else several.hint("shuffle_merge"), "doc_id", "left")
    plain = F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == own))
    return rows.select(*docs.columns, F.when(plain, F.col("doc_id").cast("long")).otherwise(made).alias("_k"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows without doc_id join their group by their text, and stay only in groups that have no doc_id. Rows equal in
    doc_id and text are one. Texts that share a doc_id but are not near duplicates all stay.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # no name can clash
    named = _named(packed)
    found = written(jaccard_join.op8(named.select(F.col("_k").alias("doc_id"), "text")), "classes")
    hint = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("shuffle_merge")
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_k")).distinct(), "gone")
    left = named.join(hint(gone), "_k", "left_anti")
    again = written(found.groupBy(F.col("doc_id").alias("_k")).count().filter("count > 1").select("_k"), "again")
    if again.limit(1).count():
        left = left.join(hint(again), "_k", "left_anti").unionByName(left.join(hint(again), "_k", "left_semi").dropDuplicates(["_k"]))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand anywhere else are cut out of the texts; every document stays."""
    return suffix_dedup.deduplicated(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages in higher demand are repeated by their rates; none is dropped."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.op6(docs, *tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: Weak supervision, suffix windows and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes once its result is written
            after = keep(written(stage(spark, docs, sf_dir), "stage"))
        freed(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
