"""Training-corpus pipeline: quality rules, language ids, near-duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  What a stage keeps is written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconflow.llm import langid, minhash, packing, quality, secrets
from beaconflow.llm.common import hashed_sample, pin
from beaconflow.llm.queries import table, tokenizer_path

#: Below this mean probability a text is in none of the languages that were learned.
LEAST_LANGUAGE = 0.35
#: Labelled documents that the quality rules are learned from, at most.
LABELLED = 30_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list, which is learned from up to LABELLED of the ``labels``.

    Every row is judged by its own text; ids only join the labels, so rows without one teach nothing.
    """
    labels = pin(hashed_sample(table(spark, sf_dir, "labels").where("quality is not null"), LABELLED, ["doc_id"]), "labels")
    sample = docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id")
    rules = quality.learn(quality.statistics(sample), labels, sample=LABELLED)
    return quality.judge(quality.statistics(docs, keep=tuple(docs.columns)), rules).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; those without letters or language go.

    Row by row: a row without an id, or one whose id comes again, is judged like any other.
    """
    found = langid.predict(docs, langid.learn(docs), keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 %): the smallest by id, then by hash of the text.

    Every (id, text) is a node of its own, so rows of one id whose texts do not link all stay, and rows without an
    id are compared like any others (a row with an id goes before them).  Of rows equal in id and text the
    smallest by the other columns stays.
    """
    x = docs.withColumns({f"_t{i}": F.xxhash64(F.lit(i), F.col("text")) for i in (1, 2)})
    text = F.struct("_t1", "_t2")
    # an id names its document unless it is missing or has several texts: those (id, text) get numbers above all ids
    unclear = pin(x.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
                  .where("doc_id is null or lo < hi").select(F.col("doc_id").alias("_id")), "unclear")
    many = x.join(unclear, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_id", F.col("_t1").alias("_m1"), F.col("_t2").alias("_m2"))
    above = F.lit((docs.agg(F.max("doc_id")).first()[0] or 0) + 1)
    many = pin(many.distinct().withColumn("_number", above + F.monotonically_increasing_id()), "numbered")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_m1")) & (F.col("_t2") == F.col("_m2"))
    x = x.join(many, same, "left").withColumn("_node", F.coalesce("_number", "doc_id")).select(*docs.columns, "_node")
    found = minhash.near_duplicates(x.select("_node", "text"), key="_node", n=5, percent=80, bands=42, rows=6)
    found = found.join(many, F.col("_node") == F.col("_number"), "left").withColumn("_id", F.when(F.col("_number").isNull(), F.col("_node")).otherwise(F.col("_id")))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_m1", "_m2", "_node"))
    kept = found.groupBy("component_id").agg(first.alias("f")).select(F.col("f._node").alias("_node"))
    rest = [c for c in docs.columns if c != "text"]
    one = x.join(kept, "_node", "left_semi").groupBy("_node").agg(F.min(F.struct(*rest, "text")).alias("r"))
    return one.select("r.*").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; ``n_chars`` counts the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 1024.

    Rows without an id and rows that share one are packed each for itself.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Trained stages and spans of regular expressions are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
