"""Exact deduplication that no hot group can skew.

Copies are combined three times: inside each partition (map-side), by digest and
salt, and over all salts. Every stage groups by digest *and* full text, so two
texts are merged only when they are identical; the digest only spreads the work.
After the last stage a digest that holds a single text stands for that text, and
the rows find their group by digest alone. Digests that hold several texts keep
the text in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import bounded, materialize

#: A hot group is combined in so many tasks before its winners meet.
SALTS = 16


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """Group rows of identical text; the row with the largest id of a group stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null id never wins against another id; a group
    with null ids only has keep_id null and keeps its rows. Repeated rows count
    each; rows that tie for the largest id are all marked kept. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn(
        "sha", F.sha2(F.col("text"), 256)
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    # Spark's partial aggregation is the local stage: it combines the copies of a
    # partition before anything moves. The salt splits a hot group over tasks.
    by_salt = salted.groupBy("sha", "text", "salt").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("n")
    )
    # Dealt by digest alone, so that the merge of a digest's texts and the count
    # of them share one shuffle; a digest has at most `salts` rows a text here.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = (
        by_salt.repartition(n, "sha")
        .groupBy("sha", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )
    # Texts are needed beyond this point only where a digest has more than one.
    multi = F.count("*").over(Window.partitionBy("sha")) > 1
    groups = materialize(
        classes.withColumn("clash", multi)
        .where("n > 1 or clash")
        .select("sha", "keep_id", "n", F.when(F.col("clash"), F.col("text")).alias("clash_text")),
        "copies",
    )
    return _join_back(rows, groups, id_col)


def _join_back(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Single rows find no group; the rest take the group's winner and size."""
    clashes = groups.where("clash_text is not null").count() > 0
    left = rows if clashes else rows.drop("text")
    g = bounded(groups).alias("g")
    on = F.col("r.sha") == F.col("g.sha")
    if clashes:
        on &= F.col("g.clash_text").isNull() | (F.col("g.clash_text") == F.col("r.text"))
    keep = F.when(F.col("n").isNull(), F.col("r.id")).otherwise(F.col("keep_id"))
    return (
        left.alias("r")
        .join(g, on, "left")
        .select(
            F.col("r.id").alias(id_col),
            keep.alias("keep_id"),
            F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
            F.col("r.id").eqNullSafe(keep).alias("kept"),
            F.col("r.sha").alias("text_sha256"),
        )
    )
