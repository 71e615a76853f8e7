"""The corpus pipeline: documents become packed training sequences in five stages.

Every stage works on all rows that the one before it kept, and every stage but the
last returns the columns of `documents`. ORACLE_SQL is None: a trained network and
a retrieval index have no SQL form, so the tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard, line_dedup, packing, tokens, toxicity
from corpusloom.llm.storage import bounded, materialize, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the network learns from the labels in sf_dir.

    Null and empty texts are scored as one empty window; repeated rows are judged
    alike; very long texts are scored whole; without labels nothing goes; an empty
    table stays empty. All columns stay, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _fresh(docs, "__toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    A line must be on three pages at least: a pair of copies is the next stage's matter.
    Null texts stay null, a null source is one site, repeated rows are pages of their
    own, an empty table stays empty. All rows and columns stay, whatever their names.
    """
    dropped = _fresh(docs, "__cut")
    cut = line_dedup.drop_boilerplate(docs, "source", min_pages=3, dropped_col=dropped)
    return cut.withColumn(
        "n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).drop(dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document: the smallest id, then the smallest hash of the text.

    Rows are judged by id and text together, so rows that share an id but no text
    are documents of their own. Rows without an id stay, and so do texts without
    words. Repeated rows of the document that stays are one document. An empty
    table stays empty. All columns stay, whatever their names.
    """
    own = docs.select(F.col("doc_id"), F.col("text"))
    found = materialize(jaccard.near_duplicates(own, keep_key=True).where("component is not null and doc_id is not null"), "near-copies")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    # Components of a single row need no decision.
    several = materialize(
        found.join(bounded(materialize(first, "first-of-component")), "component")
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key")))
        .select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
        .distinct(),
        "near-copies-gone",
    )
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(bounded(several), (docs["doc_id"] == F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")
    if found.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is null").unionByName(
            kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        )
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; rows are judged by id and text
    together; repeated rows are judged alike; an empty table stays empty. All
    columns stay, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, benchmark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids.

    Null texts count as empty (a piece of the end id), repeated rows are packed
    each, long texts are cut into pieces, an empty table gives no pieces. Other
    columns are ignored.
    """
    return packing.pack(docs, tokens.vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
