"""The thin queries over the operators of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document's whole text."""
    from corpusloom.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, neighbours together."""
    from corpusloom.llm.packing import pack
    from corpusloom.llm.tokens import vocabulary_path

    docs = _table(spark, sf_dir, "documents")
    return pack(docs, vocabulary_path("byte_bpe_50k.json"), with_ids=False)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the base spans and those that the method adds."""
    from corpusloom.llm.pii import BASE_KINDS, find_pii

    out = find_pii(_table(spark, sf_dir, "documents"))
    added = F.transform(
        "added", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    )
    spans = F.array_join(F.filter(F.concat(F.array("base"), added), lambda x: x != ""), ",")
    return out.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", spans.alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that lie in windows of benchmark items."""
    from corpusloom.llm.decontaminate import contamination

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate at their source."""
    from corpusloom.llm.line_dedup import drop_boilerplate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lines_dropped"
    )


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to range-coded files and read back."""
    from corpusloom.llm.idfiles import read_id_digests, write_id_files
    from corpusloom.llm.storage import scratch_path
    from corpusloom.llm.tokens import vocabulary_path

    out = scratch_path(spark, "id-files")
    docs = _table(spark, sf_dir, "documents")
    write_id_files(docs, out, vocabulary_path("word_bpe_49k.json"), keep_space=False, end_id=2)
    return read_id_digests(spark, out)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 contiguous shards of nearly equal bytes."""
    from corpusloom.llm.sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the winner and size of its group of identical texts."""
    from corpusloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and its component of near copies."""
    from corpusloom.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, judged by how many owners and repositories share each."""
    from corpusloom.llm.secrets import BASE_KINDS, scan_secrets

    out = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    counts = [
        F.size(of_kind(k)).cast("long").alias(f"n_{k}")
        for k, *_ in BASE_KINDS
    ]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"),
        verdict("example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).alias("most_repositories"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_personal_data": op3_personal_data,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_id_files": op6_id_files,
    "op7_byte_shards": op7_byte_shards,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scan": op10_secret_scan,
}
