"""Token-id files: whole texts as range-coded blocks, in ascending order of the id.

A file set is a folder of Parquet files written by Spark's committer, so any file
system that Spark reaches will do and a lost executor leaves no half-written
file. Each row is a segment of whole documents: their ids and lengths, where it
lies in the order, and its blocks (see rangecoder), each of which can be read and
checked alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import rangecoder, tokens
from corpusloom.llm.worker import task

#: A segment ends before it exceeds so many ids, a full block; a larger run of documents is one of its own.
SEGMENT_IDS = rangecoder.MAX_IDS
#: Text of a run: short, so that segments come near their size.
RUN_CHARS = tokens.CHUNK_CHARS
FORMAT = "part int, seq int, start long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def _writer(path: str, keep_space: bool, end_id: int | None, segment_ids: int):
    @task("tokens")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = tokens.encoder(path, keep_space).encode
        state = {"seq": 0, "start": 0}
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            row = {
                "part": part,
                "seq": state["seq"],
                "start": state["start"],
                "n_ids": len(flat),
                "doc_ids": list(docs),
                "lengths": np.concatenate(lengths).tolist(),
                "blocks": rangecoder.encode_ids(flat),
            }
            state["seq"] += 1
            state["start"] += len(flat)
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, texts in tokens.text_runs(batch, 1, RUN_CHARS):
                flat, n = encode(texts)
                if end_id is not None:
                    # One end id behind each document's ids.
                    flat = np.insert(flat, np.cumsum(n), end_id)
                    n = n + 1
                if docs and held + len(flat) > segment_ids:
                    yield segment()
                    docs, lengths, ids, held = [], [], [], 0
                docs += names[i : i + len(texts)]
                lengths.append(n)
                ids.append(flat)
                held += len(flat)
        if docs:
            yield segment()

    return write


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("blocks", pa.list_(pa.binary())),
    ]
)


def write_id_files(
    df: DataFrame,
    out: str,
    tokenizer_path: str,
    keep_space: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    partitions: int | None = None,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every text and write the ids to the folder `out` in ascending order of id_col.

    keep_space: whether the vocabulary's words carry the space before them.

    Null text counts as empty; a null id comes first; equal ids are ordered by a
    hash of their texts, and repeated rows are written each; an empty table gives
    an empty file set; a text of any length is encoded whole and may fill several
    blocks. Other columns are ignored.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, keep_space, end_id, segment_ids), FORMAT).write.option(
        "compression", "uncompressed"
    ).parquet(out)


@task("idfiles")
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = rangecoder.decode_ids(row["blocks"])
            if len(ids) != row["n_ids"]:
                raise ValueError("segment length differs from its blocks")
            n = np.array(row["lengths"], np.int64)
            ends = np.cumsum(n)
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), row["part"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - n, pa.int64()),
                    pa.array(n),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "id", "local_start", "n_tokens", "ids_crc32"],
            )


@task("idfiles")
def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = rangecoder.decode_ids(row["blocks"]).astype(np.int32)
            bounds = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int32))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))],
                names=["id", "ids"],
            )


def read_id_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every document of a file set."""
    return spark.read.schema(FORMAT).parquet(path).mapInArrow(_ids, "id long, ids array<int>").withColumnRenamed("id", id_col)


def read_id_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from its decoded ids.

    start counts the ids of all documents before it: one row per file gives the
    running total, which is all that is broadcast.
    """
    files = spark.read.schema(FORMAT).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    decoded = files.mapInArrow(_digest, "part int, id long, local_start long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(bases), "part").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
