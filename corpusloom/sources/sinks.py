"""Writers: reports, delimited files, keyed upserts, manifests, cards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_report(df: DataFrame) -> str:
    """A one-row DataFrame as a pretty JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("j")).first()["j"]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; quotes are doubled, other columns are left out."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_spreadsheet(df: DataFrame, path: str, count: str) -> None:
    """Like write_csv, sorted by a count, with a byte order mark before the header's first name."""
    first, *rest = df.columns
    df.orderBy(F.desc(count)).select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and new ones, the new ones in place of old ones with their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def manifest(files: DataFrame) -> DataFrame:
    """Name, size and SHA-256 of binary files (path, length, content)."""
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256")
    ).orderBy("name")


def dataset_card(counts: DataFrame) -> Column:
    """A text rendered from a one-row DataFrame with ok, failed and quarantined."""
    return F.format_string("# Dataset\n\n- ok: %d\n- failed: %d\n- quarantined: %d\n", "ok", "failed", "quarantined")


def source_literal(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """A mapping as source text, keys in order."""
    quoted = lambda c: F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    line = F.concat(F.lit("    "), quoted(key), F.lit(": "), quoted(value), F.lit(","))
    rows = F.array_sort(F.collect_list(F.struct(F.col(key), line.alias("line"))))
    return df.agg(
        F.concat(F.lit(f"{name} = {{\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n}\n")).alias("source")
    )


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming DataFrame appended to CSV files, resumable; returns the query."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_json_array(df: DataFrame, path: str) -> None:
    """All records as one JSON array in one file, streamed through a single task a row at a time."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            out = []
            for record in batch.column(0).to_pylist():
                out.append(lead + record if record else "]" if lead == "," else "[]")
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    end = df.sparkSession.range(1, numPartitions=1).select(F.lit(None).cast("string").alias("value"))
    records.unionByName(end).coalesce(1).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)
