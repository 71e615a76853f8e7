"""Readers: delimited and tolerant text files, sectioned files, audio, listings."""

from __future__ import annotations

import ast
import io
import json
import os
import re
import shutil
import time
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.signal import read_wav, wav_header


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A file with a header, every field a string."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)


def read_splits(spark: SparkSession, paths: dict[str, str], columns: list[str], sep: str = "|") -> DataFrame:
    """Several files one after another, each with its split's name."""
    out = None
    for split, path in paths.items():
        part = read_csv(spark, path, columns, sep).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str = "id", status: str = "status", known: list[str] | None = None) -> DataFrame:
    """Records of JSON lines; blank and malformed lines, records without a key or with an unknown status are skipped.

    file and line give the order of ingestion.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value"
    )
    rows = lines.where(F.trim("value") != "").select("file", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = rows.where(F.col(f"r.{key}").isNotNull())
    if known:
        good = good.where(F.col(f"r.{status}").isin(*known))
    return good.select("r.*", "file", "line")


def read_sections(lines: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Lines below a [name] header with that name; headers and blank lines go."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.nullif(F.regexp_extract(value, r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    filled = lines.withColumn("section", F.last(name, ignorenulls=True).over(w))
    return filled.where(name.isNull() & (F.trim(value) != "") & F.col("section").isNotNull())


def markdown_cells(text, start: str, stop: str):
    """Cells of the table lines between two anchors: split at | and /, without parentheses."""
    body = F.split_part(F.split_part(text, F.lit(start), F.lit(2)), F.lit(stop), F.lit(1))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"\([^)]*\)", ""), r"[|/]")))
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")


def source_literals(source: str) -> dict[str, object]:
    """Literal values that a Python source assigns at its top level."""
    out = {}
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            try:
                out[node.targets[0].id] = ast.literal_eval(node.value)
            except ValueError:
                continue
    return out


def log_counts(spark: SparkSession, path: str, needles: list[str]) -> DataFrame:
    """Lines of a log that contain each needle."""
    return spark.read.text(path).agg(*(F.count_if(F.col("value").contains(n)).alias(n) for n in needles))


def finished_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names of the files that exist and are not empty: what is done."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.col("path").endswith(suffix) & (F.col("length") > 0)).select(name.alias("name"), "length")


def read_csv_inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file with a header whose types are read off its values."""
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, quote='"', escape='"', multiLine=True)


def read_lookup(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """One field of a JSON document as look-up rows: the entries of a list (value) or of a map (key, value)."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    if isinstance(doc.schema[field].dataType, T.MapType):
        return doc.select(F.explode(field).alias("key", "value"))
    return doc.select(F.explode(field).alias("value"))


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 in each file) and value of all text files, to be ordered by file name, then line."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
        "value",
    )
    place = F.row_number().over(Window.partitionBy("file").orderBy("__block", "__id")) - 1
    return rows.select("file", place.alias("line"), "value")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """path, name, shape and values (row by row) of every array in NPZ files."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as found:
                    for name in found.files:
                        x = found[name]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([file]),
                                pa.array([name]),
                                pa.array([list(x.shape)], pa.list_(pa.int64())),
                                pa.array([np.asarray(x, np.float64).ravel()], pa.list_(pa.float64())),
                            ],
                            names=["path", "name", "shape", "values"],
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(arrays, "path string, name string, shape array<long>, values array<double>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            x, rate = read_wav(content.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([rate], pa.int32()), pa.array([x.astype("float32")], pa.list_(pa.float32()))],
                names=["path", "rate", "samples"],
            )


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, rate and samples of wave files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_decoded, "path string, rate int, samples array<float>")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [wav_header(c.as_py()) for c in batch.column("content")]
        cols = list(zip(*heads, strict=True)) if heads else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), *(pa.array(c, pa.int32()) for c in cols)], names=["path", "frames", "rate", "channels", "width"]
        )


def probe_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, frames, rate, channels and bytes of a sample."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_probed, "path string, frames int, rate int, channels int, width int")


def fetch(url: str, path: str, tries: int = 5, first: float = 1.0, sleep=time.sleep) -> int:
    """Download to a .part file and rename it when complete; failed tries wait twice as long each time. Returns the bytes."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as reply, open(f"{path}.part", "wb") as f:
                shutil.copyfileobj(reply, f)
            os.replace(f"{path}.part", path)
            return os.path.getsize(path)
        except OSError:
            if k == tries - 1:
                raise
            sleep(first * 2**k)
    raise AssertionError("not reached")


def fetch_all(urls: DataFrame, folder: str, url: str = "url", name: str = "name") -> DataFrame:
    """Download every URL to a shared folder, a task at a time; never raises: (name, bytes, error)."""

    def run(batches):
        for b in batches:
            rows = []
            for u, n in zip(b[url], b[name], strict=True):
                try:
                    rows.append((n, fetch(u, os.path.join(folder, n)), None))
                except (OSError, ValueError) as e:
                    rows.append((n, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "bytes", "error"])

    return urls.mapInPandas(run, "name string, bytes long, error string")


_NEXT = re.compile(r'<([^>]+)>;\s*rel="next"')


class ListingSource(DataSource):
    """Entries of a paged JSON listing; the next page is named by a Link header."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options["urls"].split(" ")
        self.tries = int(options.get("tries", "5"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        url = partition.value
        while url:
            for k in range(self.tries):
                try:
                    with urllib.request.urlopen(url, timeout=30) as reply:
                        entries, link = json.load(reply), reply.headers.get("Link", "")
                    break
                except OSError:
                    if k == self.tries - 1:
                        raise
            for e in entries:
                yield e["path"], int(e.get("size", 0))
            m = _NEXT.search(link)
            url = m[1] if m else None
