"""Work that may fail, be cut short or be shared: guarded rows, leases, boxed streams, simulated arrivals."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.segment import StreamChunker


def guarded(df: DataFrame, key: str, work: Callable[[dict], str], column: str = "result") -> DataFrame:
    """key, the result of `work` on each row, and status: ok, or what was raised. No row fails a task."""
    schema = df.select(key).schema.add(column, "string").add("status", "string")

    def one(row: dict) -> tuple:
        try:
            return row[key], work(row), "ok"
        except Exception as e:  # the contract of a worker: never raise
            return row[key], None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(r) for r in frame.to_dict("records")], columns=schema.names)

    return df.mapInPandas(run, schema)


class Leases:
    """Leases of named shards in a folder of any Hadoop file system: one holder each, until released or stale."""

    def __init__(self, spark: SparkSession, folder: str, stale: float = 300.0, clock: Callable[[], float] = time.time):
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        self.fs = self.path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stale, self.clock, self.own = stale, clock, uuid.uuid4().hex

    def take(self, name: str) -> bool:
        """Whether the lease is now held here. A finished shard is not leased again."""
        if self.fs.exists(self.path(f"{name}.done")):
            return False
        lease = self.path(f"{name}.lease")
        if self.fs.exists(lease) and self.clock() - self.fs.getFileStatus(lease).getModificationTime() / 1000 > self.stale:
            self.fs.delete(lease, False)  # its holder is gone
        try:
            out = self.fs.create(lease, False)  # fails if it is there
        except Exception:
            return False
        out.writeBytes(self.own)
        out.close()
        return True

    def finish(self, name: str, good: bool) -> None:
        """Give the lease back; a shard that went well is final."""
        if good:
            self.fs.create(self.path(f"{name}.done"), True).close()
        self.fs.delete(self.path(f"{name}.lease"), False)


def run_boxed(stream: DataFrame, path: str, checkpoint: str, seconds: float) -> bool:
    """Append a stream to Parquet for at most so many seconds; True when all there was is done. The next run goes on."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        return bool(query.awaitTermination(int(seconds) if seconds >= 1 else 1))
    finally:
        query.stop()


def arrivals(text: str, sizes: list[int], chunker: StreamChunker) -> list[tuple[int, int, str]]:
    """(characters that had arrived, characters in chunks so far, chunk) while a text arrives in pieces of the given sizes, in turn."""
    out: list[tuple[int, int, str]] = []
    at = consumed = turn = 0
    while at < len(text):
        piece = text[at : at + max(1, sizes[turn % len(sizes)])]
        at, turn = at + len(piece), turn + 1
        for chunk in chunker.feed(piece) + (chunker.finish() if at == len(text) else []):
            consumed += len(chunk)
            out.append((at, consumed, chunk))
    return out


def arrivals_udf(sizes: list[int], least: int, most: int):
    """arrivals over a column, sized in words."""
    import re

    from corpusloom.functions.segment import word_size

    @F.pandas_udf("array<struct<arrived:int,consumed:int,chunk:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            chunker = StreamChunker(word_size, least, most, re.compile(r"\w"))
            return [{"arrived": a, "consumed": c, "chunk": x} for a, c, x in arrivals(t or "", sizes, chunker)]

        return texts.map(one)

    return run
