"""The chunker as a stateful stream: ordered fragments in, chunks and one last row out.

Messages of a request carry a sequence number. Rows of a micro-batch come in any
order; they are sorted, and what follows a gap waits in the state. A cancel
message empties the request; everything after a finish or cancel is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.segment import StreamChunker, word_size

MESSAGE = "request_id long, seq long, type string, text string"
OUTPUT = "request_id long, chunk long, text string, n_tokens long, status string"
STATE = "next long, chunk long, status string, pending string, carry string, held long, dropped long, waiting string"
_ANY_SPEECH = re.compile(r"\w")


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as rows; unknown types are refused by a null type."""
    r = F.from_json(column, MESSAGE)
    known = F.when(r["type"].isin("start", "feed", "finish", "interrupt"), r["type"])
    return raw.select(r["request_id"].alias("request_id"), r["seq"].alias("seq"), known.alias("type"), r["text"].alias("text"))


class _Request:
    """One request: messages in order through a chunker to output rows."""

    def __init__(self, key: int, least: int, most: int):
        self.key = key
        self.chunker = StreamChunker(word_size, least, most, _ANY_SPEECH)
        self.next, self.chunk, self.status, self.waiting = 0, 0, "open", {}

    def _row(self, text: str | None, status: str) -> tuple:
        row = (self.key, self.chunk, text, word_size(text) if text else 0, status)
        self.chunk += 1
        return row

    def push(self, seq: int, kind: str, text: str) -> list[tuple]:
        self.waiting[seq] = (kind, text)
        out: list[tuple] = []
        while self.next in self.waiting:
            kind, text = self.waiting.pop(self.next)
            self.next += 1
            if self.status != "open":
                continue  # after the end: refused
            if kind == "feed":
                out += [self._row(c, "chunk") for c in self.chunker.feed(text or "")]
            elif kind == "finish":
                out += [self._row(c, "chunk") for c in self.chunker.finish()]
                self.status = "done"
                out.append(self._row(None, "end"))
            elif kind == "interrupt":
                self.chunker.restore(("", "", 0, 0))
                self.status = "cancelled"
                out.append(self._row(None, "cancelled"))
        return out


def _handler(least: int, most: int):
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = _Request(int(key[0]), least, most)
        if state.exists:
            r.next, r.chunk, r.status, pending, carry, held, dropped, waiting = state.get
            r.chunker.restore((pending, carry, held, dropped))
            r.waiting = {int(k): tuple(v) for k, v in json.loads(waiting).items()}
        out: list[tuple] = []
        for b in batches:
            for seq, kind, text in sorted(zip(b["seq"], b["type"], b["text"], strict=True), key=lambda x: x[0]):
                out += r.push(int(seq), kind, text)
        state.update((r.next, r.chunk, r.status, *r.chunker.state(), json.dumps(r.waiting)))
        yield pd.DataFrame(out, columns=["request_id", "chunk", "text", "n_tokens", "status"])

    return run


def stream_chunks(messages: DataFrame, least: int = 12, most: int = 144) -> DataFrame:
    """Chunks of a streaming DataFrame of messages."""
    return messages.groupBy("request_id").applyInPandasWithState(
        _handler(least, most), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def batch_chunks(messages: DataFrame, least: int = 12, most: int = 144) -> DataFrame:
    """The same rows from a complete table of messages."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _Request(int(pdf["request_id"].iloc[0]), least, most)
        out = [row for seq, kind, text in sorted(zip(pdf["seq"], pdf["type"], pdf["text"], strict=True), key=lambda x: x[0]) for row in r.push(int(seq), kind, text)]
        return pd.DataFrame(out, columns=["request_id", "chunk", "text", "n_tokens", "status"])

    return messages.groupBy("request_id").applyInPandas(run, OUTPUT)


def run_to_end(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there, write it as Parquet, and read it back. A second call goes on where the first one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stale_results(results: DataFrame, connection: str, request: str) -> DataFrame:
    """Results with their status: current if they belong to the connection's newest request, else stale."""
    newest = results.groupBy(connection).agg(F.max(request).alias("__newest"))
    joined = results.join(newest, connection)
    return joined.withColumn("state", F.when(F.col(request) == F.col("__newest"), "current").otherwise("stale")).drop("__newest")


def latency(chunks: DataFrame, request: str, fed: str, ready: str, spent: str, length: str) -> DataFrame:
    """Per request: time to the first chunk, real-time factor and number of chunks."""
    return chunks.groupBy(request).agg(
        (F.min(ready) - F.min(fed)).alias("first_after"), (F.sum(spent) / F.sum(length)).alias("rtf"), F.count("*").alias("chunks")
    )


def evict_jobs(jobs: DataFrame, created: str, now: float, ttl: float, keep: int) -> DataFrame:
    """Jobs younger than the time to live, at most the `keep` newest."""
    return jobs.where(F.col(created) > now - ttl).orderBy(F.desc(created)).limit(keep)
