"""Windows, runs, intervals, samples, shards, chunks and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import latin, segment
from corpusloom.operators import joins, sequence
from corpusloom.plans.registry import Registry, table, texts
from corpusloom.sources.scratch import scratch_path
from corpusloom.streaming import chunks

Q = Registry()

#: Values below this are silent.
SILENT = 60.0


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of 20 channels in order of time as frames."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("channel"), "ts", "event_id", "value", "event_type")
    w = Window.partitionBy("channel").orderBy("ts", "event_id")
    return e.withColumn("frame", (F.row_number().over(w) - 1).cast("long"))


_FRAMES_SQL = "f AS (SELECT user_id % 20 AS channel, value, event_type, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS frame FROM events)"
_RUNS_SQL = f"""{_FRAMES_SQL}, g AS (SELECT channel, frame, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS k FROM f WHERE value < {SILENT}),
runs AS (SELECT channel, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS length FROM g GROUP BY channel, k HAVING count(*) >= 2)"""
#: Segments of a channel: 7 frames each.
_SEGS_SQL = "segs AS (SELECT channel, frame // 7 AS seg, min(frame) AS a, max(frame) + 1 AS b FROM f GROUP BY channel, frame // 7)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    r = sequence.islands(f, ["channel"], "frame", F.col("value") < SILENT, 2)
    return r.select("channel", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "length")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).withColumn("seg", F.floor(F.col("frame") / 7))
    return f.groupBy("channel", "seg").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b"))


@Q.add(f"WITH {_RUNS_SQL} SELECT channel, start, stop, length FROM runs")
def silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two silent frames."""
    return _runs(spark, sf_dir)


@Q.add(f"WITH {_RUNS_SQL}, {_SEGS_SQL} SELECT r.channel, start, stop, seg, a, b FROM runs r JOIN segs s ON r.channel = s.channel AND start < b AND a < stop")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent runs with the segments that they touch."""
    return joins.overlaps(_runs(spark, sf_dir), _segments(spark, sf_dir), ["channel"], 32).select("channel", "start", "stop", "seg", "a", "b")


@Q.add(f"""
WITH {_RUNS_SQL} SELECT f.channel, frame, start, stop FROM f LEFT JOIN runs r ON f.channel = r.channel AND start <= frame AND frame < stop WHERE event_type = 'purchase'
""")
def containing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silent run that holds each purchase, if one does."""
    p = _frames(spark, sf_dir).where("event_type = 'purchase'").select("channel", "frame")
    return joins.containing(p, _runs(spark, sf_dir).select("channel", "start", "stop"), ["channel"], "frame")


@Q.add(f"""
WITH {_RUNS_SQL}, c AS (SELECT channel, (start + stop) / 2.0 AS centre FROM runs)
SELECT f.channel, frame, coalesce(min(abs(frame - centre)), 1e9)::DOUBLE AS distance, coalesce(min(abs(frame - centre)), 1e9) <= 20 AS near
FROM f LEFT JOIN c ON f.channel = c.channel WHERE event_type = 'error' GROUP BY f.channel, frame
""")
def nearest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each error to the centre of the nearest silent run, 1e9 without any."""
    p = _frames(spark, sf_dir).where("event_type = 'error'").select("channel", "frame")
    c = _runs(spark, sf_dir).select("channel", ((F.col("start") + F.col("stop")) / 2.0).alias("centre"))
    return joins.nearest(p, c, ["channel"], "frame", "centre").withColumn("near", F.col("distance") <= 20)


@Q.add(f"WITH {_FRAMES_SQL} SELECT channel, frame, round(sum(value) OVER w - value, 4) AS start, round(sum(value) OVER w, 4) AS stop FROM f WINDOW w AS (PARTITION BY channel ORDER BY frame)")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of consecutive segments by running sums."""
    start, stop = sequence.offsets(["channel"], "frame", "value")
    out = _frames(spark, sf_dir).select("channel", "frame", start, stop)
    return out.select("channel", "frame", F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"))


@Q.add(f"""WITH {_FRAMES_SQL}, l AS (SELECT channel, frame, list(value) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v FROM f)
SELECT channel, frame, list_sort(v)[len(v) // 2 + 1] AS median FROM l""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the five values before each frame."""
    return _frames(spark, sf_dir).select("channel", "frame", sequence.running_upper_median("value", ["channel"], "frame", 5).alias("median"))


@Q.add("""
WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id * 7919 % 1009, doc_id) AS r FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 1009, doc_id) AS k FROM a WHERE r <= 2)
SELECT doc_id, lang, source FROM b WHERE k <= 10
""")
def capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents a language, at most two of a source, in a fixed shuffled order."""
    docs = texts(spark, sf_dir).select("doc_id", "lang", "source")
    order = [F.col("doc_id") * 7919 % 1009, F.col("doc_id")]
    return sequence.capped_selection(docs, "lang", "source", order, 2, 10)


@Q.add("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS l FROM documents)
SELECT doc_id, source FROM r WHERE l <= 7 OR i IN (SELECT k * l // 7 FROM range(7) AS t(k))
""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents of each source at even strides."""
    return sequence.stride_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 7)


@Q.add("SELECT doc_id, CAST(ntile(16) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents")
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 contiguous shards, the first ones one row longer."""
    return sequence.contiguous_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16)


@Q.add("""
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT source, doc_id, i, n_chars AS held, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN b.held + o.n_chars > 20000 THEN o.n_chars ELSE b.held + o.n_chars END, CASE WHEN b.held + o.n_chars > 20000 THEN b.batch + 1 ELSE b.batch END
  FROM b JOIN o ON o.source = b.source AND o.i = b.i + 1)
SELECT source, doc_id, batch FROM b
""")
def byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of at most 20,000 characters of each source in order."""
    return sequence.byte_batches(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 20000)


@Q.add()
def quota_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch of a 65/35 mix of two languages by length; rings go round."""
    docs = texts(spark, sf_dir).where("lang in ('en', 'de')").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return sequence.quota_epoch(docs, "lang", "doc_id", "n_chars", {"en": 650000.0, "de": 350000.0}, 1)


@Q.add()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document as offsets."""
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(segment.sentence_spans_udf("text")).alias("k", "s")).select("doc_id", "k", "s.start", "s.stop")


@Q.add()
def chunks_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 160 words of every document, by the batch chunker, in Arabic letters."""
    docs = texts(spark, sf_dir).select("doc_id", latin.transliterate(F.col("text")).alias("text"))
    return docs.select("doc_id", F.posexplode(segment.batch_chunks_udf(160)("text")).alias("k", "chunk"))


@Q.add(r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 12.0) AS BIGINT))) AS k, w FROM d)
SELECT doc_id, CAST(k AS INT) AS k, array_to_string(w[k * 12 + 1:k * 12 + 12], ' ') AS words FROM g
""")
def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of twelve words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.word_groups(F.col("text"), 12)).alias("k", "words"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streamed feeds: pieces of seven words in order, then a finish message."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", "text")
    pieces = c.select("request_id", "turn", F.posexplode(segment.word_groups(F.coalesce("text", F.lit("")), 7)).alias("k", "piece"))
    w = Window.partitionBy("request_id").orderBy("turn", "k")
    feeds = pieces.select("request_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.lit("feed").alias("type"), F.concat("piece", F.lit(" ")).alias("text"))
    ends = feeds.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).select("request_id", "seq", F.lit("finish").alias("type"), F.lit(None).cast("string").alias("text"))
    return feeds.unionByName(ends)


@Q.add()
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the streamed feeds, by a stateful streaming query that runs to the end of its input."""
    place = scratch_path(spark, "stream")
    conversation_messages(spark, sf_dir).write.parquet(f"{place}/in")
    source = spark.readStream.schema(chunks.MESSAGE).parquet(f"{place}/in")
    return chunks.run_to_end(spark, chunks.stream_chunks(source), f"{place}/out", f"{place}/state")


@Q.add()
def stream_chunks_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks from the complete table."""
    return chunks.batch_chunks(conversation_messages(spark, sf_dir))


@Q.add("""
SELECT event_id, user_id, CASE WHEN event_id // 100 = max(event_id // 100) OVER (PARTITION BY user_id) THEN 'current' ELSE 'stale' END AS state FROM events
""")
def stale_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of requests that a newer one of the same connection has displaced are stale."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 100).alias("request"))
    return chunks.stale_results(e, "user_id", "request").drop("request")


@Q.add("""
SELECT user_id, round(min(value) FILTER (WHERE event_type <> 'view') - min(value), 6) AS first_after, round(sum(value) / sum(value + 1), 6) AS rtf, count(*) AS chunks FROM events GROUP BY user_id
""")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to the first chunk and real-time factor of each request."""
    e = table(spark, sf_dir, "events").select(
        "user_id", F.col("value").alias("fed"), F.when(F.col("event_type") != "view", F.col("value")).alias("ready"), F.col("value").alias("spent"), (F.col("value") + 1).alias("length")
    )
    out = chunks.latency(e, "user_id", "fed", "ready", "spent", "length")
    return out.select("user_id", F.round("first_after", 6).alias("first_after"), F.round("rtf", 6).alias("rtf"), "chunks")


@Q.add("""
SELECT DISTINCT date_trunc('hour', ts) AS hour, event_type, count(*) OVER (PARTITION BY date_trunc('hour', ts), event_type) AS n FROM events
""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour and type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@Q.add(f"WITH {_FRAMES_SQL} SELECT channel, frame, first_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_type FROM f")
def next_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next type that is no view after each frame."""
    f = _frames(spark, sf_dir).withColumn("known", F.when(F.col("event_type") != "view", F.col("event_type")))
    return f.select("channel", "frame", sequence.next_value("known", ["channel"], "frame").alias("next_type"))


@Q.add(f"""WITH {_FRAMES_SQL}, x AS (SELECT channel, event_type, frame, row_number() OVER (PARTITION BY event_type ORDER BY channel, frame) AS r FROM f) SELECT event_type, channel, frame FROM x WHERE r <= 3""")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three examples of each type."""
    w = Window.partitionBy("event_type").orderBy("channel", "frame")
    return _frames(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("event_type", "channel", "frame")
