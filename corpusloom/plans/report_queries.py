"""Categories, samples, updates, sinks and small reports."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import reports, sequence
from corpusloom.plans.registry import Registry, table
from corpusloom.plans.sequence_queries import _FRAMES_SQL, _RUNS_SQL, _frames, _runs
from corpusloom.sources import readers, sinks
from corpusloom.sources.scratch import scratch_path as _scratch

Q = Registry()


@Q.add("""
SELECT CASE WHEN doc_id % 20 <> 0 AND n_chars <= 3000 AND length(source) <= 4 THEN 'train_pool' WHEN doc_id % 20 <> 0 THEN 'train_borderline' ELSE 'val' END AS pool, count(*) AS n FROM documents GROUP BY pool
""")
def pool_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by pool."""
    split = F.when(F.col("doc_id") % 20 != 0, "train").otherwise("val")
    pool = reports.pool_category(split, F.col("n_chars"), F.length("source"), 3000, 4).alias("pool")
    return table(spark, sf_dir, "documents").groupBy(pool).agg(F.count("*").alias("n"))


@Q.add("""
SELECT event_id, least(greatest(value, 20.0), 80.0) AS value, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind FROM events
""")
def clamped_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values within bounds, types from a list."""
    return table(spark, sf_dir, "events").select(
        "event_id", reports.clamp(F.col("value"), 20.0, 80.0).alias("value"), reports.allowed(F.col("event_type"), ["view", "click"], "other").alias("kind")
    )


@Q.add(f"""
WITH {_RUNS_SQL}, t AS (SELECT channel, count(*) AS frames FROM f GROUP BY channel),
p AS (SELECT t.channel, frames, s FROM t, LATERAL (SELECT unnest(range(0, frames - 5 + 1)) AS s)),
h AS (SELECT p.channel, p.s, bool_or(r.start IS NOT NULL) AS hit FROM p LEFT JOIN runs r ON r.channel = p.channel AND p.s < r.stop AND r.start < p.s + 5 GROUP BY p.channel, p.s)
SELECT channel, round(count(*) FILTER (WHERE hit) / count(*), 6) AS chance FROM h GROUP BY channel
""")
def random_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that five frames placed at random touch a silent run: exact, no draws."""
    total = _frames(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("frames"))
    return reports.expected_hits(_runs(spark, sf_dir), ["channel"], total, 5).withColumn("chance", F.round("chance", 6))


@Q.add("""
WITH t AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS seen_the, len(list_filter(w, lambda x: x = 'de')) AS seen_de FROM t
""")
def exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two tokens stand in each document."""
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    the, de = reports.exposure(words, ["the", "de"])
    return table(spark, sf_dir, "documents").select("doc_id", the.cast("long").alias("seen_the"), de.cast("long").alias("seen_de"))


@Q.add("""
WITH t AS (SELECT doc_id, list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, list_position(w, 'with') AS k FROM t)
SELECT doc_id, array_to_string(w[greatest(k - 3, 1):k + 3], ' ') AS context FROM p WHERE k > 0
""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words on either side of the first match."""
    words = F.filter(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", reports.context_window(words, "with", 3).alias("context")).where("context is not null")


@Q.add(f"WITH {_FRAMES_SQL} SELECT channel, frame, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS word FROM f")
def position_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators before each frame."""
    return _frames(spark, sf_dir).select("channel", "frame", reports.word_index(F.col("event_type") == "view", ["channel"], "frame").alias("word"))


@Q.add("""
SELECT p_partkey, p_brand, CASE p_size WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS rank FROM part ORDER BY rank, p_retailprice DESC, p_partkey LIMIT 25
""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 parts by a list of priorities, then price."""
    rank = reports.by_priority(F.col("p_size"), [9, 3])
    return table(spark, sf_dir, "part").withColumn("rank", rank).orderBy("rank", F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_brand", "rank")


@Q.add("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[0-9]+$') ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) DESC, c_name LIMIT 1")
def newest_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name with the largest number at its end."""
    return reports.newest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", r"(\d+)$")


@Q.add("""
WITH f AS (SELECT p_brand AS k, p_type AS form, min(p_partkey) AS o FROM part GROUP BY ALL), l AS (SELECT k, list(form ORDER BY o) AS v FROM f GROUP BY k)
SELECT k, v[1] AS form, array_to_string(v[2:], '|') AS alternates FROM l
""")
def dedup_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First form of each key and its other forms in order."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_type").alias("form"), "p_partkey")
    return reports.dedup_with_alternates(p, "k", "form", "p_partkey").withColumn("alternates", F.array_join("alternates", "|"))


@Q.add("""SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'renamed' ELSE n_name END AS n_name FROM nation""")
def audited_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a checked change."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    old = n.where("n_nationkey = 3").select("n_nationkey", F.lit("renamed").alias("new"), F.col("n_name").alias("old"), F.lit("test").alias("why"))
    return reports.audited_update(n, old, "n_nationkey", "n_name")[0]


@Q.add("""
WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 31 % 101, doc_id) AS r FROM documents)
SELECT doc_id, lang FROM s WHERE r <= CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 3 ELSE 0 END
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven and three documents of two languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reports.stratified(docs, "lang", [F.col("doc_id") * 31 % 101, F.col("doc_id")], {"en": 7, "de": 3})


@Q.add("""
WITH m AS (SELECT doc_id FROM documents WHERE doc_id IN (5, 7)), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (5, 7) ORDER BY doc_id LIMIT 10) FROM m UNION ALL FROM r
""")
def guaranteed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents, two of which must be there."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return reports.with_guaranteed(docs, docs.where("doc_id in (5, 7)"), "doc_id", 12, "doc_id")


@Q.add("""
WITH c AS (SELECT CASE WHEN turn = 0 THEN 'first' ELSE 'retry' END AS kind, length(text) AS chars, length(text) // 4 AS prompt, length(text) // 8 AS completion FROM conversations)
SELECT kind, count(*) AS calls, sum(chars)::BIGINT AS chars, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round((sum(prompt) + sum(completion)) / count(*), 4) AS per_call FROM c GROUP BY kind
""")
def token_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by kind."""
    n = F.length("text").cast("long")
    calls = table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") == 0, "first").otherwise("retry").alias("kind"), n.alias("chars"), F.floor(n / 4).alias("prompt"), F.floor(n / 8).alias("completion")
    )
    return reports.call_accounting(calls)


@Q.add("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(list_max(list_transform(e, lambda x: abs(x))), 5) AS peak, round(len(list_filter(e, lambda x: abs(x) < 0.1)) / len(e), 5) AS silent, round(len(list_filter(e, lambda x: abs(x) >= 0.9)) / len(e), 5) AS clipped FROM e
""")
def signal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, silent share and clipped share of each array."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    cols = reports.signal_audit(x, 0.1, 0.9)
    return table(spark, sf_dir, "embeddings").select("vec_id", *cols).select("vec_id", *(F.round(c, 5).alias(c) for c in ("peak", "silent", "clipped")))


@Q.add(f"WITH {_RUNS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY length DESC, start) AS r FROM runs) SELECT channel, (start + stop) / 2.0 AS centre, length FROM b WHERE r = 1")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of the longest silent run of each channel."""
    best = _runs(spark, sf_dir).groupBy("channel").agg(F.max_by(F.struct("start", "stop", "length"), F.struct("length", -F.col("start"))).alias("r"))
    return best.select("channel", ((F.col("r.start") + F.col("r.stop")) / 2.0).alias("centre"), F.col("r.length").alias("length"))


@Q.add("SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, with quotes and line feeds, written as CSV and read back."""
    path = _scratch(spark, "csv")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sinks.write_csv(docs, path, ["doc_id", "text", "lang"])
    return readers.read_csv(spark, path, ["doc_id", "text", "lang"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@Q.add("SELECT user_id AS id, max_by(event_type, event_id) AS status FROM events GROUP BY user_id")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended as JSON lines, read tolerantly, the latest one of each unit kept."""
    path = _scratch(spark, "jsonl")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "event_id")
    sinks.append_jsonl(e.where("event_id % 2 = 0"), path)
    sinks.append_jsonl(e.where("event_id % 2 = 1"), path)
    rows = readers.read_jsonl(spark, path, "id long, status string, event_id long")
    w = Window.partitionBy("id").orderBy(F.desc("event_id"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "status")


@Q.add("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sinks.upsert(c, c.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@Q.add("""
SELECT item_id, sha256(text) AS sha256, length(text) AS n FROM benchmark
""")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of every item."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n"))


@Q.add("""
SELECT '# Dataset' || chr(10) || chr(10) || '- ok: ' || count(*) FILTER (WHERE event_type = 'purchase') || chr(10) || '- failed: ' || count(*) FILTER (WHERE event_type = 'error') || chr(10) || '- quarantined: ' || count(*) FILTER (WHERE event_type = 'signup') || chr(10) AS card FROM events
""")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card rendered from counts."""
    n = lambda t, name: F.count_if(F.col("event_type") == t).alias(name)
    one = table(spark, sf_dir, "events").agg(n("purchase", "ok"), n("error", "failed"), n("signup", "quarantined"))
    return one.select(sinks.dataset_card(one).alias("card"))


@Q.add("""
WITH s AS (SELECT * FROM (VALUES ('the'), ('on'), ('re')) AS v(stem)), p AS (SELECT * FROM (VALUES ('o'), ('w'), ('in')) AS v(prefix)),
w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w)
SELECT stem, prefix, n FROM s, p JOIN w ON w.w = prefix || stem
""")
def prefixed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of prefixed forms of three stems."""
    counts = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    stems = spark.createDataFrame([("the",), ("on",), ("re",)], "stem string")
    return reports.prefixed_forms(stems, "stem", ["o", "w", "in"], counts, "w", "n")


@Q.add("SELECT n_name, r_name FROM nation, region")
def cross_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every region: a product of two stated lists."""
    return reports.cross_product(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


@Q.add("""
WITH d AS (SELECT side, count(*) AS dead FROM (SELECT user_id % 2 AS side, user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')) GROUP BY side)
SELECT bool_and(dead <= 150) AS complete, sum(dead)::BIGINT AS dead FROM d
""")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are there no more dead letters than allowed on either side?"""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").select("user_id")
    dead = e.where("event_type = 'error'").join(done, "user_id", "left_anti").groupBy((F.col("user_id") % 2).alias("side")).agg(F.count("*").alias("dead"))
    return dead.agg(reports.complete(F.lit(0), F.col("dead"), 150).alias("complete"), F.sum("dead").alias("dead"))


@Q.add("""
WITH d AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS reason FROM events) SELECT reason, count(*) AS n FROM d GROUP BY reason
""")
def dead_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by reason."""
    reason = F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("reason")
    return table(spark, sf_dir, "events").groupBy(reason).agg(F.count("*").alias("n"))


@Q.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every order by key, without a sort in one task."""
    return sequence.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
