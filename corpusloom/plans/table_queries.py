"""Statistics, joins and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import signal
from corpusloom.operators import joins, sequence, stats
from corpusloom.plans.registry import Registry, table

Q = Registry()

_STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'quarantined' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: user = id, event_id = order of arrival."""
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "quarantined")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", status.alias("status"), "value", "props")


@Q.add(f"""
WITH r AS (SELECT user_id AS id, event_id, {_STATUS_SQL} AS status FROM events),
k AS (SELECT *, CASE status WHEN 'quarantined' THEN 3 WHEN 'ok' THEN 2 ELSE 1 END AS rank FROM r WHERE status IS NOT NULL)
SELECT id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, event_id DESC) AS n FROM k) WHERE n = 1
""")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a unit: quarantined before ok before failed, the latest of equal ones."""
    r = _records(spark, sf_dir).select("id", "event_id", "status")
    return sequence.precedence_merge(r, "id", "status", "event_id", {"quarantined": 3, "ok": 2, "failed": 1})


@Q.add(f"""
WITH r AS (SELECT user_id AS id, {_STATUS_SQL} AS status FROM events),
s AS (SELECT id, bool_or(status IN ('ok', 'quarantined')) AS done FROM r WHERE status IS NOT NULL GROUP BY id)
SELECT c_custkey AS id, CASE WHEN s.id IS NULL THEN 'missing' ELSE 'failed' END AS why FROM customer LEFT JOIN s ON c_custkey = s.id WHERE NOT coalesce(done, false)
""")
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units to be tried again: failed everywhere or without a record."""
    inputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return sequence.retry_set(inputs, _records(spark, sf_dir).where("status is not null"), "id", "status", ["ok", "quarantined"])


@Q.add(f"""
SELECT user_id % 2 AS split, {_STATUS_SQL} AS status, count(*) AS n FROM events WHERE {_STATUS_SQL} IS NOT NULL GROUP BY ROLLUP (user_id % 2, {_STATUS_SQL})
""")
def status_split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by split and status with their totals."""
    r = _records(spark, sf_dir).where("status is not null").withColumn("split", F.col("id") % 2)
    return r.rollup("split", "status").agg(F.count("*").alias("n"))


@Q.add(f"""
WITH a AS (SELECT user_id, count(*) AS attempts FROM events WHERE {_STATUS_SQL} = 'ok' GROUP BY user_id) SELECT attempts, count(*) AS units FROM a GROUP BY attempts
""")
def attempts_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units have how many ok records."""
    a = _records(spark, sf_dir).where("status = 'ok'").groupBy("id").agg(F.count("*").alias("attempts"))
    return a.groupBy("attempts").agg(F.count("*").alias("units"))


@Q.add("""
WITH f AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type AS fix, count(*) FILTER (WHERE k IS NOT NULL) AS touched, CAST(sum(k) AS BIGINT) AS operations FROM f GROUP BY event_type
""")
def fix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that carry a counter, and its sum: an empty counter counts as carried."""
    bag = F.from_json("props", "map<string,bigint>")
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(bag).alias("name", "k"))
    return rows.where("name = 'k'").groupBy(F.col("event_type").alias("fix")).agg(F.count("*").alias("touched"), F.sum("k").alias("operations"))


@Q.add("""
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
q AS (SELECT g, max(n) AS n, max(v) FILTER (WHERE i = floor(0.1 * (n + 1))) AS a, max(v) FILTER (WHERE i = floor(0.1 * (n + 1)) + 1) AS b,
  max(0.1 * (n + 1) - floor(0.1 * (n + 1))) AS d, max(v) FILTER (WHERE i = floor(0.9 * (n + 1))) AS a9, max(v) FILTER (WHERE i = floor(0.9 * (n + 1)) + 1) AS b9,
  max(0.9 * (n + 1) - floor(0.9 * (n + 1))) AS d9 FROM r GROUP BY g)
SELECT g AS l_returnflag, round(a + (b - a) * d, 4) AS p10, round(a9 + (b9 - a9) * d9, 4) AS p90 FROM q
""")
def summary_stats_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 % and 90 % quantiles by the exclusive method."""
    out = stats.exclusive_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.9])
    return out.select("l_returnflag", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))


@Q.add("""
SELECT l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY l_linestatus
""")
def summary_stats_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary with interpolated quantiles."""
    v = "l_extendedprice"
    q = lambda p: F.round(F.percentile(v, F.lit(p)), 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.min(v).alias("min"), F.max(v).alias("max")
    )


@Q.add("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n_chars AS median_upper FROM r WHERE i = n // 2 + 1
""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of two middle lengths."""
    return stats.upper_median(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@Q.add("""
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, count(*) AS n, round(avg(v), 5) AS mean, round(greatest(stddev_pop(v), 0.001), 5) AS std FROM x WHERE v > 0 GROUP BY label
""")
def population_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the values above zero."""
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", F.col("x").cast("double").alias("v")).where("v > 0")
    mean, std, n = stats.population_moments(F.col("v"))
    out = x.groupBy("label").agg(mean, std, n)
    return out.select("label", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@Q.add("""
SELECT n_name, count(*) AS clips, round(sum(l_quantity) * 256 / 22050 / 3600, 6) AS hours FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def hours_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and hours by nation; frames are quantities."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # Sums by supplier first: the join sees one row a supplier.
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    return per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(
        F.sum("c").alias("clips"), F.round(F.sum("q") * 256 / 22050 / 3600, 6).alias("hours")
    )


@Q.add("""
SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY ROLLUP (source, lang)
""")
def share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and language, with totals and percentages; one pass."""
    rolled = table(spark, sf_dir, "documents").rollup("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level")
    )
    total = F.max(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy())
    # The window is over one row a group, not over documents.
    return rolled.withColumn("share", F.round(100.0 * F.col("n") / total, 4)).drop("level")


@Q.add("""
WITH x AS (SELECT c_acctbal AS b, c_acctbal > 0 AS s1, c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AS s2, c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey < 15 AS s3 FROM customer)
SELECT * FROM (SELECT 0 AS step, 'positive' AS name, count(*) FILTER (WHERE s1) AS rows, round(coalesce(sum(b) FILTER (WHERE s1), 0), 2) AS amount FROM x
UNION ALL SELECT 1, 'segment', count(*) FILTER (WHERE s2), round(coalesce(sum(b) FILTER (WHERE s2), 0), 2) FROM x
UNION ALL SELECT 2, 'nation', count(*) FILTER (WHERE s3), round(coalesce(sum(b) FILTER (WHERE s3), 0), 2) FROM x)
""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of customers and their balances after each filter."""
    steps = [("positive", F.col("c_acctbal") > 0), ("segment", F.col("c_mktsegment") != "BUILDING"), ("nation", F.col("c_nationkey") < 15)]
    return stats.funnel(table(spark, sf_dir, "customer"), steps, "c_acctbal").withColumn("amount", F.round("amount", 2))


@Q.add("""
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type),
n AS (SELECT e.event_type, median(value) AS near, count(*) AS k FROM events e JOIN m ON e.event_type = m.event_type WHERE value > m / 1.6 AND value < m * 1.6 GROUP BY e.event_type)
SELECT m.event_type, round(CASE WHEN k >= 3 THEN near ELSE m END, 6) AS center FROM m LEFT JOIN n ON m.event_type = n.event_type
""")
def robust_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median after far values are left out."""
    return stats.robust_center(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("center", F.round("center", 6))


@Q.add("""
WITH u AS (SELECT event_type, user_id, median(value) AS m, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL)
SELECT event_type, round(median(m), 6) AS median, count(*) AS users FROM u WHERE n >= 2 GROUP BY event_type
""")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over users of their medians; users with one value are left out."""
    u = table(spark, sf_dir, "events").where("value > 0").groupBy("event_type", "user_id").agg(F.median("value").alias("m"), F.count("*").alias("n"))
    return u.where("n >= 2").groupBy("event_type").agg(F.round(F.median("m"), 6).alias("median"), F.count("*").alias("users"))


@Q.add("""
SELECT o_orderpriority, round(sum(o_totalprice * w) / sum(w), 4) AS weighted FROM (SELECT *, 1 + o_orderkey % 5 AS w FROM orders) GROUP BY o_orderpriority
""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weighted by a count."""
    w = 1 + F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice") * w) / F.sum(w), 4).alias("weighted"))


@Q.add("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a returned line."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(back, "o_orderkey", "left_anti")


@Q.add("""
SELECT o_custkey AS k, 'right' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def two_sided_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in good standing without orders, and customers of orders that are not in good standing."""
    left = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.two_sided_difference(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@Q.add("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def finished_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: customers with a finished order."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(done, "c_custkey", "left_semi")


@Q.add("""SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def group_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with several orders: are all of them finished?"""
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"))
        .where("n > 1")
    )


@Q.add("""
WITH p AS (SELECT doc_id, CAST(n_chars > 1500 AS INT) AS pred FROM documents), x AS (SELECT quality, toxic, pred FROM labels JOIN p USING (doc_id))
SELECT quality, pred, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic_rows, round(avg(CAST(quality = pred AS INT)), 6) AS agreement FROM x GROUP BY quality, pred
""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a prediction."""
    p = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("pred"))
    x = table(spark, sf_dir, "labels").join(p, "doc_id")
    return x.groupBy("quality", "pred").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic_rows"), F.round(F.avg((F.col("quality") == F.col("pred")).cast("int")), 6).alias("agreement")
    )


@Q.add("""
WITH b AS (SELECT doc_id, n_chars % 3 AS v FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id, n_chars % 5 AS v FROM documents WHERE doc_id % 3 = 0)
SELECT l.doc_id, l.quality AS v1, b.v AS v2, c.v AS v3, l.quality IS NOT DISTINCT FROM b.v AS same12, b.v IS NOT DISTINCT FROM c.v AS same23 FROM labels l LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def three_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs side by side; a value that is missing on both sides is equal."""
    docs = table(spark, sf_dir, "documents")
    b = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") % 3).alias("v2"))
    c = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") % 5).alias("v3"))
    x = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v1")).join(b, "doc_id", "left").join(c, "doc_id", "left")
    return x.withColumn("same12", F.col("v1").eqNullSafe(F.col("v2"))).withColumn("same23", F.col("v2").eqNullSafe(F.col("v3")))


@Q.add("""
WITH k AS (SELECT lower(left(p_name, 3)) AS k, p_partkey, p_name FROM part), f AS (SELECT k, p_name, min(p_partkey) AS f FROM k GROUP BY ALL),
r AS (SELECT k, p_name, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM f)
SELECT p_partkey, CASE WHEN a.p_name <> k.p_name THEN a.p_name ELSE b.p_name END AS other FROM k JOIN r a ON a.k = k.k AND a.r = 1 LEFT JOIN r b ON b.k = k.k AND b.r = 2
WHERE a.p_name <> k.p_name OR b.p_name IS NOT NULL
""")
def same_key_other_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the first one with the same sound key and another name: no pairs are made.

    Of a key the first part and the first part of another name are all that is needed.
    """
    k = table(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("k"), "p_partkey", "p_name")
    first = k.groupBy("k", "p_name").agg(F.min("p_partkey").alias("f"))
    w = Window.partitionBy("k").orderBy("f")
    two = first.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("k").agg(
        F.max(F.when(F.col("r") == 1, F.col("p_name"))).alias("n1"), F.max(F.when(F.col("r") == 2, F.col("p_name"))).alias("n2")
    )
    other = F.when(F.col("n1") != F.col("p_name"), F.col("n1")).otherwise(F.col("n2"))
    return k.join(two, "k").select("p_partkey", other.alias("other")).where("other is not null")


@Q.add("""
WITH a AS (SELECT p_brand AS k, arg_min(p_name, p_partkey) AS first_form, arg_max(p_name, p_partkey) AS last_form, count(DISTINCT p_name) > 1 AS replaced FROM part GROUP BY p_brand) SELECT * FROM a
""")
def first_and_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map built so that the first entry of a key wins, and one so that the last does."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_name").alias("form"), "p_partkey")
    a = joins.first_wins(p, "k", "p_partkey").select("k", F.col("form").alias("first_form"))
    b = joins.override(p, "k", "form", "p_partkey").select("k", F.col("form").alias("last_form"), "replaced")
    return a.join(b, "k")


@Q.add("""
WITH a AS (SELECT p_type AS k, min(p_size) AS x FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type), b AS (SELECT p_type AS k, max(p_size) AS y FROM part WHERE p_partkey % 3 = 0 GROUP BY p_type)
SELECT coalesce(a.k, b.k) AS k, coalesce(x, y) AS form, a.k IS NOT NULL AND b.k IS NOT NULL AND x <> y AS conflict FROM a FULL JOIN b ON a.k = b.k
""")
def list_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists merged: the first one wins, collisions are marked."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("k")).agg(F.min("p_size").alias("x"))
    b = p.where("p_partkey % 3 = 0").groupBy(F.col("p_type").alias("k")).agg(F.max("p_size").alias("y"))
    j = a.join(b, "k", "full")
    return j.select("k", F.coalesce("x", "y").alias("form"), F.coalesce(F.col("x") != F.col("y"), F.lit(False)).alias("conflict"))


@Q.add("""
WITH t AS (SELECT * FROM (VALUES (10.0), (50.0), (100.0)) AS v(threshold)) SELECT threshold::DOUBLE AS threshold, event_type, count(*) FILTER (WHERE value < threshold) AS silent, count(*) AS n FROM events, t GROUP BY threshold, event_type
""")
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values lie below each of three thresholds: one pass, then one row a threshold."""
    marks = [10.0, 50.0, 100.0]
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("value") < t).alias(f"t{i}") for i, t in enumerate(marks))
    )
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("silent")) for i, t in enumerate(marks)))
    return per.select("event_type", "n", F.inline(rows))


@Q.add("""SELECT event_type, round(corr(value, user_id::DOUBLE), 6) AS r, count(*) AS n FROM events GROUP BY event_type""")
def duration_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.corr("value", F.col("user_id").cast("double")), 6).alias("r"), F.count("*").alias("n"))


@Q.add("""
WITH r AS (SELECT * FROM (VALUES (1.0), (1.1), (1.25), (1.5)) AS v(ratio)) SELECT ratio::DOUBLE AS ratio, count(*) FILTER (WHERE n_chars * ratio > 5000) AS over_cap FROM documents, r GROUP BY ratio
""")
def cap_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents would exceed a cap if they grew by each of four ratios."""
    ratios = [1.0, 1.1, 1.25, 1.5]
    one = table(spark, sf_dir, "documents").agg(*(F.count_if(F.col("n_chars") * F.lit(x) > 5000).alias(f"r{i}") for i, x in enumerate(ratios)))
    rows = F.array(*(F.struct(F.lit(x).alias("ratio"), F.col(f"r{i}").alias("over_cap")) for i, x in enumerate(ratios)))
    return one.select(F.inline(rows))


@Q.add("""
WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(n, 5) AS norm FROM n
""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.l2_norm(F.col("embedding")), 5).alias("norm"))


@Q.add("""
WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT label, arg_min(e, vec_id) AS c FROM a GROUP BY label)
SELECT vec_id, a.label, round(list_cosine_similarity(e, c), 4) AS cosine FROM a JOIN f ON a.label = f.label
""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the first one of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(joins.small(first), "label").select("vec_id", "label", F.round(signal.cosine(F.col("embedding"), F.col("c")), 4).alias("cosine"))


_SEG = "[1, 2, 3, 2]"


@Q.add("""
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS i, unnest([e[1:1], e[2:3], e[4:6], e[7:8]]) AS p FROM s),
y AS (SELECT vec_id, i, list_filter(p, lambda v: v <> 0) AS p FROM x)
SELECT vec_id, CAST(i AS INT) AS segment, round(coalesce(list_avg(p), 0), 5) AS mean FROM y
""")
def segment_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of consecutive segments of each vector, zeros left out."""
    d = F.array(*(F.lit(x) for x in (1, 2, 3, 2)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.segment_average(F.col("embedding"), d)).alias("segment", "mean"))
    return rows.withColumn("mean", F.round("mean", 5))


@Q.add("""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
y AS (SELECT vec_id, flatten(list_transform(range(1, len(e) + 1), lambda i: list_transform(range((i - 1) % 3 + 1), lambda _: e[i]))) AS v FROM x)
SELECT vec_id, len(v) AS n, round(list_sum(v), 5) AS total FROM y
""")
def length_regulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values repeated by their durations (one, two and three by turns)."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    v = signal.length_regulate(values, F.transform("embedding", lambda _, i: (i % 3 + 1).cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@Q.add("""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT vec_id, unnest(range(1, len(e) // 4 + 1)) AS k, e FROM x),
l AS (SELECT vec_id, k, sqrt(list_sum(list_transform(e[(k - 1) * 4 + 1:(k - 1) * 4 + 8], lambda v: v * v)) / 8) AS level FROM f WHERE (k - 1) * 4 + 8 <= len(e))
SELECT vec_id, CAST(k - 1 AS INT) AS frame, round(level, 5) AS level FROM l
""")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all frames of each vector (8 values, every 4)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.frame_levels(F.col("embedding"), 8, 4)).alias("frame", "level"))
    return rows.withColumn("level", F.round("level", 5))


@Q.add("""SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name""")
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation; nations without any count 0."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))
