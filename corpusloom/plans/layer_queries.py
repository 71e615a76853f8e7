"""Lists, gates around a layer, stems, phrase spans, forms by environment, work lists: over the tables, with SQL by another route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import keys, latin, numbers, punctuation
from corpusloom.operators import gates, joins, sequence, stats, work
from corpusloom.plans.registry import Registry, table, texts
from corpusloom.plans.text_queries import _WORDS_SQL, WORD, _bridge_sql, _words
from corpusloom.plans.voice_queries import _number_sql, _words_sql

Q = Registry()

_ARABIC_WORDS_SQL = f"{_WORDS_SQL}, a AS (SELECT w, n, {_bridge_sql('w')} AS ar FROM (SELECT w, count(*) AS n FROM w GROUP BY w))"


def _arabic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w, n, ar: every distinct word, how often it stands, and its Arabic letters."""
    counts = _words(texts(spark, sf_dir)).groupBy("w").agg(F.count("*").alias("n"))
    return counts.withColumn("ar", latin.transliterate_word(F.col("w")))


# Words with a letter that has no Arabic one, and forms of two words with one or two spaces between, are what is to be told apart.
_LISTED_SQL = "CASE n % 4 WHEN 0 THEN ar WHEN 1 THEN ar || ' ' || ar WHEN 2 THEN ar || '  ' || ar ELSE ar || '.' END"


@Q.add(f"""
WITH {_ARABIC_WORDS_SQL}, f AS (SELECT w, {_LISTED_SQL} AS form FROM a)
SELECT w, form, regexp_full_match(form, '[ء-ٰٕ ]+') AND NOT contains(form, '  ') AND regexp_matches(form, '[ء-ي]') AS valid FROM f
""")
def list_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which forms may enter a list."""
    forms = _arabic_words(spark, sf_dir).select("w", F.expr(_LISTED_SQL).alias("form"))
    return forms.select("w", "form", keys.valid_list_form(F.col("form")).alias("valid"))


_STEM_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS stem, w, n, regexp_matches(k, '{true}') AS genuine FROM k WHERE regexp_matches(k, '{near}')"
    for name, (near, true) in keys.STEMS.items()
)


@Q.add(f"""
WITH {_ARABIC_WORDS_SQL}, k AS (SELECT w, n, replace(translate(ar, 'أإآ', 'ااا'), 'ة', 'ه') AS k FROM a), h AS ({_STEM_SQL})
SELECT stem, genuine, count(*) AS words, CAST(sum(n) AS BIGINT) AS occurrences FROM h GROUP BY stem, genuine
""")
def stem_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that look like one of the listed stems, and those that are the stem itself."""
    folded = F.replace(F.translate("ar", "أإآ", "ااا"), F.lit("ة"), F.lit("ه"))
    hits = _arabic_words(spark, sf_dir).select("n", F.explode(keys.stem_candidates(folded)).alias("h"))
    return hits.groupBy("h.stem", "h.genuine").agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"))


# A text before its layer ends every fourth word with a tanween and every ة with a damma; the layer puts short vowels in their place.
_BEFORE_SQL = "CASE doc_id % 3 WHEN 0 THEN replace(r, 'ه', 'هٌ') WHEN 1 THEN replace(r, 'ة', 'ةُ') ELSE replace(r, 'ن', '') END"
_AFTER_SQL = "regexp_replace(replace({b}, 'ٌ', 'َ'), '([بتثجحخدسش])', '{one}َ'{all})"
_GATE_TEXT_SQL = "array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: " + _bridge_sql("w") + "), ' ')"


def _gates_sql(c: str) -> str:
    bare = "regexp_replace({}, '[ً-ْٓ-ٰٕ]', '', 'g')"
    return (
        f"count(*) FILTER (WHERE {bare.format(c)} = r) AS {c}_skeleton, count(*) FILTER (WHERE NOT regexp_matches({c}, '[ٌٍ]')) AS {c}_tanween, "
        f"count(*) FILTER (WHERE NOT regexp_matches({c}, 'ة[ً-ْ]+( |$)')) AS {c}_taa, "
        f"count(*) FILTER (WHERE round(len(regexp_extract_all({c}, '[ً-ْٰ]')) / greatest(len(regexp_extract_all({c}, '[^ ]*[ء-ي][^ ]*')), 1), 2) >= 1.2) AS {c}_dense"
    )


@Q.add(f"""
WITH d AS (SELECT doc_id, {_GATE_TEXT_SQL} AS r FROM documents), x AS (SELECT r, {_BEFORE_SQL} AS b FROM d),
y AS (SELECT r, b, {_AFTER_SQL.format(b='b', one=chr(92) + '1', all=", 'g'")} AS a FROM x),
s AS (SELECT count(*) AS units, {_gates_sql('b')}, {_gates_sql('a')} FROM y)
{" UNION ALL ".join(f"SELECT '{g}' AS gate, units, b_{g} AS before, a_{g} AS after FROM s" for g in ("skeleton", "tanween", "taa", "dense"))}
""")
def measured_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Arabic letters that pass each gate before and after a layer of marks."""
    found = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), latin.transliterate_word)
    rows = texts(spark, sf_dir).select("doc_id", F.array_join(found, " ").alias("r"))
    rows = rows.withColumn("b", F.expr(_BEFORE_SQL)).withColumn("a", F.expr(_AFTER_SQL.format(b="b", one="$1", all="")))
    return gates.before_and_after(rows, "r", "b", "a", [])


_PATTERN_SQL = f"SELECT CAST(item_id AS VARCHAR) AS phrase, regexp_extract_all(lower(text), '{WORD}')[1:3] AS pattern FROM benchmark"


@Q.add(f"""
WITH {_WORDS_SQL}, p AS (SELECT * FROM ({_PATTERN_SQL}) WHERE len(pattern) = 3),
t AS (SELECT doc_id, pos, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT DISTINCT doc_id, phrase, pos FROM t JOIN p ON t.a = pattern[1] AND t.b = pattern[2] AND t.c = pattern[3]),
g AS (SELECT doc_id, phrase, list(pos ORDER BY pos) AS ps FROM h GROUP BY ALL)
SELECT doc_id, phrase, CAST(unnest(list_reduce(list_transform(ps, lambda x: [x]), lambda x, y: CASE WHEN y[1] >= x[-1] + 3 THEN list_concat(x, y) ELSE x END)) AS INT) AS start FROM g
""")
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where the first three words of a benchmark item stand; spans of one item do not overlap."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("phrase"), F.slice(words, 1, 3).alias("pattern"))
    return joins.phrase_spans(texts(spark, sf_dir), ["doc_id"], words, patterns.where(F.size("pattern") == 3))


@Q.add("""
WITH f AS (SELECT l_suppkey AS k, l_returnflag || l_linestatus AS form, l_linestatus = 'O' AS deep, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
g AS (SELECT k, form, deep, count(*) AS n, min(ord) AS first FROM f GROUP BY ALL)
SELECT k, form, n, deep FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY deep DESC, n DESC, first) = 1
""")
def best_deep_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent deep form of each key, failing that the most frequent one."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        F.concat("l_returnflag", "l_linestatus").alias("form"),
        (F.col("l_linestatus") == "O").alias("deep"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return stats.best_form(rows, "k", "form", "deep", "ord")


@Q.add("SELECT event_type, max(value) AS value, min(user_id) AS user_id FROM events GROUP BY event_type")
def worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst value of two measures by type of event."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*stats.worst_case(["value"], ["user_id"]))


@Q.add("""
WITH f AS (SELECT p_brand AS k, p_type AS form, p_size // 10 AS env, p_partkey AS u FROM part),
a AS (SELECT k, form, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT k, env, count(*) AS n FROM f GROUP BY ALL)
SELECT f.k, count(*) AS total, (SELECT string_agg(form || '=' || n, ',' ORDER BY form) FROM a WHERE a.k = f.k) AS forms,
  (SELECT string_agg(env || '=' || n, ',' ORDER BY env) FROM b WHERE b.k = f.k) AS environments, array_to_string(list_sort(list(u))[1:2], ',') AS samples
FROM f GROUP BY f.k
""")
def form_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and environments of each key with their counts, and its first two units."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("k"), F.col("p_type").alias("form"), F.floor(F.col("p_size") / 10).cast("int").alias("env"), F.col("p_partkey").alias("u")
    )
    out = stats.environments(rows, "k", "form", "env", "u", "u")
    joined = lambda c, name: F.array_join(F.transform(c, lambda x: F.concat(x[name].cast("string"), F.lit("="), x["n"].cast("string"))), ",")
    return out.select(
        "k",
        "total",
        joined(F.col("forms"), "form").alias("forms"),
        joined(F.col("environments"), "env").alias("environments"),
        F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"),
    )


@Q.add("""
WITH c AS (SELECT p_name AS k, p_brand AS form, count(*) AS n FROM part GROUP BY ALL)
SELECT k, CAST(sum(n) AS BIGINT) AS total, count(*) AS forms, count(*) = 1 AS consistent FROM c GROUP BY k HAVING sum(n) >= 2
""")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur more than once: always with one brand, or with several."""
    return stats.repeated_words(table(spark, sf_dir, "part").select(F.col("p_name").alias("k"), F.col("p_brand").alias("form")), "k", "form")


@Q.add("""
SELECT l_returnflag AS cls, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 6) AS share_high,
  round(avg(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) FILTER (WHERE l_quantity > 25), 6) AS hit_rate_near
FROM lineitem GROUP BY l_returnflag
""")
def token_class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, share of high values, rate of hits and conditional rate of each class."""
    out = stats.class_rates(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "cls"), "cls", "l_discount", F.col("l_tax") > 0.04, F.col("l_quantity") > 25, 0.05)
    return out.select("cls", "n", *(F.round(c, 6).alias(c) for c in ("mean", "share_high", "hit_rate", "hit_rate_near")))


@Q.add("SELECT user_id, count(*) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 25")
def speaker_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 users with the most events."""
    rows = table(spark, sf_dir, "events").select("user_id", F.lit(1).cast("long").alias("one"))
    return stats.ranked_by(rows, "user_id", "one", 25)


@Q.add("""
SELECT c_custkey, coalesce((SELECT bool_and(o_orderstatus <> 'P') FROM orders WHERE o_custkey = c_custkey), false) AS all_hold FROM customer
""")
def groups_that_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all of whose orders are settled; those without any are not."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return stats.all_hold(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") != "P")


@Q.add("""
WITH c AS (SELECT o_orderpriority AS part, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus))),
r AS (SELECT part, coalesce(sum(n) FILTER (WHERE status = 'F'), 0) / nullif(coalesce(sum(n) FILTER (WHERE status IN ('F', 'O')), 0), 0) AS success FROM c GROUP BY part)
SELECT c.part, status, n, round(success, 9) AS success FROM c JOIN r ON c.part IS NOT DISTINCT FROM r.part
""")
def run_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each status by part and over all, with the share of successes."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderstatus").alias("status"))
    return stats.status_shape(rows, "part", "status", "F", "O").withColumn("success", F.round("success", 9))


@Q.add("""
SELECT doc_id, CASE WHEN n_chars > 6000 THEN 'too_long' WHEN regexp_matches(text, '[0-9]') THEN 'has_digit' WHEN length(text) < 60 THEN 'short_text' END AS reason,
  n_chars > 6000 OR regexp_matches(text, '[0-9]') OR length(text) < 60 AS done FROM documents
""")
def cascade_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costly tests first here: what each document is dropped for, and whether it is done with."""
    rules = [("too_long", F.col("n_chars") > 6000), ("has_digit", F.col("text").rlike("[0-9]")), ("short_text", F.length("text") < 60)]
    return stats.cascade(texts(spark, sf_dir), rules, "doc_id")


@Q.add("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def rows_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that equal none of a list in any column."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return joins.rows_not_in(n, n.where("n_regionkey = 1")).select("n_nationkey", "n_name")


@Q.add("""
WITH m AS (SELECT max(doc_id) AS m FROM documents)
SELECT p_partkey, CAST(m + row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS seq FROM part, m
""")
def numbered_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows numbered on from the largest number in use."""
    return sequence.number_on(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", table(spark, sf_dir, "documents"), "doc_id")


@Q.add("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents ORDER BY bytes DESC, doc_id")
def largest_documents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which work on them is to start."""
    docs = texts(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return sequence.largest_first(docs, "bytes", "doc_id")


@Q.add("SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS INT) AS place FROM documents")
def lengths_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source by descending length."""
    return sequence.by_length(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@Q.add("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY doc_id LIMIT 300")
def head_without_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 documents that are not set aside."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sequence.head_without(docs, "doc_id", table(spark, sf_dir, "labels").where("quality = 0"), 300)


#: Documents that every evaluation looks at.
FIXED = [3, 17, 5, 101, 64, 42]


@Q.add(f"SELECT doc_id, n_chars, place FROM documents JOIN (VALUES {', '.join(f'({k}, {i})' for i, k in enumerate(FIXED))}) AS v(k, place) ON doc_id = k")
def evaluation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of documents, in the order of the list."""
    return sequence.fixed_subset(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", FIXED)


@Q.add("SELECT DISTINCT lower(p_name) AS name FROM part ORDER BY name")
def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in order."""
    return table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct().orderBy("name")


@Q.add("SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 95 THEN 'train' ELSE 'val' END AS split FROM documents")
def keyed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by a hash of the key, which can be made again anywhere."""
    return table(spark, sf_dir, "documents").select("doc_id", sequence.keyed_split(F.col("doc_id"), 95).alias("split"))


@Q.add("""
SELECT doc_id, CASE WHEN n_chars % 7 > 0 THEN CAST(n_chars // (n_chars % 7) AS VARCHAR) END AS result, CASE WHEN n_chars % 7 > 0 THEN 'ok' ELSE 'ZeroDivisionError: integer division or modulo by zero' END AS status FROM documents
""")
def guarded_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that fails on some rows: each gets its result or what was raised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return work.guarded(docs, "doc_id", lambda r: str(int(r["n_chars"]) // (int(r["n_chars"]) % 7)))


@Q.add()
def simulated_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document while it arrives in pieces of 7, 40 and 3 characters, and where the arrival stands."""
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(work.arrivals_udf([7, 40, 3], 12, 60)("text")).alias("k", "a")).select("doc_id", "k", "a.arrived", "a.consumed", "a.chunk")


_MARK_SQL = r"[\x{064B}-\x{0655}\x{0670}]"
_MARKED_SQL = "regexp_replace(ar, '([بتجدنملرس])', '{one}َ'{all})"
_EDGE_SQL = "trim({}, '" + keys.EDGE_PUNCT + "')"


def _keys_sql() -> str:
    fold = lambda x: f"translate({x}, 'أإآ', 'ااا')"
    left = ["CASE WHEN stem <> '' THEN stem END"]
    left += [f"CASE WHEN starts_with(stem, '{p}') AND length(stem) >= {len(p) + 3} THEN stem[{len(p) + 1}:] END" for p in ("وال", "فال", "بال", "كال", "لل")]
    left += ["CASE WHEN starts_with(stem, 'ال') AND length(stem) > 4 THEN stem[3:] END"]
    left += [f"CASE WHEN starts_with(stem, '{c}') AND length(stem) >= 4 THEN stem[2:] END" for c in "وفبلك"]
    return "list_sort(list_distinct(list_filter([" + ", ".join(x for v in left for x in (v, fold(v))) + "], lambda x: x IS NOT NULL)))"


@Q.add(f"""
WITH {_ARABIC_WORDS_SQL}, m AS (SELECT w, '«' || {_MARKED_SQL.format(one=chr(92) + '1', all=", 'g'")} || '.' AS word FROM a),
s AS (SELECT w, word, {_EDGE_SQL.format(f"regexp_replace(word, '{_MARK_SQL}', '', 'g')")} AS skel FROM m),
t AS (SELECT *, CASE WHEN left(skel, 1) IN ('و', 'ف') AND length(skel) > 3 THEN skel[2:] ELSE skel END AS stem FROM s)
SELECT w, skel, stem, regexp_replace(regexp_replace(translate(skel, 'أإآ', 'ااا'), 'ة$', 'ه'), 'ى$', 'ي') AS normal, array_to_string({_keys_sql()}, ',') AS keys FROM t
""")
def word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeleton, stem, normal form and look-up keys of every distinct word, marked and in quotation marks."""
    word = F.concat(F.lit("«"), F.expr(_MARKED_SQL.format(one="$1", all="")), F.lit("."))
    rows = _arabic_words(spark, sf_dir).select("w", keys.skeleton(word).alias("skel"))
    return rows.select(
        "w",
        "skel",
        keys.strip_conjunction(F.col("skel")).alias("stem"),
        keys.norm(F.col("skel")).alias("normal"),
        F.array_join(F.array_sort(keys.variants(F.col("skel"))), ",").alias("keys"),
    )


_CHANGED_SQL = "CASE n % 4 WHEN 0 THEN m WHEN 1 THEN concat(m, 'ْ') WHEN 2 THEN replace(m, 'َ', 'ِ') ELSE concat(m, 'ن') END"


@Q.add(f"""
WITH {_ARABIC_WORDS_SQL}, m AS (SELECT w, n, {_MARKED_SQL.format(one=chr(92) + '1', all=", 'g'")} AS m FROM a), c AS (SELECT w, m, {_CHANGED_SQL} AS b FROM m),
x AS (SELECT *, regexp_replace(m, '{_MARK_SQL}', '', 'g') AS bare, regexp_replace(b, '{_MARK_SQL}', '', 'g') AS other FROM c)
SELECT w, CASE WHEN m = b THEN 'exact' WHEN bare <> other THEN 'skeleton'
  WHEN regexp_replace(m, '{_MARK_SQL}+$', '') = regexp_replace(b, '{_MARK_SQL}+$', '') THEN 'final_only' ELSE 'internal' END AS cls FROM x
""")
def word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each marked word differs from a changed copy."""
    rows = _arabic_words(spark, sf_dir).select("w", "n", F.expr(_MARKED_SQL.format(one="$1", all="")).alias("m")).withColumn("b", F.expr(_CHANGED_SQL))
    return rows.select("w", keys.compare_words(F.col("m"), F.col("b")).alias("cls"))


@Q.add(f"""
WITH d AS (SELECT doc_id, {_GATE_TEXT_SQL} AS r FROM documents), x AS (SELECT doc_id, r, {_BEFORE_SQL} AS b FROM d), y AS (SELECT doc_id, r, {_AFTER_SQL.format(b='b', one=chr(92) + '1', all=", 'g'")} AS a FROM x),
z AS (SELECT *, len(list_filter(string_split(a, ' '), lambda w: regexp_matches(w, '[ء-ي]'))) AS words, len(regexp_extract_all(a, '{_MARK_SQL}')) AS marks FROM y)
SELECT doc_id, CASE WHEN regexp_replace(a, '{_MARK_SQL}', '', 'g') <> r THEN 'skeleton' WHEN regexp_matches(a, '[ًٌٍ]') THEN 'tanween' WHEN regexp_matches(a, 'ة[ً-ّ]') THEN 'taa'
  WHEN marks < greatest(5, ceil(words * 12 / 10)) THEN 'density' END AS failed FROM z
""")
def failed_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that each document fails after a layer of marks."""
    found = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), latin.transliterate_word)
    rows = texts(spark, sf_dir).select("doc_id", F.array_join(found, " ").alias("r"))
    rows = rows.withColumn("b", F.expr(_BEFORE_SQL)).withColumn("a", F.expr(_AFTER_SQL.format(b="b", one="$1", all="")))
    return rows.select("doc_id", gates.failed_gate(F.col("a"), F.col("r"), []).alias("failed"))


@Q.add(f"""
SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, concat_ws(' ', 'عندي', {_number_sql('CAST(l_quantity AS BIGINT)', 'egy')}, 'كتب') AS whole,
  {_words_sql('CAST(l_quantity AS BIGINT)', 'egy')} || ' {numbers.PERCENT} منها' AS percent FROM lineitem
""")
def spoken_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in running text, as whole numbers and as percentages, read out."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct()
    speak = numbers.speak_numbers_udf("egy")
    digits = F.col("n").cast("string")
    return n.select("n", speak(F.concat(F.lit("عندي "), digits, F.lit(" كتب"))).alias("whole"), speak(F.concat(digits, F.lit("% منها"))).alias("percent"))


def _squeezed_sql(text: str) -> str:
    for sign in ".,!?؛:":
        text = f"regexp_replace({text}, '[{sign}]+', '{sign}', 'g')"
    return text


_SIGNED_SQL = "replace(replace(text, ' the', ' ، the'), '.', ' ..؟؟ ')"


@Q.add(f"""
WITH d AS (SELECT doc_id, {_squeezed_sql(f"replace(replace({_SIGNED_SQL}, '،', ','), '؟', '?')")} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \n\t]+'), lambda x: x <> '') AS w FROM d)
SELECT doc_id, sha256(array_to_string(
  list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR regexp_full_match(w[i], '[.,!?؛:]+') THEN w[i] ELSE ' ' || w[i] END), '')) AS sha FROM w
""")
def settled_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs converted, repeats reduced to one, signs that stand alone put to the word before them."""
    text = punctuation.normalize_punctuation(F.expr(_SIGNED_SQL))
    out = punctuation.attach_punctuation(text)
    return texts(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("sha"))


#: What a run says of each kind of order, and the class that it is counted under.
_SAID = {"1-URGENT": ("API error 429: too many", "429-API"), "2-HIGH": ("اختلاف الهيكل في الكلمة", "SKELETON"), "3-MEDIUM": ("التاء المربوطة", "TAA"), "4-NOT SPECIFIED": ("تنوين", "TANWEEN"), "5-LOW": ("x", "OTHER")}


@Q.add(f"SELECT CASE o_orderpriority {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{c}{chr(39)}' for k, (_, c) in _SAID.items())} END AS cls, count(*) AS n FROM orders GROUP BY 1")
def reasons_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures counted by the class of what was said of them."""
    said = F.create_map(*(F.lit(x) for k, (s, _) in _SAID.items() for x in (k, s)))
    reason = F.concat(F.try_element_at(said, F.col("o_orderpriority")), F.lit(""))
    return table(spark, sf_dir, "orders").groupBy(stats.reason_class(reason).alias("cls")).agg(F.count("*").alias("n"))
