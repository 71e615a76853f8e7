"""Text reports over documents: inventories, frequencies, look-ups, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import latin
from corpusloom.operators import joins, stats
from corpusloom.plans.registry import Registry, table, texts

Q = Registry()

#: Signs that are inventoried, as a class that both engines read alike.
SIGNS = r"[!-/:-@\[-`{-~،؟؛]"
#: ASCII words.
WORD = "[a-z]+"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir)


def _action(c):
    return F.when(c.isin(".", ",", "?", "!"), "token").when(c.isin("،", "؟"), "convert").otherwise("drop")


_ACTION_SQL = "CASE WHEN c IN ('.', ',', '?', '!') THEN 'token' WHEN c IN ('،', '؟') THEN 'convert' ELSE 'drop' END"


def _sign_counts(docs: DataFrame) -> DataFrame:
    """One row a document and sign: the array is reduced before it is exploded."""
    found = F.regexp_extract_all("text", F.lit(SIGNS), F.lit(0))
    each = F.transform(
        F.array_distinct("signs"),
        lambda c: F.struct(c.alias("c"), F.size(F.filter("signs", lambda x: x == c)).cast("long").alias("n")),
    )
    return docs.select("doc_id", "lang", found.alias("signs")).select("doc_id", "lang", F.explode(each).alias("s")).select("doc_id", "lang", "s.c", "s.n")


@Q.add(f"""
WITH x AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{SIGNS}')) AS c FROM documents)
SELECT lang, c, {_ACTION_SQL} AS action, count(*) AS occurrences, count(DISTINCT doc_id) AS units FROM x GROUP BY lang, c
""")
def punct_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sign by language: what happens to it, how often it stands and in how many documents."""
    return (
        _sign_counts(_docs(spark, sf_dir))
        .groupBy("lang", "c")
        .agg(F.sum("n").alias("occurrences"), F.count("*").alias("units"))
        .withColumn("action", _action(F.col("c")))
    )


@Q.add(f"""
WITH x AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{SIGNS}')) AS c FROM documents),
y AS (SELECT lang, {_ACTION_SQL} AS action FROM x)
SELECT lang, count(*) FILTER (WHERE action = 'token') AS token, count(*) FILTER (WHERE action = 'convert') AS convert,
  count(*) FILTER (WHERE action = 'drop') AS drop FROM y GROUP BY lang
""")
def char_action_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs by what happens to them, a column an action."""
    signs = _sign_counts(_docs(spark, sf_dir)).withColumn("action", _action(F.col("c")))
    total = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("n"))), F.lit(0)).alias(a)
    return signs.groupBy("lang").agg(total("token"), total("convert"), total("drop"))


def _bridge_sql(w: str) -> str:
    expr = w
    for pair in latin._pair_order():
        expr = f"replace({expr}, '{pair}', '{latin.PAIRS[pair]}')"
    expr = f"replace(translate({expr}, '{latin.SINGLE_FROM}', '{latin.SINGLE_TO}'), 'x', '{latin.X}')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in latin.WORDS.items())
    return f"(CASE {w} {cases} ELSE {expr} END)"


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, pos, w: lower-case ASCII words."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return docs.select("doc_id", "lang", "source", F.posexplode(found).alias("pos", "w"))


_WORDS_SQL = f"""w0 AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, lang, source, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM w0)"""


@Q.add(f"""
WITH {_WORDS_SQL},
s AS (SELECT {_bridge_sql('w')} AS skel, doc_id * 1000000 + pos AS ord FROM w)
SELECT skel, count(*) AS n FROM s GROUP BY skel ORDER BY n DESC, min(ord) LIMIT 50
""")
def skeleton_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent skeletons of the words in Arabic letters; of equal counts the first one seen."""
    # Distinct words first: each is spelled once.
    counts = (
        _words(_docs(spark, sf_dir))
        .groupBy("w")
        .agg(F.count("*").alias("n"), F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("first"))
        .withColumn("skel", latin.transliterate_word(F.col("w")))
    )
    return counts.groupBy("skel").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(50).drop("first")


@Q.add(f"""
WITH {_WORDS_SQL} SELECT DISTINCT w, {_bridge_sql('w')} AS arabic FROM w
""")
def translit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word in Arabic letters."""
    return _words(_docs(spark, sf_dir)).select("w").distinct().withColumn("arabic", latin.transliterate_word(F.col("w")))


_FORMS = r"[^ \n\t|]+"


def _forms(docs: DataFrame) -> DataFrame:
    """Words as written; the key is without punctuation at the ends and in lower case."""
    found = F.regexp_extract_all("text", F.lit(_FORMS), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "form"))
    return rows.withColumn("key", F.lower(F.btrim("form", F.lit(".,!?%&*$#")))).where("key <> ''").withColumn(
        "ord", F.col("doc_id") * 1000000 + F.col("pos")
    )


_FORMS_SQL = rf"""f0 AS (SELECT doc_id, regexp_extract_all(text, '[^ \n\t|]+') AS ws FROM documents),
f1 AS (SELECT doc_id, unnest(ws) AS form, generate_subscripts(ws, 1) - 1 AS pos FROM f0),
f AS (SELECT doc_id, form, lower(trim(form, '.,!?%&*$#')) AS key, doc_id * 1000000 + pos AS ord FROM f1 WHERE trim(form, '.,!?%&*$#') <> '')"""


@Q.add(f"""
WITH {_FORMS_SQL},
g AS (SELECT key, form, count(*) AS n, min(ord) AS first FROM f GROUP BY key, form),
t AS (SELECT key, sum(n)::BIGINT AS total, count(*) AS forms, arg_max(form, ROW(n, -first)) AS majority, max(n) AS majority_n FROM g GROUP BY key),
top AS (SELECT * FROM t ORDER BY total DESC, key LIMIT 50),
s AS (SELECT top.key, f.doc_id, row_number() OVER (PARTITION BY top.key ORDER BY ord) AS r FROM top JOIN f ON f.key = top.key AND f.form = top.majority)
SELECT top.*, round(majority_n / total, 6) AS consistency,
  (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) FROM s WHERE s.key = top.key AND r <= 5) AS samples FROM top
""")
def form_consistency_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent keys: forms, share of the top form, first five documents of it."""
    forms = _forms(_docs(spark, sf_dir))
    top = forms.groupBy("key").agg(F.count("*").alias("t")).orderBy(F.desc("t"), "key").limit(50).select("key")
    out = stats.form_consistency(forms.join(F.broadcast(top), "key"), "key", "form", "ord", "doc_id")
    return out.withColumn("consistency", F.round("consistency", 6)).withColumn(
        "samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")
    )


@Q.add(f"""
WITH {_FORMS_SQL},
g AS (SELECT key, form, count(*) AS n, min(ord) AS first FROM f GROUP BY key, form),
t AS (SELECT key, sum(n) AS total, arg_max(form, ROW(n, -first)) AS majority FROM g GROUP BY key),
top AS (SELECT * FROM t ORDER BY total DESC, key LIMIT 50)
SELECT g.key, g.form AS outlier, majority, n FROM top JOIN g ON g.key = top.key AND g.form <> top.majority
""")
def majority_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that differ from their key's majority, for the 50 most frequent keys."""
    g = _forms(_docs(spark, sf_dir)).groupBy("key", "form").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    t = g.groupBy("key").agg(F.sum("n").alias("total"), F.max_by("form", F.struct("n", -F.col("first"))).alias("majority"))
    top = t.orderBy(F.desc("total"), "key").limit(50).select("key", "majority")
    return g.join(F.broadcast(top), "key").where("form <> majority").select("key", F.col("form").alias("outlier"), "majority", "n")


@Q.add(f"""
WITH {_WORDS_SQL},
closed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark),
n AS (SELECT w, count(*) AS n FROM w GROUP BY w)
SELECT closed.w, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 10 THEN 'frequent' WHEN coalesce(n, 0) >= 3 THEN 'mid' ELSE 'rare' END AS band
FROM closed LEFT JOIN n ON closed.w = n.w
""")
def closed_list_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of a closed list (the benchmark's words) occurs; unseen ones count 0."""
    closed = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")).distinct()
    n = _words(_docs(spark, sf_dir)).join(joins.small(closed), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    return closed.join(n, "w", "left").fillna(0, ["n"]).withColumn("band", stats.band(F.col("n")))


@Q.add(f"""
WITH {_WORDS_SQL},
d AS (SELECT source, w, count(*) AS n FROM w GROUP BY source, w),
b AS (SELECT w, sum(n) AS t FROM d GROUP BY w),
r AS (SELECT d.source, d.w, n, CAST(t - n AS BIGINT) AS base, row_number() OVER (PARTITION BY source ORDER BY n DESC, d.w) AS k
  FROM d JOIN b ON d.w = b.w WHERE n >= 5 AND n >= 10 * (t - n))
SELECT source, w, n, base FROM r WHERE k <= 60
""")
def domain_salient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a source that occur there at least five times and ten times as often as elsewhere; 60 a source."""
    from pyspark.sql import Window

    d = _words(_docs(spark, sf_dir)).groupBy("source", "w").agg(F.count("*").alias("n"))
    total = d.groupBy("w").agg(F.sum("n").alias("t"))
    hits = d.where("n >= 5").join(total, "w").withColumn("base", F.col("t") - F.col("n")).where("n >= 10 * base")
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))
    return hits.withColumn("k", k).where("k <= 60").select("source", "w", "n", "base")


@Q.add(f"""
WITH {_WORDS_SQL},
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM benchmark),
p AS (SELECT item_id, ws[1] AS a, ws[2] AS b, ws[3] AS c FROM b WHERE len(ws) >= 3),
t AS (SELECT doc_id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT item_id, count(t.doc_id) AS n, count(DISTINCT t.doc_id) AS units FROM p LEFT JOIN t ON w = a AND w2 = b AND w3 = c GROUP BY item_id
""")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the first three words of each benchmark item, and the documents that have them."""
    split = lambda: F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", split().alias("ws")).where("size(ws) >= 3")
    phrases = items.select("item_id", F.array_join(F.slice("ws", 1, 3), " ").alias("phrase"))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.concat_ws(" ", F.element_at("ws", i), F.element_at("ws", i + 1), F.element_at("ws", i + 2))
    )
    found = (
        _docs(spark, sf_dir)
        .select("doc_id", split().alias("ws"))
        .where("size(ws) >= 3")
        .select("doc_id", F.explode(grams).alias("phrase"))
        .join(joins.small(phrases), "phrase")
        .groupBy("item_id", "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy("item_id")
        .agg(F.sum("n").alias("n"), F.count("*").alias("units"))
    )
    return phrases.select("item_id").join(found, "item_id", "left").fillna(0, ["n", "units"])


def _lexicon(spark: SparkSession) -> DataFrame:
    """Stems of the test corpus with a class; invented."""
    rows = [("the", "function"), ("he", "pronoun"), ("re", "prefix"), ("or", "function"), ("ation", "suffix"), ("in", "function"), ("on", "function")]
    return spark.createDataFrame(rows, "stem string, cls string")


_LEX_SQL = "lex AS (SELECT * FROM (VALUES ('the', 'function'), ('he', 'pronoun'), ('re', 'prefix'), ('or', 'function'), ('ation', 'suffix'), ('in', 'function'), ('on', 'function')) AS v(stem, cls))"


@Q.add(f"""
WITH {_WORDS_SQL}, {_LEX_SQL},
u AS (SELECT w, count(*) AS n FROM w GROUP BY w),
k AS (SELECT w, n, 0 AS p, w AS key FROM u UNION ALL SELECT w, n, 1, w[3:] FROM u WHERE w LIKE 'th%' AND length(w) >= 4
  UNION ALL SELECT w, n, 2, w[2:] FROM u WHERE length(w) >= 3),
h AS (SELECT w, n, key, cls, row_number() OVER (PARTITION BY w ORDER BY p) AS r FROM k JOIN lex ON key = stem)
SELECT w, n, key AS matched, cls FROM h WHERE r = 1
""")
def variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the lexicon entry of their first variant that has one: whole, without th, without a letter."""
    words = _words(_docs(spark, sf_dir)).groupBy("w").agg(F.count("*").alias("n"))
    w = F.col("w")
    keys = F.array_compact(
        F.array(w, F.when(w.startswith("th") & (F.length(w) >= 4), F.substring(w, 3, 1 << 30)), F.when(F.length(w) >= 3, F.substring(w, 2, 1 << 30)))
    )
    return joins.variant_lookup(words, keys, _lexicon(spark), "stem", ["w", "n"])


@Q.add(f"""
WITH {_WORDS_SQL}, {_LEX_SQL},
u AS (SELECT DISTINCT w FROM w),
b AS (SELECT w, 0 AS p, w AS k FROM u UNION ALL SELECT w, 1, left(w, length(w) - 2) FROM u WHERE w LIKE '%ed' AND length(w) >= 4
  UNION ALL SELECT w, 2, left(w, length(w) - 3) FROM u WHERE w LIKE '%ing' AND length(w) >= 5),
x1 AS (SELECT w, p, 0 AS d, k FROM b),
x2 AS (SELECT w, p, 1 AS d, k[2:] AS k FROM x1 WHERE k SIMILAR TO '[wfblk].*' AND length(k) > 2),
x3 AS (SELECT w, p, 2 AS d, k[2:] AS k FROM x2 WHERE k SIMILAR TO '[wfblk].*' AND length(k) > 2),
x4 AS (SELECT w, p, 3 AS d, k[2:] AS k FROM x3 WHERE k SIMILAR TO '[wfblk].*' AND length(k) > 2),
h AS (SELECT w, k, cls, row_number() OVER (PARTITION BY w ORDER BY d, p) AS r
  FROM (FROM x1 UNION ALL FROM x2 UNION ALL FROM x3 UNION ALL FROM x4) JOIN lex ON k = stem)
SELECT w, k AS matched, cls FROM h WHERE r = 1
""")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words matched in stages: as they are, without a suffix, then without up to three prefixes."""
    words = _words(_docs(spark, sf_dir)).select("w").distinct()
    return joins.variant_lookup(words, joins.suffix_stages(F.col("w"), ["ed", "ing"]), _lexicon(spark), "stem", ["w"])


@Q.add(f"""
WITH {_WORDS_SQL}, {_LEX_SQL}, u AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c AS (SELECT w, n, CASE WHEN w IN (SELECT stem FROM lex) THEN 'direct'
  WHEN w SIMILAR TO '[wfb].*' AND length(w) > 3 AND w[2:] IN (SELECT stem FROM lex) THEN 'prefix' ELSE 'none' END AS covered FROM u)
SELECT covered, count(*) AS words, CAST(sum(n) AS BIGINT) AS positions FROM c GROUP BY covered
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus a lexicon covers: directly, behind one prefix letter, or not."""
    words = _words(_docs(spark, sf_dir)).groupBy("w").agg(F.count("*").alias("n"))
    return joins.coverage(words, "w", _lexicon(spark), "stem").groupBy("covered").agg(F.count("*").alias("words"), F.sum("n").alias("positions"))


_COPY = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'tion', 'sion') WHEN doc_id % 3 = 1 THEN lower(text) ELSE text END"
_SPLIT_SQL = r"list_filter(regexp_split_to_array({}, '[ \n\t]+'), lambda x: x <> '')"


@Q.add(f"""
WITH d AS (SELECT doc_id, {_SPLIT_SQL.format('text')} AS a, {_SPLIT_SQL.format(_COPY)} AS b FROM documents),
z AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b FROM d WHERE len(a) = len(b)),
c AS (SELECT doc_id, CASE WHEN a = b THEN 'exact' WHEN lower(a) = lower(b) THEN 'case' WHEN length(a) = length(b) THEN 'letters' ELSE 'other' END AS cls FROM z)
SELECT doc_id % 3 AS kind, cls, count(*) AS n, count(DISTINCT doc_id) AS units FROM c GROUP BY ALL
""")
def word_class_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text against those of a changed copy, side by side, by how they differ."""
    docs = _docs(spark, sf_dir).withColumn("copy", F.expr(_COPY))
    z = joins.zip_words(docs, "text", "copy", ["doc_id"])
    cls = (
        F.when(F.col("a") == F.col("b"), "exact")
        .when(F.lower("a") == F.lower("b"), "case")
        .when(F.length("a") == F.length("b"), "letters")
        .otherwise("other")
    )
    per_doc = z.groupBy("doc_id", cls.alias("cls")).agg(F.count("*").alias("n"))
    return per_doc.groupBy((F.col("doc_id") % 3).alias("kind"), "cls").agg(F.sum("n").alias("n"), F.count("*").alias("units"))


@Q.add(f"""
WITH d AS (SELECT doc_id, {_SPLIT_SQL.format('text')} AS a, {_SPLIT_SQL.format(_COPY)} AS b FROM documents),
z AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) - 1 AS position FROM d WHERE len(a) = len(b)),
e AS (SELECT * FROM z WHERE lower(a) <> lower(b))
SELECT doc_id, CAST(position AS INT) AS position, a, b FROM e
""")
def word_zip_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each text that differ from its changed copy, with their places."""
    docs = _docs(spark, sf_dir).withColumn("copy", F.expr(_COPY))
    return joins.zip_words(docs, "text", "copy", ["doc_id"]).where("lower(a) <> lower(b)")


_CHECKS_SQL = """CASE WHEN length(text) < 60 THEN 'short_text' END AS r1, CASE WHEN regexp_matches(text, '[0-9]') THEN 'has_digit' END AS r2,
CASE WHEN regexp_matches(text, '%%%|&&&|###') THEN 'junk' END AS r3, CASE WHEN n_chars > 6000 THEN 'too_long' END AS r4"""


def _rules() -> list:
    return [
        ("short_text", F.length("text") < 60),
        ("has_digit", F.col("text").rlike("[0-9]")),
        ("junk", F.col("text").rlike("%%%|&&&|###")),
        ("too_long", F.col("n_chars") > 6000),
    ]


@Q.add(f"""
WITH c AS (SELECT lang, {_CHECKS_SQL} FROM documents)
SELECT lang, coalesce(r1, r2, r3, r4, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL
""")
def first_fail_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first rule that drops them."""
    reason = F.coalesce(stats.first_reason(_rules()), F.lit("kept")).alias("reason")
    return _docs(spark, sf_dir).groupBy("lang", reason).agg(F.count("*").alias("n"))


@Q.add(f"""
WITH c AS (SELECT doc_id, {_CHECKS_SQL} FROM documents) SELECT doc_id, concat_ws('; ', r1, r2, r3, r4) AS reasons FROM c WHERE concat_ws('; ', r1, r2, r3, r4) <> ''
""")
def all_fail_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a document breaks, joined."""
    return _docs(spark, sf_dir).select("doc_id", stats.all_reasons(_rules()).alias("reasons")).where("reasons is not null")


@Q.add(f"""
WITH c AS (SELECT {_CHECKS_SQL}, lang FROM documents), r AS (SELECT concat_ws('; ', r1, r2, r3, r4) || ' (' || lang || ')' AS reason FROM c),
s AS (SELECT left(trim(split_part(reason, '(', 1)), 60) AS reason FROM r)
SELECT reason, count(*) AS n FROM s WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 20
""")
def reason_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent reasons without what stands in parentheses."""
    from corpusloom.functions.keys import reason_key

    full = F.concat(F.coalesce(stats.all_reasons(_rules()), F.lit("")), F.lit(" ("), F.col("lang"), F.lit(")"))
    rows = _docs(spark, sf_dir).select(reason_key(full).alias("reason")).where("reason <> ''")
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)


@Q.add("""
WITH m AS (SELECT doc_id, length(text) - length(replace(text, e'\\n', '')) AS lines, length(regexp_replace(text, '[^aeiou]', '', 'g')) AS marks,
  greatest(1, len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS words FROM documents),
g AS (SELECT doc_id, lines >= 2 AS skeleton, marks >= 3 * words AS density, marks >= greatest(5, ceil(1.2 * words)) AS floor FROM m)
SELECT count(*) AS units, count(*) FILTER (WHERE skeleton) AS skeleton, count(*) FILTER (WHERE density) AS density,
  count(*) FILTER (WHERE floor) AS floor, count(*) FILTER (WHERE skeleton AND density AND floor) AS passed FROM g
""")
def gates_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts pass each of a set of gates, and all of them."""
    text = F.col("text")
    marks = F.regexp_count(text, F.lit("[aeiou]"))
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(text, " "), lambda x: x != "")))
    gates = {
        "skeleton": F.regexp_count(text, F.lit("\n")) >= 2,
        "density": marks >= 3 * words,
        "floor": marks >= F.greatest(F.lit(5), F.ceil(words * 12 / F.lit(10))),
    }
    every = gates["skeleton"] & gates["density"] & gates["floor"]
    return _docs(spark, sf_dir).agg(F.count("*").alias("units"), *(F.count_if(t).alias(k) for k, t in gates.items()), F.count_if(every).alias("passed"))


@Q.add("""
WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || '_' || (doc_id % 50) END AS prefix, doc_id % 20 = 0 AS val FROM documents)
SELECT prefix FROM p WHERE val INTERSECT SELECT prefix FROM p WHERE NOT val
""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source prefixes on both sides of a split; a missing prefix is a value like any other."""
    prefix = F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat_ws("_", "source", (F.col("doc_id") % 50).cast("string")))
    docs = _docs(spark, sf_dir).select(prefix.alias("prefix"), (F.col("doc_id") % 20 == 0).alias("val"))
    return docs.where("val").select("prefix").intersect(docs.where("not val").select("prefix"))


@Q.add("""
SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(text) AS null_texts,
  count(*) - count(DISTINCT text) AS repeated_texts, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]')) AS latin,
  count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS digits, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_length,
  min(n_chars) AS shortest, max(n_chars) AS longest, round(quantile_cont(n_chars, 0.05), 4) AS p5, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents
""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts and checks on the documents."""
    text = F.col("text")
    return _docs(spark, sf_dir).agg(
        F.count("*").alias("rows"),
        F.count_distinct("doc_id").alias("ids"),
        (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"),
        (F.count("*") - F.count("text")).alias("null_texts"),
        (F.count("*") - F.count_distinct(F.xxhash64("text"), F.length("text"))).alias("repeated_texts"),
        F.count_if(text.rlike("[A-Za-z]")).alias("latin"),
        F.count_if(text.rlike("[0-9]")).alias("digits"),
        F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        F.round(F.percentile("n_chars", F.lit(0.05)), 4).alias("p5"),
        F.round(F.percentile("n_chars", F.lit(0.95)), 4).alias("p95"),
    )


@Q.add("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM s)
SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS lines, max(length(line)) AS longest,
  sum(len(regexp_extract_all(line, '[.!?]( |$)')))::BIGINT AS sentence_ends FROM x GROUP BY doc_id
""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, longest line and sentence ends of each document."""
    lines = F.split("text", "\n", -1)
    ends = F.aggregate(F.transform(lines, lambda x: F.regexp_count(x, F.lit("[.!?]( |$)"))), F.lit(0), lambda a, b: a + b)
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("lines"),
        F.array_max(F.transform(lines, lambda x: F.length(x))).cast("long").alias("longest"),
        ends.cast("long").alias("sentence_ends"),
    )


@Q.add("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(nav|article|footer)>|<li>|<p>')) AS tag,
  generate_subscripts(regexp_extract_all(html, '<(nav|article|footer)>|<li>|<p>'), 1) AS k FROM pages),
s AS (SELECT *, last_value(CASE WHEN tag NOT IN ('<li>', '<p>') THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k) AS section FROM l)
SELECT section, tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM s WHERE tag IN ('<li>', '<p>') AND section IS NOT NULL GROUP BY section, tag
""")
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and paragraphs by the section of the page in which they stand: headers fill forward."""
    from corpusloom.operators.sequence import forward_fill

    tags = F.regexp_extract_all("html", F.lit("<(?:nav|article|footer)>|<li>|<p>"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("k", "tag"))
    header = rows.withColumn("head", F.when(~F.col("tag").isin("<li>", "<p>"), F.col("tag")))
    filled = header.withColumn("section", forward_fill("head", ["page_id"], "k")).where("head is null and section is not null")
    per_page = filled.groupBy("page_id", "section", "tag").agg(F.count("*").alias("n"))
    return per_page.groupBy("section", "tag").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
