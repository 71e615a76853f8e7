"""Number words, normalisation, tokens, policy and repair: golden cases and numbers from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import keys, latin, numbers, phonetics, punctuation, repair
from corpusloom.operators import gates, retry, stats
from corpusloom.plans.registry import Registry, table, texts

Q = Registry()


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


def _list_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _words_sql(n: str, style: str) -> str:
    """Words of 0 to 999 as DuckDB SQL over lists."""
    small, big = _list_sql(numbers.hundred_words(style)), _list_sql(["", *numbers.HUNDREDS[style]])
    return f"concat_ws('{numbers.AND}', nullif({big}[({n}) // 100 + 1], ''), nullif({small}[({n}) % 100 + 1], ''))"


def _scaled_sql(n: str, k: int, style: str) -> str:
    one, two, few, many = numbers.SCALES[style][k]
    return (
        f"CASE WHEN {n} = 1 THEN '{one}' WHEN {n} = 2 THEN '{two}' WHEN {n} BETWEEN 3 AND 10 THEN {_words_sql(n, style)} || ' {few}' "
        f"WHEN {n} > 10 THEN {_words_sql(n, style)} || ' {many}' END"
    )


def _number_sql(n: str, style: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN '{numbers.ZERO}' ELSE concat_ws('{numbers.AND}', {_scaled_sql(f'({n} // 1000000)', 1, style)}, "
        f"{_scaled_sql(f'({n} // 1000 % 1000)', 0, style)}, nullif({_words_sql(f'({n} % 1000)', style)}, '')) END"
    )


@Q.add(f"SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, {_number_sql('CAST(l_quantity AS BIGINT)', 'egy')} AS egy, {_number_sql('CAST(l_quantity AS BIGINT)', 'msa')} AS msa FROM lineitem")
def number_words_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct quantity in words, in both styles."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct()
    return n.select("n", numbers.number_words(F.col("n"), "egy").alias("egy"), numbers.number_words(F.col("n"), "msa").alias("msa"))


@Q.add(f"SELECT o_orderkey AS n, {_number_sql('o_orderkey', 'egy')} AS egy, {_number_sql('o_orderkey', 'msa')} AS msa FROM orders")
def number_words_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order key in words."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return n.select("n", numbers.number_words(F.col("n"), "egy").alias("egy"), numbers.number_words(F.col("n"), "msa").alias("msa"))


def _digits_sql(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ''), lambda c: {_list_sql([numbers.ZERO, *numbers.UNITS['egy']])}[CAST(c AS INT) + 1]), ' ')"


@Q.add(f"""
WITH d AS (SELECT DISTINCT printf('%.2f', l_quantity + l_discount) AS s FROM lineitem), p AS (SELECT s, CAST(split_part(s, '.', 1) AS BIGINT) AS a, split_part(s, '.', 2) AS b FROM d)
SELECT s, CASE WHEN rtrim(b, '0') = '5' THEN trim({_words_sql('a', 'egy')} || ' {numbers.HALF}') ELSE {_words_sql('a', 'egy')} || ' {numbers.POINT} ' || {_digits_sql('b')} END AS words FROM p
""")
def decimal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with two decimals in words."""
    d = table(spark, sf_dir, "lineitem").select(F.format_string("%.2f", F.col("l_quantity") + F.col("l_discount")).alias("s")).distinct()
    return d.select("s", numbers.decimal_words(F.split_part("s", F.lit("."), F.lit(1)), F.split_part("s", F.lit("."), F.lit(2))).alias("words"))


#: Cases of the normalisation: text, style, result.
NORMAL = [
    ("عندي 5 كتب", "egy", "عندي خمسة كتب"),
    ("عام 2026", "egy", "عام ألفين وستة وعشرين"),
    ("عام 2026", "msa", "عام ألفان وستة وعشرون"),
    ("٢٥٠", "msa", "مئتان وخمسون"),
    ("12345", "egy", "اتناشر ألف وتلاتمية وخمسة وأربعين"),
    ("الساعة 10.", "egy", "الساعة عشرة."),
    ("استهلكت 80% من الباقة", "egy", "استهلكت تمانين في المية من الباقة"),
    ("3.5", "egy", "تلاتة ونص"),
    ("5.4", "egy", "خمسة فاصل أربعة"),
    ("1,000 جنيه", "egy", "ألف جنيه"),
    ("meeting بكرة", "egy", "ميتينج بكرة"),
    ("{ق}انون", "egy", "قانون{ق}"),
    ("كلمة {ق}", "egy", "كلمة{ق}"),
    ("هل أنت جاهز؟؟", "egy", "هل أنت جاهز?"),
    ("نعم ، يا عمر", "egy", "نعم, يا عمر"),
    ("3000000", "egy", "تلاتة ملايين"),
]


@Q.add(f"SELECT raw, style, want AS normal FROM (VALUES {_values(NORMAL)}) AS v(raw, style, want)")
def normalize_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the text normalisation."""
    df = spark.createDataFrame([(a, b) for a, b, _ in NORMAL], "raw string, style string")
    both = F.when(F.col("style") == "egy", punctuation.normalize_text(F.col("raw"), "egy")).otherwise(punctuation.normalize_text(F.col("raw"), "msa"))
    return df.select("raw", "style", both.alias("normal"))


#: Cases of the tokens: text, dialect, tokens.
TOKENS = [
    ("يا صاحبي", "egy", "y aa _+_ S aa H b ii _+_ _eos_"),
    ("جدا ده", "egy", "v d aa _+_ d h _+_ _eos_"),
    ("فَوْقَ الْقَافِ", "msa", "f a w q a _+_ l q aa f i _+_ _eos_"),
    ("شَدَّةٌ", "msa", "$ a d _dbl_ a t u n _+_ _eos_"),
    ("القلم{ء} القرش{ج} القاهرة{ق}", "egy", "aa l < i l m _+_ l v r $ _+_ l q aa h r _+_ _eos_"),
    ("نعم, ممكن!", "egy", "n E m , _+_ m m k n ! _+_ _eos_"),
]


@Q.add(f"SELECT text, dialect, tokens FROM (VALUES {_values(TOKENS)}) AS v(text, dialect, tokens)")
def token_ids_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the tokens, through ids and back."""
    df = spark.createDataFrame([(a, b) for a, b, _ in TOKENS], "text string, dialect string")
    parts = [phonetics.with_tokens(df.where(F.col("dialect") == d), "text", d) for d in ("egy", "msa")]
    again = phonetics.ids_tokens(phonetics.token_ids(F.col("tokens")))
    return parts[0].unionByName(parts[1]).select("text", "dialect", F.array_join(again, " ").alias("tokens"))


#: Cases of the policy: word, asked by a marker, dialect, spoken, class.
POLICY = [
    ("qAnwn", None, "egy", "qAnwn", "q"),
    ("wAlqAnwn", None, "egy", "wAlqAnwn", "q"),
    ("Alrqm", None, "egy", "Alrjm", "g"),
    ("qlb", None, "egy", "<lb", "hamza"),
    ("byqr>", None, "egy", "by<r>", "hamza"),
    ("qlb", "q", "egy", "qlb", "hamza"),
    ("qAnwn", "h", "egy", "<Anwn", "q"),
    ("qlb", None, "msa", "qlb", "hamza"),
    ("qlb", "g", "msa", "jlb", "hamza"),
    ("Hq~", None, "egy", "H<", "hamza"),
]


@Q.add(f"SELECT word, asked, dialect, spoken, cls FROM (VALUES {_values(POLICY)}) AS v(word, asked, dialect, spoken, cls)")
def policy_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the letter policy."""
    df = spark.createDataFrame([r[:3] for r in POLICY], "word string, asked string, dialect string")
    none = F.create_map().cast("map<string,string>")
    actions = F.when(F.col("asked").isNotNull(), F.create_map(F.col("word"), F.col("asked"))).otherwise(none)
    w = F.col("word")
    spoken = F.when(F.col("dialect") == "egy", phonetics.say_q(w, actions, "egy")).otherwise(phonetics.say_q(w, actions, "msa"))
    return df.select("word", "asked", "dialect", spoken.alias("spoken"), phonetics.q_class(phonetics.bare_skeleton(w)).alias("cls"))


LEXICON = repair.Lexicon(
    closed={"جدا", "طبعا"},
    tanween={"جدا": "جِدَاً"},
    common={"كتاب": "كِتَابْ"},
    phrases=[repair.Phrase(["الحمد", "لله"], ["اَلْحَمْدُ", "لِلَّهْ"], "tier_a")],
)
#: Cases of the repair: raw, vocalised, repaired.
REPAIRS = [
    ("هو كتاب", "هُوَ كَتَابٌ", "هُوْ كِتَابْ"),
    ("الشمس", "الشَمْسُ", "اِلش\u0651\u064eمْسْ"),
    ("القمر", "القَمَرُ", "اِلْقَمَرْ"),
    ("مدرسة", "مَدْرَسَةٌ", "مَدْرَسَة"),
    ("جدا", "جِدًّا", "جِدَاً"),
    ("الحمد لله", "الحَمدُ للهِ", "اَلْحَمْدُ لِلَّهْ"),
    ("واحد اتنين", "واحد", "واحد"),
]


@Q.add(f"SELECT raw, voiced, fixed FROM (VALUES {_values(REPAIRS)}) AS v(raw, voiced, fixed)")
def repair_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the repair layer."""
    df = spark.createDataFrame([r[:2] for r in REPAIRS], "raw string, voiced string")
    return df.select("raw", "voiced", repair.repair_udf(LEXICON)("raw", "voiced")["out"].alias("fixed"))


#: Cases of the gates: vocalised, raw, first gate that fails.
GATES = [
    ("كِتَابْ جِدَاً", "كتاب جدا", None),
    ("كِتَابْ", "كتب", "skeleton"),
    ("كِتَابٌ", "كتاب", "tanween"),
    ("كِتَابَاً", "كتابا", "tanween"),
    ("كِتَابْ وَجِدَاً", "كتاب وجدا", None),
    ("مَدْرَسَةُ", "مدرسة", "taa"),
    ("كتاب", "كتاب", "density"),
]


@Q.add(f"SELECT voiced, raw, failed FROM (VALUES {_values(GATES)}) AS v(voiced, raw, failed)")
def gates_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the four gates."""
    df = spark.createDataFrame([r[:2] for r in GATES], "voiced string, raw string")
    return df.select("voiced", "raw", gates.failed_gate(F.col("voiced"), F.col("raw"), ["جدا"]).alias("failed"))


#: Cases of the keys: word, skeleton, normal form, keys.
KEYS = [
    ("«كِتَابٌ»", "كتاب", "كتاب", "كتاب,تاب"),
    ("والمدرسةُ.", "والمدرسة", "والمدرسه", "المدرسة,مدرسة"),
    ("أحمد", "أحمد", "احمد", "أحمد,احمد"),
    ("فعلا", "فعلا", "فعلا", "علا"),
]


@Q.add(f"SELECT word, skeleton, normal, keys FROM (VALUES {_values(KEYS)}) AS v(word, skeleton, normal, keys)")
def keys_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of skeletons and look-up keys."""
    df = spark.createDataFrame([r[:1] for r in KEYS], "word string")
    skel = keys.skeleton(F.col("word"))
    return df.select("word", skel.alias("skeleton"), keys.norm(skel).alias("normal"), F.array_join(keys.variants(skel), ",").alias("keys"))


#: Cases of the reason classes.
REASONS = [("API error 429", "429-API"), ("اختلاف الهيكل", "SKELETON"), ("التاء المربوطة", "TAA"), ("تنوين", "TANWEEN"), ("تعذر التحليل", "PARSE"), ("شبه خالٍ", "DENSITY"), ("x", "OTHER")]


@Q.add(f"SELECT reason, cls FROM (VALUES {_values(REASONS)}) AS v(reason, cls)")
def reason_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of failure reasons."""
    df = spark.createDataFrame([r[:1] for r in REASONS], "reason string")
    return df.select("reason", stats.reason_class(F.col("reason")).alias("cls"))


#: Cases of the word comparison.
COMPARED = [("كَتَبَ", "كَتَبَ", "exact"), ("كَتَبَ", "كَتَبْ", "final_only"), ("كَتَبَ", "كِتَبَ", "internal"), ("كَتَبَ", "كَتَمَ", "skeleton")]


@Q.add(f"SELECT a, b, cls FROM (VALUES {_values(COMPARED)}) AS v(a, b, cls)")
def compare_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of word pairs."""
    df = spark.createDataFrame([r[:2] for r in COMPARED], "a string, b string")
    return df.select("a", "b", keys.compare_words(F.col("a"), F.col("b")).alias("cls"))


_PLAN = ["1. aa\n2. x", "THROW:500", "1. y", "1. bb"]
_UNITS = [("u1", "aa"), ("u2", "bb")]


def plan_client() -> retry.Client:
    return retry.scripted_client(list(_PLAN))


def same_text(out: str, raw: str) -> str | None:
    return None if out == raw else "differs"


@Q.add("SELECT * FROM (VALUES ('u1', 'aa', 'aa', 1, 'ok', NULL), ('u2', 'bb', 'bb', 4, 'ok', NULL)) AS v(id, raw, out, attempts, status, reason)")
def retry_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched and single retries against a scripted service: an error and a wrong reply, then the right one."""
    df = spark.createDataFrame(_UNITS, "id string, raw string").coalesce(1)
    return retry.run_retries(df, plan_client, same_text)


@Q.add()
def normalize_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document normalised: numbers spoken, Latin words in Arabic letters, punctuation settled."""
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", punctuation.normalize_text(F.col("text"), "egy").alias("normal"))


@Q.add()
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and ids of every distinct word of the corpus: each word is read once, however often it stands."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    words = texts(spark, sf_dir).select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    read = phonetics.with_tokens(words.withColumn("arabic", latin.transliterate_word(F.col("w"))), "arabic", "egy")
    ids = phonetics.token_ids(F.col("tokens"))
    return read.select("w", "n", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@Q.add()
def repair_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair layer over every sentence-sized unit of the corpus in Arabic letters, by language."""
    docs = texts(spark, sf_dir)
    lines = docs.select("lang", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    units = lines.select("lang", latin.transliterate(F.lower("line")).alias("raw"))
    done = units.select("lang", repair.repair_udf(LEXICON)("raw", "raw").alias("r"))
    return done.groupBy("lang").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("r.skeleton_ok")).alias("faithful"),
        F.sum(F.element_at("r.fixes", "final_sukun_added")).alias("final_sukun_added"),
        F.sum(F.element_at("r.fixes", "al_kasra")).alias("al_kasra"),
    )
