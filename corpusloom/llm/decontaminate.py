"""Benchmark decontamination by a prefix-filtered join.

A window of an item occurs in a document only if every two-word shingle of it does.
So the shingles of the benchmark are ordered by how often they occur in the corpus,
each window keeps the position of its rarest one (the one-token prefix that exact
containment needs), and only those are joined with the shingles of the documents. A
common word is thereby no prefix, unless a whole window is common. Length and
positional bounds drop alignments that cannot hold a whole window; the rest are
verified word by word over item-sized windows. Shingles are told by a 64-bit hash;
what it confuses, the verification tells apart. Windows of one word are their own
shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import bounded, materialize

WINDOW = 10
#: Shingles that one broadcast holds; a larger benchmark is joined in blocks.
BLOCK_ROWS = 500_000
#: Words of a document that share one context array.
BLOCK_WORDS = 32
#: Bytes that are not part of a word (A-Z are, in lower case).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z only; the quick path serves words of ASCII letters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, _UPPER, _LOWER)
    )


def raw_words(text: Column) -> Column:
    """The words of a text, not yet in lower case."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def _blocks(df: DataFrame, limit: int) -> list[DataFrame]:
    """df cut by a hash of its rows into parts of about `limit` rows, each to be broadcast."""
    n = -(-df.count() // limit) or 1
    if n == 1:
        return [F.broadcast(df)]
    keys = [c for c, kind in df.dtypes if not kind.startswith("array")]
    return [F.broadcast(df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)) for i in range(n)]


def _pair(a: Column, b: Column) -> Column:
    """The shingle of two words, in lower case already."""
    return F.xxhash64(a, b)


def _single(a: Column) -> Column:
    return F.xxhash64(a, F.lit(""))


def _tokens_of(rows: DataFrame, a: Column, b: Column, singles: bool, *keep: str) -> DataFrame:
    """rows of words (a) and the words behind them (b, null at the end) with their `token`; singles: those of one word too."""
    pair = F.when(b.isNotNull(), _pair(ascii_lower(a), ascii_lower(b)))
    if not singles:
        return rows.select(*keep, pair.alias("token")).where("token is not null")
    return rows.select(*keep, F.explode(F.array(pair, _single(ascii_lower(a)))).alias("token")).where("token is not null")


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.transform(raw_words(text), ascii_lower)
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("item_words"))
        .distinct()
        .where(F.size("item_words") > 0)
        .withColumn("need", F.least(F.size("item_words"), F.lit(window)))
    )


def _item_tokens() -> Column:
    """Tokens of an item by position: pairs, or words where a window has only one."""
    words = F.col("item_words")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: _pair(F.element_at(words, i), F.element_at(words, i + 1))
    )
    return F.when(F.col("need") >= 2, pairs).otherwise(F.transform(words, _single))


def _prefixes(items: DataFrame, rarity: DataFrame, window: int) -> DataFrame:
    """(token, item, need, at, item_left, item_right): each window's rarest token, once a position."""
    placed = items.select(
        "item", "item_words", "need", F.posexplode(_item_tokens()).alias("at", "token")
    ).join(bounded(rarity), "token", "left")
    ordered = placed.groupBy("item", "item_words", "need").agg(
        F.array_sort(
            F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "token"))
        ).alias("tokens")
    )
    ranked = F.transform("tokens", lambda t: F.struct(t["n"], t["token"], t["at"]))
    starts = F.sequence(F.lit(0), F.size("item_words") - F.col("need"))
    rarest = F.array_distinct(
        F.transform(starts, lambda s: F.array_min(F.slice(ranked, s + 1, F.greatest(F.col("need") - 1, F.lit(1)))))
    )
    around = F.col("item_words")
    before = max(window - 2, 0)
    return ordered.select("item", "item_words", "need", F.explode(rarest).alias("r")).select(
        F.col("r.token").alias("token"),
        "item",
        "need",
        F.col("r.at").alias("at"),
        # What stands left of the token, nearest first, and from the token on.
        F.reverse(
            F.slice(around, F.greatest(F.col("r.at") - before, F.lit(0)) + 1, F.least(F.col("r.at"), F.lit(before)))
        ).alias("item_left"),
        F.slice(around, F.col("r.at") + 1, F.lit(window)).alias("item_right"),
    )


def _same(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep_key: bool = False,
) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z in
    lower case. A window is `window` consecutive words of an item; a shorter item
    is one window; an item without words has none.

    Returns one row per document: id, n_words, n_hit, n_items, item_ids (sorted as
    strings) and spans (start, end in words, item; end exclusive); with keep_key
    also key, a hash of the text.

    Null text has no words; repeated rows each get the same answer; items with
    equal texts are found together; repeated items count once; a null item id
    counts as the item "null"; empty tables give no hits or no rows. Other columns
    are ignored.
    """
    items = materialize(
        _items(benchmark, item_col, item_text_col, window).withColumn(
            "item", F.coalesce("item", F.lit("null"))
        ),
        "items",
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    words = source.select(raw_words(F.col("text")).alias("words"))

    singles = items.where("need = 1").limit(1).count() > 0
    # Rarity over the whole corpus, of the benchmark's shingles only.
    vocabulary = materialize(items.select(F.explode(_item_tokens()).alias("token")).distinct(), "vocabulary")
    follows = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("b"))
    pairs = words.select(F.explode(follows).alias("w"))
    counts = None
    for block in _blocks(vocabulary, BLOCK_ROWS):
        part = (
            _tokens_of(pairs, F.col("w.a"), F.col("w.b"), singles).join(block, "token").groupBy("token").agg(F.count("*").alias("n"))
        )
        counts = part if counts is None else counts.unionByName(part)
    rarity = materialize(counts, "rarity")
    prefixes = materialize(_prefixes(items, rarity, window), "prefixes")

    # Each word row carries only the block of words around it, not its document.
    near = window - 1
    cuts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK_WORDS)))
    blocks = (
        source.select("id", F.xxhash64("text").alias("key"), raw_words(F.col("text")).alias("words"))
        .select(
            "id",
            "key",
            F.size("words").alias("n_words"),
            F.explode(
                F.transform(
                    cuts,
                    lambda s: F.struct(
                        s.alias("s"),
                        F.slice(
                            "words", F.greatest(s - near, F.lit(0)) + 1, F.least(s, F.lit(near)) + BLOCK_WORDS + near
                        ).alias("ctx"),
                    ),
                )
            ).alias("b"),
        )
        .select("id", "key", "n_words", F.col("b.s").alias("s"), F.col("b.ctx").alias("ctx"))
    )
    first = F.least("s", F.lit(near))
    own = F.arrays_zip(
        F.slice("ctx", first + 1, F.lit(BLOCK_WORDS)).alias("a"), F.slice("ctx", first + 2, F.lit(BLOCK_WORDS)).alias("b")
    )
    found = None
    before = max(window - 2, 0)
    for block in _blocks(prefixes, BLOCK_ROWS):
        p, q = F.col("p"), F.col("q")
        lower = lambda a: F.transform(a, ascii_lower)
        rows = blocks.select("id", "key", "n_words", "s", "ctx", F.posexplode(own).alias("j", "w")).where(
            # The second words of a block reach one further than its own.
            F.col("w.a").isNotNull()
        )
        aligned = (
            _tokens_of(rows, F.col("w.a"), F.col("w.b"), singles, "id", "key", "n_words", "s", "ctx", "j")
            .join(block, "token")
            .withColumn("p", F.col("s") + F.col("j"))
            .withColumn("q", F.least("s", F.lit(near)) + F.col("j"))
            # Length bound: the document holds a window. Positional bound: the words
            # left of the token and from it on, here and in the item, can make up a window.
            .where(F.col("n_words") >= F.col("need"))
            .where(F.least(p, F.size("item_left")) + F.least(F.col("n_words") - p, F.size("item_right")) >= F.col("need"))
            .select(
                "id",
                "key",
                "item",
                "need",
                "p",
                _same(
                    F.reverse(lower(F.slice("ctx", F.greatest(q - before, F.lit(0)) + 1, F.least(q, F.lit(before))))),
                    F.col("item_left"),
                ).alias("l"),
                _same(lower(F.slice("ctx", q + 1, F.lit(window))), F.col("item_right")).alias("r"),
            )
            # Exact containment: the run of equal words holds a whole window.
            .where((F.col("l") + F.col("r") >= F.col("need")) & (F.col("r") > 0))
        )
        found = aligned if found is None else found.unionByName(aligned)
    spans = (
        found.select("id", "key", "item", (F.col("p") - F.col("l")).alias("start"), (F.col("p") + F.col("r")).alias("end"))
        .groupBy("id", "key")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "end", "item"))).alias("spans"),
        )
        .withColumnRenamed("id", "hit_id")
        .withColumnRenamed("key", "hit_key")
    )
    base = source.select(
        "id",
        F.xxhash64("text").alias("key"),
        F.size(raw_words(F.col("text"))).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<struct<start:int,`end`:int,item:string>>")
    hits = F.coalesce("spans", none)
    # Spans are sorted by start: add what each one reaches beyond the furthest end.
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(
        hits,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    ids = F.array_sort(F.array_distinct(F.transform(hits, lambda s: s["item"])))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    return base.join(spans, same, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        hits.alias("spans"),
        *(["key"] if keep_key else []),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs.

    Rows are judged by id and text together, null ids included.
    """
    key = lambda d: F.xxhash64(F.coalesce(d[text_col].cast("string"), F.lit("")))
    keyed = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    found = contamination(keyed, benchmark, "__id", "__text", keep_key=True, **options)
    bad = materialize(
        found.where("n_hit > 0").select(F.col("__id").alias("__bad_id"), F.col("key").alias("__bad_key")).distinct(),
        "contaminated",
    )
    same = docs[id_col].eqNullSafe(F.col("__bad_id")) & (key(docs) == F.col("__bad_key"))
    return docs.join(bounded(bad), same, "left_anti")
