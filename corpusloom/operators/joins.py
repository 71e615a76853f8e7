"""Joins by key variants, position, interval and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.keys import words

BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def variant_lookup(df: DataFrame, keys: Column, lexicon: DataFrame, key: str, row: list[str]) -> DataFrame:
    """Each row with the lexicon entry of its first key that has one; rows without an entry are left out.

    keys: array of candidate keys, best first. row: columns that name a row.
    """
    tried = df.select(*row, F.posexplode(keys).alias("__priority", "__key"))
    hits = tried.join(small(lexicon), F.col("__key") == F.col(key))
    rest = [c for c in lexicon.columns if c != key]
    best = hits.groupBy(*row).agg(F.min(F.struct("__priority", "__key", *rest)).alias("__b"))
    return best.select(*row, F.col("__b.__key").alias("matched"), *(F.col(f"__b.{c}").alias(c) for c in rest))


def suffix_stages(skel: Column, suffixes: list[str], least: int = 2) -> Column:
    """Candidate keys in stages: the word, then without each suffix, each then without up to three prefixes."""
    bases = [skel] + [
        F.when(skel.endswith(s) & (F.length(skel) - len(s) >= least), F.substring(skel, F.lit(1), F.length(skel) - len(s))) for s in suffixes
    ]
    all_bases = F.array_compact(F.array(*bases))
    out = all_bases
    layer = all_bases
    for _ in range(3):
        layer = F.array_compact(
            F.transform(
                layer,
                lambda b: F.when(b.startswith("Al") & (F.length(b) > 3), F.substring(b, 3, 1 << 30)).when(
                    b.rlike("^[wfblk]") & (F.length(b) > 2), F.substring(b, 2, 1 << 30)
                ),
            )
        )
        out = F.concat(out, layer)
    return F.array_distinct(out)


def coverage(df: DataFrame, word: str, lexicon: DataFrame, key: str) -> DataFrame:
    """df with `covered`: direct, prefix (one letter of و ف ب stripped) or none."""
    lex = small(lexicon.select(F.col(key).alias("__k")).distinct())
    direct = df.join(lex.withColumn("__d", F.lit(1)), F.col(word) == F.col("__k"), "left").drop("__k")
    tail = F.when(F.col(word).rlike("^[وفبwfb]") & (F.length(word) > 3), F.substring(word, 2, 1 << 30))
    both = direct.withColumn("__t", tail).join(lex.withColumn("__p", F.lit(1)), F.col("__t") == F.col("__k"), "left")
    how = F.when(F.col("__d") == 1, "direct").when(F.col("__p") == 1, "prefix").otherwise("none")
    return both.withColumn("covered", how).drop("__k", "__t", "__d", "__p")


def zip_words(df: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """Words of two texts side by side (position, a, b); texts with different numbers of words are left out."""
    a, b = words(F.col(left)), words(F.col(right))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return df.where(F.size(a) == F.size(b)).select(*keep, F.posexplode(pairs).alias("position", "p")).select(
        *keep, "position", F.col("p.a").alias("a"), F.col("p.b").alias("b")
    )


def overlaps(left: DataFrame, right: DataFrame, on: list[str], bucket: int) -> DataFrame:
    """Pairs of intervals of one key that overlap: start < b and a < end.

    left: start, stop; right: a, b. Both sides are dealt to buckets of positions, so
    that a key with many intervals is joined in pieces; a pair is kept only in the
    bucket in which its common part begins.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / bucket), F.floor((e - 1) / bucket)))
    l_side = left.where("stop > start").withColumn("__cell", cells(F.col("start"), F.col("stop")))
    r_side = right.where("b > a").withColumn("__cell", cells(F.col("a"), F.col("b")))
    joined = l_side.join(r_side, [*on, "__cell"])
    starts_here = F.floor(F.greatest("start", "a") / bucket) == F.col("__cell")
    return joined.where((F.col("start") < F.col("b")) & (F.col("a") < F.col("stop")) & starts_here).drop("__cell")


def containing(points: DataFrame, intervals: DataFrame, on: list[str], at: str) -> DataFrame:
    """As-of join: every point with the last interval of its key that starts at or before it, if it still holds there.

    One window over the union of both sides; no pairs are made.
    """
    cols = [c for c in intervals.columns if c not in on]
    whole = F.struct(*(F.col(c) for c in cols))
    left = points.select(*on, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__p"))
    right = intervals.select(*on, F.col("start").alias("__t"), F.lit(0).alias("__kind"), whole.alias("__i"))
    w = Window.partitionBy(*on).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    found = both.withColumn("__o", F.last("__i", ignorenulls=True).over(w)).where("__kind = 1")
    holds = F.col("__o.stop") > F.col("__t")
    return found.select("__p.*", *(F.when(holds, F.col(f"__o.{c}")).alias(c) for c in cols))


def nearest(points: DataFrame, targets: DataFrame, on: list[str], at: str, place: str, none: float = 1e9) -> DataFrame:
    """Every point with the distance to the nearest target of its key, before or behind it.

    The nearest one is the last before or the first after: two windows over the union.
    """
    left = points.select(*on, F.col(at).cast("double").alias("__t"), F.struct(*points.columns).alias("__p"))
    right = targets.select(*on, F.col(place).cast("double").alias("__t"), F.col(place).cast("double").alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    before = Window.partitionBy(*on).orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*on).orderBy("__t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = F.least(F.col("__t") - F.max("__v").over(before), F.min("__v").over(after) - F.col("__t"))
    return both.withColumn("distance", F.coalesce(near, F.lit(none))).where("__p is not null").select("__p.*", "distance")


def first_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: the one with the smallest ordinal."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def override(df: DataFrame, key: str, form: str, ordinal: str) -> DataFrame:
    """One row a key: the last form, and whether an earlier, different one was replaced."""
    return df.groupBy(key).agg(
        F.max_by(form, ordinal).alias(form), F.min_by(form, ordinal).alias("was"), (F.count_distinct(form) > 1).alias("replaced")
    )


def two_sided_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    )


def phrase_spans(df: DataFrame, row: list[str], found: Column, phrases: DataFrame) -> DataFrame:
    """Where phrases stand in texts: row, phrase, start (the number of the first word).

    found: the words of a text; phrases: phrase (a name) and pattern (array of words). Spans
    of one phrase do not overlap, from left to right; those of different phrases may. The
    phrases are looked up by their first word and verified on the words behind it.
    """
    texts = df.select(*row, found.alias("__w"))
    first = small(phrases.where(F.size("pattern") > 0).select("phrase", "pattern", F.col("pattern")[0].alias("__first")).distinct())
    at = texts.select(*row, "__w", F.posexplode("__w").alias("__at", "__word")).join(first, F.col("__word") == F.col("__first"))
    hits = at.where(F.slice("__w", F.col("__at") + 1, F.size("pattern")) == F.col("pattern"))
    grouped = hits.groupBy(*row, "phrase").agg(F.max(F.size("pattern")).alias("__k"), F.array_sort(F.collect_list("__at")).alias("__p"))
    none = F.array().cast("array<int>")
    kept = F.aggregate(
        "__p", none, lambda acc, p: F.when((F.size(acc) == 0) | (p >= F.element_at(acc, -1) + F.col("__k")), F.concat(acc, F.array(p))).otherwise(acc)
    )
    # A single span needs no fold.
    return grouped.select(*row, "phrase", F.explode(F.when(F.size("__p") == 1, F.col("__p")).otherwise(kept)).alias("start"))


def rows_not_in(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of df that equal no row of `other` in all columns, nulls equal to nulls; repeats stay."""
    right = other.select(*(F.col(c).alias(f"__r_{c}") for c in df.columns)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in df.columns]
    on = same[0]
    for s in same[1:]:
        on &= s
    return df.join(right, on, "left_anti")
