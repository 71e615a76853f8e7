"""Selections, categories, updates and small reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import small


def pool_category(split: Column, tokens: Column, frames: Column, max_tokens: int = 160, max_frames: int = 950) -> Column:
    """train_pool below both caps, train_borderline above one, else val."""
    return F.when((split == "train") & (tokens <= max_tokens) & (frames <= max_frames), "train_pool").when(split == "train", "train_borderline").otherwise("val")


def clamp(value: Column, low, high) -> Column:
    """value within low and high; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def allowed(value: Column, choices: list, default) -> Column:
    """value if it is one of the choices, else the default."""
    return F.when(value.isin(*choices), value).otherwise(F.lit(default))


def complete(remaining: Column, dead: Column, cap: int) -> Column:
    """All sides have nothing left and no more dead letters than the cap (an aggregate)."""
    return F.bool_and((remaining == 0) & (dead <= cap))


def cross_product(left: DataFrame, right: DataFrame, most: int = 10_000_000) -> DataFrame:
    """Every pair of two stated lists; refused when there would be more than `most`."""
    n = left.count() * right.count()
    if n > most:
        raise ValueError(f"{n} pairs are more than {most}")
    return left.crossJoin(F.broadcast(right))


def prefixed_forms(stems: DataFrame, stem: str, prefixes: list[str], counts: DataFrame, word: str, n: str) -> DataFrame:
    """Corpus counts of every prefix with every stem."""
    made = stems.select(stem, F.explode(F.array(*(F.lit(p) for p in prefixes))).alias("prefix")).withColumn("__w", F.concat("prefix", stem))
    return made.join(counts, F.col("__w") == F.col(word)).select(stem, "prefix", n)


def expected_hits(runs: DataFrame, key: list[str], total: DataFrame, length: int) -> DataFrame:
    """Chance that a segment of `length` frames, placed at random, touches a run: exact, over all places.

    runs: start, stop; total: frames of each key. A place s touches a run if
    start - length < s < stop; the places of a key's runs are united in order.
    """
    t = total.withColumnRenamed("frames", "__n")
    w = Window.partitionBy(*key).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    places = runs.join(t, key).select(
        *key, "__n", F.greatest(F.col("start") - length + 1, F.lit(0)).alias("__a"), F.least(F.col("stop"), F.col("__n") - length + 1).alias("__b")
    )
    before = F.coalesce(F.max("__b").over(w), F.lit(0))
    new = places.withColumn("__new", F.greatest(F.lit(0), F.col("__b") - F.greatest("__a", before)))
    hits = new.groupBy(*key).agg(F.sum("__new").alias("__hits"))
    return t.join(hits, key, "left").select(
        *key, F.when(F.col("__n") >= length, F.coalesce("__hits", F.lit(0)) / (F.col("__n") - length + 1)).alias("chance")
    )


def exposure(tokens: Column, wanted: list) -> list[Column]:
    """How often each wanted token stands in an array."""
    return [_seen(tokens, w) for w in wanted]


def _seen(tokens: Column, wanted) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(wanted))).alias(f"seen_{wanted}")


def signal_audit(samples: Column, silent: float = 1e-3, clipped: float = 0.999) -> list[Column]:
    """Peak, share of silent samples, share of clipped samples of an array."""
    n = F.greatest(F.size(samples), F.lit(1))
    part = lambda test: F.size(F.filter(samples, test)) / n
    return [
        F.array_max(F.transform(samples, lambda x: F.abs(x))).cast("double").alias("peak"),
        part(lambda x: F.abs(x) < silent).alias("silent"),
        part(lambda x: F.abs(x) >= clipped).alias("clipped"),
    ]


def context_window(words: Column, target: str, span: int = 3) -> Column:
    """The words around the first match of a target; null without a match."""
    at = F.array_position(words, target)
    first = F.greatest(at - span, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(words, first, at + span - first + 1), " "))


def word_index(is_separator: Column, key: list[str], order: str) -> Column:
    """Number of separators before a token: the number of its word."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.count_if(is_separator).over(w), F.lit(0))


def by_priority(value: Column, order: list) -> Column:
    """Rank of a value in a list of priorities, last for all others."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(value == v, i).otherwise(out)
    return out


def newest(df: DataFrame, name: str, pattern: str = r"(\d+)\D*$") -> DataFrame:
    """The row whose name has the largest number at its end."""
    number = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long")
    return df.where(number.isNotNull()).orderBy(F.desc(number), name).limit(1)


def dedup_with_alternates(df: DataFrame, key: str, form: str, ordinal: str) -> DataFrame:
    """One row a key: its first form, and the other forms in order of arrival."""
    firsts = df.groupBy(key, form).agg(F.min(ordinal).alias("__o"))
    forms = F.array_sort(F.collect_list(F.struct("__o", form)))
    return firsts.groupBy(key).agg(forms.alias("__f")).select(
        key, F.get("__f", F.lit(0))[form].alias(form), F.transform(F.slice("__f", F.lit(2), F.greatest(F.size("__f") - 1, F.lit(0))), lambda x: x[form]).alias("alternates")
    )


def disjoint(left: DataFrame, right: DataFrame, key: str) -> bool:
    return left.select(key).intersect(right.select(key)).isEmpty()


def stratified(df: DataFrame, stratum: str, order: list[Column], sizes: dict) -> DataFrame:
    """The first so many rows of each stratum."""
    w = Window.partitionBy(stratum).orderBy(*order)
    want = F.try_element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col(stratum))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= want).drop("__r")


def with_guaranteed(sample: DataFrame, must: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """n rows that hold all of `must`, the rest from the sample in order."""
    rest = sample.join(must.select(key), key, "left_anti").orderBy(order).limit(max(0, n - must.count()))
    return must.unionByName(rest)


def inverted(mapping: Column) -> Column:
    """Values to keys; of equal values the last key in map order stays."""
    entries = F.map_entries(mapping)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda o: o["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))


def audited_update(df: DataFrame, changes: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(updated table, log). changes: key, new, old, why; a row whose value is not the expected old one is an error."""
    c = small(changes)
    joined = df.join(c, key, "left")
    bad = F.col("new").isNotNull() & ~F.col(value).eqNullSafe(F.col("old"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unexpected value of "), F.col(key).cast("string")))).otherwise(F.coalesce("new", value))
    updated = joined.withColumn(value, checked.cast(df.schema[value].dataType)).select(*df.columns)
    log = df.join(c, key).select(key, F.col(value).alias("was"), F.col("new").alias("is"), "why")
    return updated, log


def call_accounting(calls: DataFrame) -> DataFrame:
    """Calls, characters and tokens by kind with the tokens a call; calls: kind, chars, prompt, completion."""
    return calls.groupBy("kind").agg(
        F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"),
        F.round(F.sum(F.col("prompt") + F.col("completion")) / F.count("*"), 4).alias("per_call"),
    )


def cached_models(load: Callable[[str], object], most: int = 3) -> Callable[[str], object]:
    """A loader that keeps the last few models of a worker."""
    return lru_cache(maxsize=most)(load)
