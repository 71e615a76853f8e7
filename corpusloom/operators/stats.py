"""Exact statistics and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array at position p * (n + 1), between neighbours; ends are extrapolated as the method does."""
    n = F.size(values)
    j = F.least(F.greatest(F.floor(F.lit(p) * (n + 1)), F.lit(1)), n - 1).cast("int")
    delta = F.lit(p) * (n + 1) - j
    low, high = F.get(values, j - 1), F.get(values, j)
    return F.when(n >= 2, low + (high - low) * delta).otherwise(F.get(values, F.lit(0)))


def summary(value: str) -> list[Column]:
    """Aggregates: n, mean, median, p10 and p90 (exclusive), min and max."""
    ordered = F.array_sort(F.collect_list(value))
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        exclusive_quantile(ordered, 0.1).alias("p10"),
        exclusive_quantile(ordered, 0.9).alias("p90"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def values_at(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column], cells: int = 1024) -> DataFrame:
    """The values of given ranks in each group, exactly, however large the group.

    ranks: name to a Column over n (the group's values that are not null), from 1;
    a rank outside 1 to n gives null. Equal values are counted before they move, a
    group's range is cut into cells, and only the cells that hold a wanted rank
    are put in order. A null group is a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    per_value = rows.groupBy(*group, "__v").agg(F.count("*").alias("__c"))
    bounds = per_value.groupBy(*(F.col(g).alias(f"__{g}") for g in group)).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("n")
    )
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    cell = F.least(F.floor((F.col("__v") - F.col("__lo")) / width * cells), F.lit(cells - 1)).alias("__cell")
    counted = per_value.join(bounds, same).select(*group, "__v", "__c", "n", cell)
    # At most `cells` rows a group from here on.
    upto = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counted.groupBy(*group, "n", "__cell").agg(F.sum("__c").alias("__s")).withColumn("__to", F.sum("__s").over(upto))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))
    found = sums.select("*", F.inline(wanted)).where((F.col("rank") <= F.col("__to")) & (F.col("rank") > F.col("__to") - F.col("__s")))
    key = found.select(
        *(F.col(g).alias(f"__{g}") for g in group), F.col("__cell").alias("__k"), "name", (F.col("rank") - F.col("__to") + F.col("__s")).alias("__r")
    )
    inside = Window.partitionBy(*group, "__cell", "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = counted.join(key, same & (F.col("__cell") == F.col("__k"))).withColumn("__run", F.sum("__c").over(inside))
    picked = hits.where((F.col("__run") >= F.col("__r")) & (F.col("__run") - F.col("__c") < F.col("__r")))
    named = picked.groupBy(*group).agg(*(F.max(F.when(F.col("name") == k, F.col("__v"))).alias(k) for k in ranks))
    return bounds.select(*(F.col(f"__{g}").alias(g) for g in group), "n").join(
        named.select(*(F.col(g).alias(f"__{g}") for g in group), *ranks), same, "left"
    ).drop(*(f"__{g}" for g in group))


def exclusive_quantiles(df: DataFrame, group: list[str], value: str, ps: list[float]) -> DataFrame:
    """Exclusive quantiles of each group, from the values of two ranks each; a single value is its own quantile."""
    n = F.col("n")
    place = lambda p: F.lit(p) * (n + 1)
    low_rank = lambda p: F.least(F.greatest(F.floor(place(p)), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    ranks = {}
    for p in ps:
        ranks[f"a{round(p * 100)}"] = low_rank(p)
        ranks[f"b{round(p * 100)}"] = F.least(low_rank(p) + 1, n)
    found = values_at(df, group, value, ranks)
    quantile = lambda p: F.col(f"a{round(p * 100)}") + (F.col(f"b{round(p * 100)}") - F.col(f"a{round(p * 100)}")) * (place(p) - low_rank(p))
    return found.select(*group, *(quantile(p).alias(f"p{round(p * 100)}") for p in ps))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The element at n div 2 of the sorted values."""
    found = values_at(df, group, value, {"median_upper": F.floor(F.col("n") / 2) + 1})
    return found.select(*group, F.col("median_upper").cast(df.schema[value].dataType).alias("median_upper"))


def population_moments(value: Column, floor: float = 1e-3) -> list[Column]:
    """Mean and population deviation of the values above zero; the deviation has a floor."""
    voiced = F.when(value > 0, value)
    return [F.avg(voiced).alias("mean"), F.greatest(F.stddev_pop(voiced), F.lit(floor)).alias("std"), F.count(voiced).alias("n")]


def most_common(df: DataFrame, key: list[str], ordinal: str, k: int) -> DataFrame:
    """The k most frequent keys; ties go to the one that came first."""
    counts = df.groupBy(*key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).drop("first")


def form_consistency(df: DataFrame, key: str, form: str, ordinal: str, unit: str, samples: int = 5) -> DataFrame:
    """Per key: count, forms, share of the top form, and the first sample units of it.

    Counts are combined before they move. The samples are the first rows of each top
    form, which Spark limits on both sides of the shuffle: no form's rows meet in one task.
    """
    counts = df.groupBy(key, form).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    tops = counts.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.count("*").alias("forms"),
        F.max(F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col(form).alias("form"))).alias("top"),
    )
    place = F.row_number().over(Window.partitionBy(key, form).orderBy(ordinal))
    first = df.select(key, form, ordinal, unit).withColumn("__r", place).where(F.col("__r") <= samples)
    rows = first.groupBy(F.col(key).alias("__k"), F.col(form).alias("__f")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(unit).alias("u")))).alias("s"))
    return tops.join(rows, (F.col(key) == F.col("__k")) & (F.col("top.form") == F.col("__f"))).select(
        key,
        "total",
        "forms",
        F.col("top.form").alias("majority"),
        F.col("top.n").alias("majority_n"),
        (F.col("top.n") / F.col("total")).alias("consistency"),
        F.transform("s", lambda x: x["u"]).alias("samples"),
    )


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that fires, null if none does."""
    return F.coalesce(*(F.when(test, name) for name, test in rules))


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that fire, joined by '; '; null if none does."""
    joined = F.array_join(F.array_compact(F.array(*(F.when(test, name) for name, test in rules))), "; ")
    return F.nullif(joined, F.lit(""))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], amount: str) -> DataFrame:
    """Rows and amount that are left after each step; one pass, one row a step."""
    test, out = F.lit(True), []
    for name, step in steps:
        test = test & F.coalesce(step, F.lit(False))
        out.append(
            F.struct(
                F.lit(len(out)).alias("step"),
                F.lit(name).alias("name"),
                F.count_if(test).alias("rows"),
                F.coalesce(F.sum(F.when(test, F.col(amount))), F.lit(0)).cast("double").alias("amount"),
            )
        )
    return df.agg(F.array(*out).alias("s")).select(F.inline("s"))


def robust_center(df: DataFrame, group: list[str], value: str, spread: float = 1.6) -> DataFrame:
    """Median of the values within a factor of the group's median, if three or more are left; else the median."""
    middle = df.groupBy(*group).agg(F.median(value).alias("__m"))
    near = (
        df.join(middle, group)
        .where((F.col(value) > F.col("__m") / spread) & (F.col(value) < F.col("__m") * spread))
        .groupBy(*group)
        .agg(F.median(value).alias("__near"), F.count("*").alias("__k"))
    )
    return middle.join(near, group, "left").select(
        *group, F.when(F.col("__k") >= 3, F.col("__near")).otherwise(F.col("__m")).alias("center")
    )


def band(n: Column) -> Column:
    """frequent from 10, mid from 3, else rare."""
    return F.when(n >= 10, "frequent").when(n >= 3, "mid").otherwise("rare")


def reason_class(reason: Column) -> Column:
    """Class of a failure reason; the first rule that finds its sign wins."""
    # Signs of each class in order.
    rules = (
        ("429-API", ("429",)),
        ("SKELETON", ("الهيكل",)),
        ("TAA", ("المربوطة",)),
        ("TANWEEN", ("تنوين",)),
        ("PARSE", ("التحليل",)),
        ("DENSITY", ("الحركات", "خالٍ")),
    )
    tests = []
    for name, signs in rules:
        hit = F.lit(False)
        for s in signs:
            hit = hit | reason.contains(s)
        tests.append((name, hit))
    return F.coalesce(first_reason(tests), F.lit("OTHER"))


def best_form(df: DataFrame, key: str, form: str, deep: str, ordinal: str) -> DataFrame:
    """Per key the most frequent deep form, failing that the most frequent one; ties go to the first seen."""
    counts = df.groupBy(key, form, deep).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    best = F.max_by(F.struct(form, "n", deep), F.struct(F.col(deep).cast("int").alias("d"), "n", (-F.col("first")).alias("f")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, f"b.{form}", "b.n", f"b.{deep}")


def worst_case(highest: list[str], lowest: list[str]) -> list[Column]:
    """The worst value of each measure: the highest of some, the lowest of others; nulls are passed over."""
    return [F.max(c).alias(c) for c in highest] + [F.min(c).alias(c) for c in lowest]


def environments(df: DataFrame, key: str, form: str, environment: str, ordinal: str, unit: str, samples: int = 2) -> DataFrame:
    """Per key: occurrences, forms and environments with their counts, and the first units."""
    counts = df.groupBy(key, form, environment).agg(F.count("*").alias("n"))
    listed = lambda c: F.array_sort(F.collect_list(F.struct(c, "n")))
    forms = counts.groupBy(key, form).agg(F.sum("n").alias("n")).groupBy(key).agg(F.sum("n").alias("total"), listed(form).alias("forms"))
    places = counts.groupBy(F.col(key).alias("__k"), environment).agg(F.sum("n").alias("n")).groupBy("__k").agg(listed(environment).alias("environments"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    first = df.select(key, ordinal, unit).withColumn("__r", nth).where(F.col("__r") <= samples)
    units = first.groupBy(F.col(key).alias("__u")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(unit).alias("u")))).alias("s"))
    return (
        forms.join(places, F.col(key) == F.col("__k"))
        .join(units, F.col(key) == F.col("__u"))
        .select(key, "total", "forms", "environments", F.transform("s", lambda x: x["u"]).alias("samples"))
    )


def repeated_words(df: DataFrame, key: str, form: str, least: int = 2) -> DataFrame:
    """Keys that occur at least `least` times: whether always in one form, and in how many."""
    counts = df.groupBy(key, form).agg(F.count("*").alias("n"))
    return (
        counts.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("forms")).where(F.col("total") >= least)
        .withColumn("consistent", F.col("forms") == 1)
    )


def class_rates(df: DataFrame, cls: str, value: str, hit: Column, near: Column, least: float) -> DataFrame:
    """Per class: mean value, share of values from `least` on, share of hits, and of hits among those with something near."""
    return df.groupBy(cls).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.avg((F.col(value) >= least).cast("int")).alias("share_high"),
        F.avg(hit.cast("int")).alias("hit_rate"),
        F.avg(F.when(near, hit.cast("int"))).alias("hit_rate_near"),
    )


def ranked_by(df: DataFrame, key: str, amount: str, k: int) -> DataFrame:
    """The k keys with the largest sums; of equal sums the smaller key first."""
    return df.groupBy(key).agg(F.sum(amount).alias("total")).orderBy(F.desc("total"), key).limit(k)


def all_hold(groups: DataFrame, df: DataFrame, key: str, test: Column) -> DataFrame:
    """Per group whether every row passes; a group without rows does not."""
    held = df.groupBy(F.col(key).alias("__k")).agg(F.bool_and(test).alias("__all"))
    return groups.join(held, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__all", F.lit(False)).alias("all_hold"))


def status_shape(df: DataFrame, part: str, status: str, good: str, bad: str) -> DataFrame:
    """Counts of each status in each part and over all (part null), with the share of good among good and bad."""
    counts = df.groupBy(part, status).agg(F.count("*").alias("n"))
    totals = counts.groupBy(status).agg(F.sum("n").alias("n")).select(F.lit(None).cast(df.schema[part].dataType).alias(part), status, "n")
    per = counts.unionByName(totals)
    of = lambda s: F.coalesce(F.sum(F.when(F.col(status) == s, F.col("n"))), F.lit(0))
    rate = per.groupBy(F.col(part).alias("__p")).agg((of(good) / F.nullif(of(good) + of(bad), F.lit(0))).alias("success"))
    return per.join(rate, F.col(part).eqNullSafe(F.col("__p"))).drop("__p")


def cascade(df: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """key, reason and done of rows in the order of the rules: a row that a rule drops is done, one that passes is still to do."""
    reason = first_reason(rules)
    return df.select(key, reason.alias("reason"), reason.isNotNull().alias("done"))
