"""Windows, runs, merges by precedence, selection and sharding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def precedence_merge(df: DataFrame, key: str, status: str, order: str, ranks: dict[str, int]) -> DataFrame:
    """One record a key: the highest status rank, the latest of equal ones. Unknown statuses are ignored."""
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col(status))
    rest = [c for c in df.columns if c != key]
    best = df.withColumn("__rank", rank).where("__rank is not null and " + key + " is not null")
    return best.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__rank", order)).alias("__r")).select(
        key, *(F.col(f"__r.{c}").alias(c) for c in rest)
    )


def retry_set(inputs: DataFrame, records: DataFrame, key: str, status: str, settled: list[str]) -> DataFrame:
    """Inputs without a settled record, marked failed or missing."""
    state = records.groupBy(key).agg(F.bool_or(F.coalesce(F.col(status).isin(*settled), F.lit(False))).alias("__done"))
    joined = inputs.join(state, key, "left")
    return joined.where(~F.coalesce("__done", F.lit(False))).withColumn(
        "why", F.when(F.col("__done").isNull(), "missing").otherwise("failed")
    ).drop("__done")


def islands(df: DataFrame, key: list[str], order: str, test: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows for which test holds: first and last position and length, from `least` rows on."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).where(test)
    runs = rows.withColumn("__g", F.col("__i") - F.row_number().over(w))
    return (
        runs.groupBy(*key, "__g")
        .agg(F.min("__i").alias("start"), (F.max("__i") + 1).alias("stop"), F.count("*").alias("length"))
        .where(F.col("length") >= least)
        .drop("__g")
    )


def offsets(key: list[str], order: str, size: str) -> list[Column]:
    """start and stop of consecutive segments by running sums."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(size).over(w)
    return [(stop - F.col(size)).alias("start"), stop.alias("stop")]


def forward_fill(value: str, key: list[str], order: str) -> Column:
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def next_value(value: str, key: list[str], order: str) -> Column:
    """The next value that is not null.

    Taken backwards, as a frame that ends with the group is read again for each of its rows.
    """
    w = Window.partitionBy(*key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def capped_selection(df: DataFrame, group: str, inner: str, order: list[Column], per_inner: int, per_group: int) -> DataFrame:
    """At most per_inner rows of each inner value of a group, then at most per_group rows of the group."""
    a = Window.partitionBy(group, inner).orderBy(*order)
    b = Window.partitionBy(group).orderBy(*order)
    return (
        df.withColumn("__a", F.row_number().over(a))
        .where(F.col("__a") <= per_inner)
        .withColumn("__b", F.row_number().over(b))
        .where(F.col("__b") <= per_group)
        .drop("__a", "__b")
    )


def stride_sample(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """n rows of each group at positions int(i * L / n); a smaller group gives all its rows."""
    w = Window.partitionBy(*group).orderBy(order)
    whole = Window.partitionBy(*group)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__l", F.count("*").over(whole))
    # Row p is taken if some i has floor(i * L / n) = p.
    i = F.ceil(F.col("__i") * n / F.col("__l"))
    hit = (F.floor(i * F.col("__l") / n) == F.col("__i")) & (i < n)
    return rows.where(hit | (F.col("__l") <= n)).drop("__i", "__l")


def _cell(value: Column, bounds: list[float], low: int = 0) -> Column:
    """How many of the sorted bounds are not above the value, by halving."""
    if not bounds:
        return F.lit(low)
    half = len(bounds) // 2
    return F.when(value < bounds[half], _cell(value, bounds[:half], low)).otherwise(_cell(value, bounds[half + 1 :], low + half + 1))


def positions(df: DataFrame, order: str, cells: int = 64) -> DataFrame:
    """df with `position`, the 0-based place of each row in order of a number column.

    Rows are ranked inside cells between sampled quantiles of the column, and the sizes
    of the cells are added up: a task ranks about one in `cells` of the rows, however
    the values lie, and all rows of one value. Ties are ordered arbitrarily; rows without a value have no place.
    """
    bounds = sorted(set(df.approxQuantile(order, [i / cells for i in range(1, cells)], 0.5 / cells)))
    rows = df.withColumn("__cell", F.when(F.col(order).isNotNull(), _cell(F.col(order), bounds)))
    sizes = rows.where("__cell is not null").groupBy("__cell").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row a cell.
    base = sizes.select(F.col("__cell").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(order))
    return (
        rows.withColumn("__r", place)
        .join(F.broadcast(base), F.col("__cell") == F.col("__at"), "left")
        .withColumn("position", F.col("__base") + F.col("__r") - 1)
        .drop("__cell", "__at", "__r", "__base")
    )


def contiguous_shards(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with `shard`: n contiguous shards in order, the first ones one row longer."""
    total = df.count()
    size, extra = divmod(total, n)
    p = F.col("position")
    long_rows = extra * (size + 1)
    shard = F.when(p < long_rows, F.floor(p / (size + 1))).otherwise(extra + F.floor((p - long_rows) / max(size, 1)))
    return positions(df, order).withColumn("shard", shard.cast("int")).drop("position")


def keyed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of key and seed: a sample that can be drawn again."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def keyed_split(key: Column, percent: int) -> Column:
    """train or val by a hash of the key that any engine can take again (the first 32 bits of its MD5)."""
    part = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(part % 100 < percent, "train").otherwise("val")


def number_on(df: DataFrame, order: str, known: DataFrame, column: str) -> DataFrame:
    """df with `seq`: numbers that go on from the largest one of `known` (0 where there is none)."""
    last = known.agg(F.coalesce(F.max(column), F.lit(-1))).first()[0]
    return positions(df, order).withColumn("seq", F.col("position") + (last + 1)).drop("position")


def largest_first(df: DataFrame, size: str, key: str) -> DataFrame:
    """Work in the order in which it is to be started: the largest first, ties by key."""
    return df.orderBy(F.desc(size), key)


def by_length(df: DataFrame, batch: str, length: str, key: str) -> DataFrame:
    """Rows of each batch by descending length, with their place in it."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc(length), key)) - 1)


def head_without(df: DataFrame, key: str, excluded: DataFrame, n: int) -> DataFrame:
    """The first n rows by key that are not excluded."""
    return df.join(excluded.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


def fixed_subset(df: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows of a fixed list of keys, with their place in the list."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("place", T.IntegerType())]))
    return df.join(F.broadcast(listed), key)


def _batches(groups: int, cap: int):
    """Numbers the batches of rows that come sorted by group; carries the open batch over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(groups + 1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [batch.column(i) for i in range(groups)]
            same = np.ones(len(size) - 1, bool)
            for c in columns:
                equal = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                both = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
                same &= equal | both
            out = np.empty(len(size), np.int32)
            upto = np.cumsum(size)
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(size)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                key = tuple(c[a].as_py() for c in columns)
                if key != group:
                    group, number, held = key, 0, 0
                while a < b:
                    # Rows up to the first one that would exceed the cap; an empty batch takes any row.
                    before = int(upto[a] - size[a])
                    end = int(np.searchsorted(upto[a:b], before + cap - held, "right")) + a
                    if end == a and held:
                        number, held = number + 1, 0
                        continue
                    end = max(end, a + 1)
                    out[a:end] = number
                    held += int(upto[end - 1]) - before
                    a = end
            yield pa.RecordBatch.from_arrays([*columns, batch.column(groups), pa.array(out)], names=[*batch.schema.names[: groups + 1], "batch"])

    return run


def byte_batches(df: DataFrame, group: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Greedy batches in order: a batch is closed when the next row would exceed the cap.

    Each batch depends on where the one before it ended, so a group is read in order by
    one task, as a stream: only its open batch is held. Null sizes count as 0.
    """
    rows = df.select(*group, order, F.col(size).cast("long").alias("__size"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("batch", T.IntegerType())])
    return rows.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(_batches(len(group), cap), schema)


def quota_epoch(df: DataFrame, side: str, order: str, duration: str, quotas: dict[str, float], epoch: int = 0) -> DataFrame:
    """Rows of an epoch: each side's ring is read on from where the last epoch stopped until its quota is met.

    The ring position after e epochs is the first place where the running duration
    reaches e quotas, so an epoch needs one running sum and no state.
    """
    w = Window.partitionBy(side).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(side)
    q = F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(side))
    rows = df.withColumn("__to", F.sum(duration).over(w)).withColumn("__all", F.sum(duration).over(whole)).withColumn("__q", q)
    laps = F.sequence(F.lit(0), F.ceil((epoch + 1) * F.col("__q") / F.col("__all")).cast("int"))
    lap = rows.withColumn("lap", F.explode(laps)).withColumn("__end", F.col("__to") + F.col("lap") * F.col("__all"))
    begin = F.col("__end") - F.col(duration)
    return lap.where((begin >= epoch * F.col("__q")) & (begin < (epoch + 1) * F.col("__q"))).drop("__to", "__all", "__q", "__end")


def running_upper_median(value: str, key: list[str], order: str, rows: int) -> Column:
    """Upper median of the `rows` values before a row; null for the first one."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-rows, -1)
    seen = F.array_sort(F.collect_list(value).over(w))
    return F.get(seen, F.floor(F.size(seen) / 2).cast("int"))
