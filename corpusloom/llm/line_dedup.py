"""Boilerplate lines by their frequency within a site.

For every host the share of its pages that contain a line is the line's
boilerplate ratio; lines above the threshold are dropped from the pages of that
host. Two passes over the texts, none of which shuffles a text: the first moves
128-bit line digests (combined map-side, so that a line on a third of all pages
is one row a task), the second filters each page's lines in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import BROADCAST_ROWS, materialize

#: Dropped when on more than this share of the host's pages.
MAX_RATIO = 0.10
#: A line of a single page repeats nothing, whatever its share of a tiny site.
MIN_PAGES = 2
#: White space at the ends of a line that does not count.
OUTER = " \t\r"
#: Salts of the join that stands in for the broadcast of a large line list.
SALTS = 32


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def bare(line: Column) -> Column:
    plain = ~(line.contains("\t") | line.contains("\r"))  # trimming spaces alone is much quicker
    return F.when(plain, F.trim(line)).otherwise(F.btrim(line, F.lit(OUTER)))


def line_key(line: Column) -> Column:
    """128-bit digest of a line without its outer spaces, tabs and carriage returns."""
    return F.unhex(F.md5(F.encode(bare(line), "UTF-8")))


def boilerplate_lines(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, keys): per host the digests of its boilerplate lines. pages: host, text.

    A host has at most (mean lines a page) / max_ratio such lines, so the array
    is bounded however many pages the host has.
    """
    keys = F.array_distinct(
        F.transform(
            F.filter(F.split("text", "\n"), lambda x: bare(x) != ""), line_key
        )
    )
    # A null key marks the page itself: one aggregation counts pages and lines.
    marked = F.concat(keys, F.array(F.lit(None).cast("binary")))
    counts = materialize(
        pages.select("host", F.explode(marked).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= min_pages) | F.col("key").isNull()),
        "line-counts",
    )
    totals = counts.where("key is null").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    if totals.count() <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    lines = counts.where("key is not null").join(totals, F.col("host").eqNullSafe(F.col("h")))
    return (
        lines.where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


def drop_boilerplate(
    df: DataFrame,
    host: Column | str,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    dropped_col: str | None = "lines_dropped",
) -> DataFrame:
    """df with the boilerplate lines of each host taken out of text_col.

    A line is compared without its outer spaces, tabs and carriage returns; blank lines are neither counted
    nor dropped, the others keep their text and order. A line counts once a page.
    Null text stays null and counts as a page without lines; rows of a null host
    form one site; repeated rows are pages of their own; a ratio that equals the
    threshold keeps the line; an empty table gives an empty result. All columns
    of df stay, whatever their names, but one named dropped_col gives way to it;
    dropped_col (long) is appended unless None.
    """
    spark = df.sparkSession
    host = F.col(host) if isinstance(host, str) else host
    text = F.col(text_col)
    pages = df.select(host.alias("host"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    bad = materialize(boilerplate_lines(pages, max_ratio, min_pages), "boilerplate")
    prefix = "__ld"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    fresh = {c: f"{prefix}{c}" for c in ("host", "host_b", "keys", "salt", "salt_b", "kept")}
    bad = bad.select(F.col("host").alias(fresh["host_b"]), F.col("keys").alias(fresh["keys"]))
    rows = df.withColumn(fresh["host"], host)
    same = F.col(fresh["host"]).eqNullSafe(F.col(fresh["host_b"]))
    lines_listed = bad.agg(F.coalesce(F.sum(F.size(fresh["keys"])), F.lit(0))).first()[0]
    if lines_listed <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(bad), same, "left")
    else:
        # Too many hosts to broadcast: a shuffle in which a hot host is dealt by salt.
        # The salt follows from the row, so that a recomputed partition deals it alike.
        rows = rows.withColumn(fresh["salt"], F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn(fresh["salt_b"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(bad, same & (F.col(fresh["salt"]) == F.col(fresh["salt_b"])), "left")
    keys = F.col(fresh["keys"])
    lines = F.split(text.cast("string"), "\n")
    kept = F.filter(lines, lambda x: (bare(x) == "") | ~F.array_contains(keys, line_key(x)))
    out = joined.withColumn(fresh["kept"], F.when(keys.isNotNull() & text.isNotNull(), kept))
    changed = F.col(fresh["kept"])
    cut = F.coalesce(F.array_size(lines) - F.array_size(changed), F.lit(0)).cast("long")
    columns = [
        F.when(changed.isNull(), text).otherwise(F.concat_ws("\n", changed)).alias(c)
        if c == text_col
        else F.col(f"`{c}`")
        for c in df.columns
        if c != dropped_col
    ]
    return out.select(*columns, *([cut.alias(dropped_col)] if dropped_col else []))
