"""Quality gates on vocalised text against its raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keys import LETTERS_TATWEEL, MARKS, strip_marks, words
from corpusloom.operators.stats import first_reason

FATHATAN = "ً"


def skeleton_gate(out: Column, raw: Column) -> Column:
    """Both texts have the same letters, signs and spaces."""
    return strip_marks(out) == strip_marks(raw)


def taa_gate(out: Column) -> Column:
    """No ة carries a vowel, tanween or shadda; sukun is allowed."""
    return ~out.rlike("ة[ً-ّ]")


def tanween_gate(out: Column, closed: list[str]) -> Column:
    """Tanween only as fathatan on listed skeletons, with or without a leading و or ف; the other two never."""
    listed = F.array(*(F.lit(w) for w in closed)) if closed else F.array().cast("array<string>")

    def ok(w: Column) -> Column:
        skel = F.regexp_replace(strip_marks(w), f"[^{LETTERS_TATWEEL}]", "")
        tail = F.when(skel.rlike("^[وف]") & (F.length(skel) > 3), F.substring(skel, 2, 1 << 30))
        return F.array_contains(listed, skel) | F.coalesce(F.array_contains(listed, tail), F.lit(False))

    marked = F.filter(words(out), lambda w: w.contains(FATHATAN))
    return ~out.rlike("[ٌٍ]") & F.forall(marked, ok)


def measured(out: Column, raw: Column, closed: list[str], least: float = 1.2) -> Column:
    """The four gates as they are reported: each as a boolean, with the marks for each word.

    Stricter than the gates of a run: a ة at the end of a word carries no mark at all,
    and a text is dense enough from `least` marks a word on.
    """
    arabic = F.size(F.filter(words(out), lambda w: w.rlike("[ء-ي]")))
    marks = F.regexp_count(out, F.lit(f"[{MARKS}]"))
    density = F.round(F.when(arabic > 0, marks / arabic).otherwise(0.0), 2)
    return F.struct(
        skeleton_gate(out, raw).alias("skeleton"),
        tanween_gate(out, closed).alias("tanween"),
        (~out.rlike(r"ة[ً-ْ]+(?:\s|$)")).alias("taa"),
        (density >= least).alias("dense"),
        density.alias("density"),
    )


def before_and_after(df: DataFrame, raw: str, before: str, after: str, closed: list[str]) -> DataFrame:
    """How many texts pass each gate before and after a layer: one row a gate."""
    names = ("skeleton", "tanween", "taa", "dense")
    rows = df.select(*(measured(F.col(c), F.col(raw), closed).alias(k) for k, c in (("b", before), ("a", after))))
    sums = rows.agg(F.count("*").alias("units"), *(F.count_if(F.col(f"{k}.{g}")).alias(f"{k}_{g}") for k in "ba" for g in names)).select(
        F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), "units", F.col(f"b_{g}").alias("before"), F.col(f"a_{g}").alias("after")) for g in names))).alias("g")
    )
    return sums.select("g.*")


def density_gate(out: Column) -> Column:
    """At least five marks and 1.2 marks for each word with an Arabic letter."""
    arabic = F.size(F.filter(words(out), lambda w: w.rlike("[ء-ي]")))
    need = F.greatest(F.lit(5), F.ceil(arabic * F.lit(12) / 10))
    return F.regexp_count(out, F.lit(f"[{MARKS}]")) >= need


def failed_gate(out: Column, raw: Column, closed: list[str]) -> Column:
    """The first gate that fails, in the order skeleton, tanween, taa, density; null if all hold."""
    return first_reason(
        [
            ("skeleton", ~skeleton_gate(out, raw)),
            ("tanween", ~tanween_gate(out, closed)),
            ("taa", ~taa_gate(out)),
            ("density", ~density_gate(out)),
        ]
    )
