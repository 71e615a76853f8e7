"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in each text. A candidate's value is hashed and
the hashes are counted over the corpus: in how many repositories and at how many
owners each one stands. A value that many owners share, or that stands in many
repositories even of one owner, is a documentation example or a copied sample;
one that stays with few and looks random is treated as a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import bounded, materialize

#: Fixed values of the base kinds, in the order in which spans are listed:
#: pattern, group that holds the value, least length of that value.
BASE_KINDS = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    # Runs are matched whole, so that a least length in the pattern changes no span that stays.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Shapes that the method adds when a value is owner-specific and looks random.
ADDED_KINDS = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("vendor", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 1),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})", 1, 20),
)
#: Where a key block starts at a pem header: all up to its END line or, where that is
#: missing, the header with its fields and the base64 lines that follow. Possessive, lest
#: a long block be read by recursion. The kind's own pattern is the header only.
_PEM_EDGE = r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----"
_PEM_BREAK = r"(?:\s|\\[nr])"
_PEM_BLOCK = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_PEM_BREAK}*+[A-Za-z][A-Za-z0-9-]{{0,40}}: [^\n\\]*+)*+"
    rf"(?:{_PEM_BREAK}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_PEM_BREAK}++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|\z))?"
    r"|)"
)
#: Cheap tests that must hold before a kind's pattern is applied to a text.
_NEEDS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "pem": r"-----BEGIN ",
    "jwt": r"eyJ[A-Za-z0-9_-]{8}",
    "vendor": r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)",
    "bearer": r"(?i:bearer)\x20",
}
#: From so many owners on, or so many repositories, a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: Distinct characters that a live-looking value has at least.
LIVE_CHARS = 8

_SPAN = "struct<kind:string,rank:int,start:long,`end`:long,value:string>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a kind, offsets in code points, failing matches left out.

    The pieces between matches and the matches themselves alternate, so running
    sums of their lengths give the offsets.
    """
    if kind == "pem":
        pattern = _PEM_BLOCK
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.transform(found, _pem_value) if kind == "pem" else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(found)).alias("gap"),
        found.alias("hit"),
        values.alias("value"),
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            F.lit(rank).alias("rank"),
            start.cast("long").alias("start"),
            end.cast("long").alias("end"),
            x["value"].alias("value"),
        )
        ok = F.length(x["value"]) >= least
        return F.struct(
            end.cast("long").alias("at"),
            F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(
        text.rlike(_NEEDS[kind]), F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    ).otherwise(none)


def _pem_value(block: Column) -> Column:
    """What lies between a block's edges, however its lines are broken; of a header alone the header."""
    body = F.regexp_replace(F.regexp_replace(block, _PEM_EDGE, ""), _PEM_BREAK, "")
    return F.when(body != "", body).otherwise(F.regexp_extract(block, _PEM_EDGE, 0))


def secret_candidates(text: Column) -> Column:
    """All candidate spans of a text, base and added kinds, by start and then kind."""
    kinds = [*BASE_KINDS, *ADDED_KINDS]
    spans = F.concat(*(_spans(text, i, *k) for i, k in enumerate(kinds)))
    by_place = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    return F.array_sort(by_place)


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """One row per input row with its candidate spans and their corpus-wide verdicts.

    Returns id, spans: array<struct<kind, start, end, value_sha256, owners,
    repositories, verdict, base>>. verdict is "example" (at least example_owners
    owners or example_repositories repositories), "live" (fewer, random-looking) or "weak". Base kinds are
    always reported; added kinds only when live.

    repository_col defaults to id_col: every row is its own repository. Null text
    counts as empty; null owners are one owner, null repositories one repository;
    repeated rows with the same repository count once; an empty table gives an
    empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(
        df.select(
            F.col(id_col).alias("id"),
            F.col(owner_col).cast("string").alias("owner"),
            F.col(repository_col or id_col).cast("string").alias("repository"),
            F.monotonically_increasing_id().alias("row"),
            F.transform(
                secret_candidates(text),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["rank"].alias("rank"),
                    s["end"].alias("end"),
                    s["kind"].alias("kind"),
                    F.sha2(s["value"], 256).alias("sha"),
                    (F.array_size(F.array_distinct(F.split(s["value"], ""))) >= LIVE_CHARS).alias("random"),
                ),
            ).alias("found"),
        ),
        "secret-candidates",
    )
    each = rows.where(F.size("found") > 0).select(
        "row", "owner", "repository", F.explode("found").alias("s")
    )
    # Three combining steps; the first collapses repeats, so no distinct state grows.
    freq = materialize(
        each.select(F.col("s.sha").alias("sha"), "owner", "repository")
        .groupBy("sha", "owner", "repository")
        .agg(F.count("*").alias("n"))
        .groupBy("sha", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("sha")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")),
        "secret-owners",
    )
    base = len(BASE_KINDS)
    judged = (
        each.withColumn("sha", F.col("s.sha"))
        .join(bounded(freq), "sha")
        .withColumn(
            "verdict",
            F.when((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories), "example")
            .when(F.col("s.random"), "live")
            .otherwise("weak"),
        )
        .where((F.col("s.rank") < base) | (F.col("verdict") == "live"))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("s.start", "s.rank", "s.end", "s.kind", "sha", "owners", "repositories", "verdict")
                )
            ).alias("spans")
        )
    )
    shape = "array<struct<kind:string,start:long,`end`:long,value_sha256:string,owners:long,repositories:long,verdict:string,base:boolean>>"
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["sha"].alias("value_sha256"),
            s["owners"].alias("owners"),
            s["repositories"].alias("repositories"),
            s["verdict"].alias("verdict"),
            (s["rank"] < base).alias("base"),
        ),
    )
    return (
        rows.select("id", "row")
        .join(judged, "row", "left")
        .select(F.col("id").alias(id_col), F.coalesce(spans, F.array().cast(shape)).alias("spans"))
    )
