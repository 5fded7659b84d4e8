"""Secret-like spans in texts, judged by how widely each value is owned. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: The kinds of span, in order of rank, as (pattern, group that is the value, least characters of it).
BASE_KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: What the ownership count alone can add: long runs of letters and digits that hold both cases and digits, or known issuers' tokens.
ADDED_KINDS: dict[str, tuple[str, int, int]] = {
    "issued": (r"((?<![A-Za-z0-9])(?:gh[pousr]_|xox[abprs]-|sk-|glpat-|AIza)[A-Za-z0-9_-]{16,})", 1, 20),
    "mixed": (r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,})", 1, 24),
}

#: Spans that are counted in one go.
RUN = 512


def _found(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of (start, end, rank, kind, value) of the leftmost matches that don't overlap; code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.coalesce(F.length(x["w"]), F.lit(0)).alias("size"), x["v"].alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["value"].isNotNull() & (F.length(x["value"]) >= least), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # an array that grows is copied with each span, so spans are counted within runs of RUN, and the runs' starts added afterwards
    run = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(RUN)), lambda i: F.aggregate(F.slice(steps, i, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    starts = F.aggregate(run, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    def moved(x: Column) -> Column:
        return F.transform(x["run"]["spans"], lambda s: F.struct((s["start"] + x["at"]).alias("start"), (s["end"] + x["at"]).alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["value"].alias("value")))

    return F.when(text.rlike(pattern), F.flatten(F.transform(F.arrays_zip(run.alias("run"), starts.alias("at")), moved))).otherwise(none)


def candidates(docs: DataFrame, text_col: str = "text") -> Column:
    """All spans of a text, in order of kind."""
    kinds = {**BASE_KINDS, **ADDED_KINDS}
    return F.concat(*[_found(F.col(text_col), k, p, g, n, i) for i, (k, (p, g, n)) in enumerate(kinds.items())])


def ownership(spans: DataFrame, owner: str, repository: str) -> DataFrame:
    """For each digest: ``owners`` and ``repositories`` that hold it, and its ``rows``, counted exactly.

    Rows first shrink to distinct (digest, owner, repository), so a value in a third of all documents
    reaches the last step as one row for each owner.
    """
    by_owner = spans.groupBy("digest", owner, repository).agg(F.count("*").alias("rows")).groupBy("digest", owner).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("rows").alias("rows"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", example_owners: int = 3, example_repositories: int = 50) -> DataFrame:
    """``id_col, spans`` for every row: an array of (start, end, rank, kind, value, owners, repositories, live).

    Base spans (``BASE_KINDS``) are always there. A value is taken for a widely copied example if
    ``example_owners`` or more distinct owners or ``example_repositories`` or more distinct repositories
    of whichever owners hold it anywhere in ``docs``, and else for one owner's
    credential (``live``). Spans of ``ADDED_KINDS`` are added only where their value is live and no base
    span covers them. Null texts are empty and null owners count as one owner; rows that repeat are
    scanned alike; rows without spans have an empty array. An empty table gives no rows.

    Texts are never shuffled: only spans are, keyed by digest, then by row.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository")
    ).withColumn("th", F.xxhash64("text"))
    # few rows beside the texts, so that these are searched once
    found = cut(rows.select("id", "th", "owner", "repository", F.explode(candidates(rows)).alias("span")).withColumn("digest", F.sha2("span.value", 256)))
    judged = join_hot(found, cut(ownership(found, "owner", "repository")), ["digest"], "rows").withColumn("live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))
    span = F.struct("span.start", "span.end", "span.rank", "span.kind", "span.value", "owners", "repositories", "live")
    base = len(BASE_KINDS)
    judged = judged.where((F.col("span.rank") < base) | F.col("live"))
    by_row = judged.groupBy("id", "th").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType))
    solid = F.filter(spans, lambda s: s["rank"] < base)
    kept = F.filter(spans, lambda s: (s["rank"] < base) | ~F.exists(solid, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = rows.select("id", "th").join(by_row.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    return out.select(F.col("id").alias(id_col), kept.alias("spans"))


def digest_of(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then rank, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
