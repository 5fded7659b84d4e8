"""URL rules found by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Hex digits of a digest that the join compares; the whole digest is compared afterwards.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://`` or url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), rest.substr(F.length(host) + 1, F.length(rest))


def expressions(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """``host suffix + path prefix`` for each number of labels and each length of path that rules have."""
    parts = F.filter(labels, lambda n: n <= F.size(F.split(host, r"\.")))
    # a suffix of all labels is the host, and one of fewer is cut from its end
    suffixes = F.transform(parts, lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    ends = F.filter(lengths, lambda n: n <= F.length(path))
    prefixes = F.transform(ends, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to every row of ``pages``.

    rules: ``host, path, verdict``; a rule fits its host and all subdomains if the url's path starts
    with the rule's path. Of several that fit, the longest (host and path together) wins, then the
    one with the longer host, then ``allow``. Without a rule ``rule`` is null and ``verdict`` is
    ``default``. Rules with a null host or path are ignored; repeated rules count once. A null url has
    empty host and path and fits no rule. Columns of ``pages`` named like the four are replaced.

    Distinct hosts and paths are expanded once each (no further than the rules' sizes, so a long host costs no more), joined to the rules on a short prefix of the
    expression's SHA-256, and confirmed on the whole digest. Only pairs with a rule are shuffled, as
    (host, path, rule) before the rows of ``pages`` look theirs up.
    """
    names = {"host", "path", "rule", "verdict"}
    rest = [c for c in pages.columns if c not in names]
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumns({"__host": host, "__path": path})
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\u0001", "r_host", "r_path"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    sizes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"))
    # the only row of `sizes` goes to every task: as many numbers as rules' hosts and paths have sizes
    urls = rows.groupBy("__host", "__path").agg(F.count("*").alias("weight")).join(F.broadcast(sizes))
    parts = urls.select("__host", "__path", "weight", F.explode(expressions(F.col("__host"), F.col("__path"), F.col("labels"), F.col("lengths"))).alias("e"))
    parts = parts.withColumn("e_digest", F.sha2(F.concat_ws("\u0001", "e.host", "e.path"), 256)).withColumn("prefix", F.substring("e_digest", 1, PREFIX_DIGITS))
    hits = parts.join(rules, "prefix").where((F.col("e_digest") == F.col("digest")) & (F.col("e.host") == F.col("r_host")) & (F.col("e.path") == F.col("r_path")))
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "allow").cast("int").alias("allows"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = cut(hits.groupBy("__host", "__path").agg(F.max(order).alias("best"), F.max("weight").alias("weight")))
    # host and path are never null
    out = join_hot(rows, best, ["__host", "__path"], "weight", "left")
    return out.select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
