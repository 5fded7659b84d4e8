"""Lines that recur across documents, found as templates of a fixed-depth tree. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, row_keys

#: What stands for a variable field.
FIELD = "<*>"
#: A word that holds a digit, an @ or ://, among words with one space between them.
_VARIABLE = r"(?<![^ ])(?=[^ 0-9@:]*+(?:[0-9@]|://|:[^ ]*[0-9@]))[^ ]+"
#: The white space inside a line but for the space.
_ODD = "\t\x0b\x0c\r"
#: Distinct lines of full leaves whose places are sent to all tasks (40 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Columns that stand for a document and its near copies.
CLASSES = ["c0", "c1", "c2", "c3"]


def _once(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """``rows`` with a column that is computed once, however often later expressions name it."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def normal(rows: DataFrame) -> DataFrame:
    """``line``: the column ``raw`` with one space between its words and variable-looking words generalised to a field.

    It is empty for a line without a word.
    """
    odd = reduce(Column.__or__, [F.col("raw").contains(c) for c in ("  ", *_ODD)])
    rows = _once(rows, F.trim(F.when(odd, F.regexp_replace("raw", r"[\x20\t\x0b\x0c\r]+", " ")).otherwise(F.col("raw"))), "line").drop("raw").withColumnRenamed("line", "raw")
    varies = F.col("raw").rlike("[0-9@:]")
    return _once(rows, F.when(varies, F.regexp_replace("raw", _VARIABLE, FIELD)).otherwise(F.col("raw")), "line").drop("raw")


def _lines(docs: DataFrame, id_col: str, text_col: str, lead: int) -> DataFrame:
    """``id, th, no, n, leaf, h`` of every line with a word: its place in the tree is the token count, then the leading tokens."""
    rows = row_keys(docs, id_col, text_col).select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    rows = normal(rows).where("line <> ''")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.select("id", "th", "no", F.xxhash64("line").alias("h"), F.substring_index("line", " ", lead).alias("first"), n.alias("n")).select("id", "th", "no", "n", F.xxhash64("n", "first").alias("leaf"), "h")


def leaf_templates(docs: DataFrame, base: DataFrame, by_line: DataFrame, id_col: str, text_col: str, lead: int, least: int) -> DataFrame:
    """``leaf, h, t``: templates ``t`` of the lines (of hash ``h``) that share a leaf with others.

    At a leaf (token count and leading tokens) of ``least`` lines or more, a position's token is part of
    the template if it is in over 3 of 4 of the leaf's lines or, for further templates, in over half or in ``least`` of
    them; any other position is a variable field, wherever it stands, so a leaf may hold several templates. Lines with the same fixed
    tokens share one, if these are more than the leading ones, 3 of 5 tokens or more, and not all. Only the distinct
    lines of such leaves are split into words, each taken from one document, and count as often as they stand anywhere.
    """
    long = by_line.where(F.col("n") > lead)
    full = long.groupBy("leaf").agg(F.sum("rows").alias("lines"), F.count("*").alias("kinds"), F.count("*").alias("weight")).where((F.col("lines") >= least) & (F.col("kinds") > 1))
    mixed = cut(join_hot(long, cut(full.drop("kinds")), ["leaf"], "weight").select("leaf", "h", "n", "rows", "lines"))
    place = F.min(F.struct("id", "th", "no")).alias("p")
    places = join_hot(base.select("id", "th", "no", "leaf", "h"), mixed.select("leaf", "h", "rows"), ["leaf", "h"], "rows").groupBy("leaf", "h").agg(place)
    places = cut(places.select("leaf", "h", "p.id", "p.th", "p.no"))
    there = F.broadcast(places) if places.count() <= BROADCAST_LINES else places
    raws = row_keys(docs, id_col, text_col).join(there, ["id", "th"]).select("leaf", "h", F.get(F.split("text", "\n", -1), F.col("no")).alias("raw"))
    words = normal(raws).select("leaf", "h", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words")).dropDuplicates(["leaf", "h"])
    words = cut(words.join(mixed, ["leaf", "h"]).select("leaf", "h", "n", "rows", "lines", F.posexplode("words").alias("at", "word")))
    counts = cut(words.groupBy("leaf", "at", "word").agg(F.sum("rows").alias("held"), F.count("*").alias("weight")).where(F.col("held") >= 2))
    both = join_hot(words, counts, ["leaf", "at", "word"], "weight").withColumn("token", F.xxhash64("at", "word"))
    rules = (4 * F.col("held") > 3 * F.col("lines"), 2 * F.col("held") > F.col("lines"), F.col("held") >= least)
    # the fixed tokens of a template, in any order
    fixed = F.array(*[F.struct(F.count_if(rule).alias("k"), F.bit_xor(F.when(rule, F.col("token"))).alias("x")) for rule in rules])
    found = both.groupBy("leaf", "h", "n").agg(fixed.alias("f")).select("leaf", "h", "n", F.inline("f"))
    return found.where((F.col("k") > lead) & (5 * F.col("k") >= 3 * F.col("n")) & (F.col("k") < F.col("n"))).select("leaf", "h", F.xxhash64(F.lit(3), "leaf", "k", "x").alias("t")).distinct()


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 8, long_docs: int = 5, lead: int = 2, least_words: int = 12) -> DataFrame:
    """``id, th, drop``: for each document the numbers (from 0) of its lines that are to go.

    A template is boilerplate if lines of ``min_docs`` unrelated texts or more have it (``long_docs`` for lines of
    ``least_words`` tokens or more). Texts are told apart by CLASSES: the least and the largest of two hashes over
    their lines. Whole copies have equal digests, and near copies have mostly, as few of their lines differ; in
    unrelated texts that share a block of lines a digest is equal only if it is the hash of a line of that block. So
    the digest with the most values counts the texts, and it must have 2 values for each 5 texts that differ in any
    digest: fewer is what near copies show. Lines of a text that was copied as a whole stay, and copies are for
    near-duplicate removal. The document with the least id keeps the template's lines, all others lose them.
    """
    doc = ["id", "th"]
    # the one pass over all words: what follows reads hashes, and the words of few lines
    base = cut(_lines(docs, id_col, text_col, lead))
    by_line = cut(base.groupBy("leaf", "h", "n").agg(F.count("*").alias("rows")))
    enough = F.when(F.col("n") >= least_words, long_docs).otherwise(min_docs)
    # a line is its own template, and has up to three of its leaf
    own = by_line.where(F.col("rows") >= enough).select("leaf", "h", F.col("h").alias("t"))
    learnt = leaf_templates(docs, base, by_line, id_col, text_col, lead, min(min_docs, long_docs))
    of_line = own.union(learnt).groupBy("leaf", "h").agg(F.collect_set("t").alias("ts"))
    of_line = cut(of_line.join(by_line.select("leaf", "h", "rows"), ["leaf", "h"]))
    hit = cut(join_hot(base, of_line, ["leaf", "h"], "rows").select(*doc, "no", "n", F.explode("ts").alias("t")))
    of_doc = cut(hit.groupBy("t", "n", *doc).agg(F.count("*").alias("rows")))
    found = of_doc.groupBy("t", "n").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.min(F.struct(*doc)).alias("first"))
    found = cut(found.where(F.col("docs") >= enough))
    h2 = F.xxhash64("h")
    classes = base.groupBy(*doc).agg(*[f(e).alias(c) for c, (f, e) in zip(CLASSES, ((F.min, "h"), (F.max, "h"), (F.min, h2), (F.max, h2)), strict=True)])
    seen = join_hot(of_doc.drop("rows"), found.select("t", "n", "docs"), ["t", "n"], "docs", "left_semi").join(classes, doc)
    kinds = seen.groupBy("t", "n", *CLASSES).agg(F.lit(1).alias("one")).groupBy("t", "n").agg(F.count("*").alias("kinds"), *[F.count_distinct(c).alias(f"n_{c}") for c in CLASSES])
    texts = F.greatest(*[F.col(f"n_{c}") for c in CLASSES])
    going = cut(kinds.where((texts >= enough) & (5 * texts >= 2 * F.col("kinds"))).select("t", "n").join(found.select("t", "n", "rows", "first"), ["t", "n"]))
    gone = join_hot(hit, going, ["t", "n"], "rows").where((F.col("id") != F.col("first.id")) | (F.col("th") != F.col("first.th")))
    return gone.groupBy(*doc).agg(F.collect_set("no").alias("drop"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``; recurring template lines are gone from ``text_col``.

    Adds nothing: a document that loses every line keeps its row with an empty text. Null text stays
    null, and rows with a null id stay as they are and don't count. Rows that repeat an id with another text are
    documents of their own; equal rows are one. Lines are what stands between ``\\n``; those without a word (a run of
    characters other than space and 0x09-0x0D) are never templates and stay. An empty table gives
    no rows. ``options`` are those of ``recurring``.
    """
    out = _without(docs, recurring(docs, id_col, text_col, **options), id_col, text_col)
    return out.withColumn(text_col, F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.col("__kept"))).select(docs.columns)


def _without(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __drop, and __lines and __kept where something goes."""
    drop = drop.withColumnsRenamed({"id": "__id", "th": "__th", "drop": "__drop"})
    out = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.join(drop, (F.col(id_col) == F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    lines = F.when(F.col("__drop").isNotNull() & F.col(text_col).isNotNull(), F.split(text_col, "\n", -1))
    out = out.select("*", F.explode(F.array(lines)).alias("__lines"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    return out.withColumn("__kept", F.array_join(F.transform(numbers, lambda i: F.get(F.col("__lines"), i)), "\n"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_lines, n_dropped, kept`` of every row: its lines with a word, those that go, and the text that stays (null text: empty)."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    out = _without(rows, recurring(docs, id_col, text_col, **options), id_col, text_col)
    full = F.size(F.filter(F.split(text_col, "\n", -1), lambda x: F.btrim(x, F.lit(" " + _ODD)) != ""))
    return out.select(
        id_col,
        full.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.col("__kept")).alias("kept"),
    )
