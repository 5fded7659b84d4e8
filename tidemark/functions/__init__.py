"""Scalar functions of the engine as Column expressions: formats, escapes, checksums, typmods, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1970-01-01 to 2000-01-01, where the log's timestamps begin.
PG_EPOCH_MICROS = 946_684_800_000_000


def escape_literal(text: Column) -> Column:
    """Single quotes doubled, as inside an SQL literal; null stays null."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def quote_literal(text: Column) -> Column:
    """An SQL literal; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), escape_literal(text), F.lit("'")), F.lit("NULL"))


def trim_left(text: Column) -> Column:
    """Without leading spaces and tabs."""
    return F.ltrim(text, F.lit(" \t"))


def trim_right(text: Column) -> Column:
    """Without trailing spaces, tabs, carriage returns and line feeds."""
    return F.rtrim(text, F.lit(" \t\r\n"))


def fold_identifier(name: Column, most: int = 63) -> Column:
    """Lower-cased A-Z, and as many whole characters as fit in ``most`` bytes of UTF-8."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.substring(F.translate(name, upper, lower), 1, most)
    # 63 bytes hold between 15 and 63 characters: the longest of the few prefixes that fits
    sizes = F.filter(F.sequence(F.lit(0), F.length(text)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(sizes)))


def _two_places(numerator: Column, unit: int) -> Column:
    return F.format_string("%.2f", numerator.cast("double") / F.lit(float(unit)))


def lsn_lag(lag: Column) -> Column:
    """Bytes as GB, MB or KB with two decimals, or whole B below 1024."""
    return (
        F.when(lag >= 1 << 30, F.concat(_two_places(lag, 1 << 30), F.lit("GB")))
        .when(lag >= 1 << 20, F.concat(_two_places(lag, 1 << 20), F.lit("MB")))
        .when(lag >= 1 << 10, F.concat(_two_places(lag, 1 << 10), F.lit("KB")))
        .otherwise(F.concat(lag.cast("long").cast("string"), F.lit("B")))
    )


def time_lag(micros: Column) -> Column:
    """Microseconds as ``Xh Xm Xs``, ``Xm Xs`` or ``Xs Yus``."""

    def whole(unit: int) -> Column:
        # not by floating point, which has 53 bits
        return F.call_function("div", micros.cast("long"), F.lit(unit))

    h, m, s = whole(3_600_000_000), whole(60_000_000) % 60, whole(1_000_000) % 60
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s "), (micros % 1_000_000).cast("string"), F.lit("us")))
    )


def from_log_time(micros: Column) -> Column:
    """A log timestamp (microseconds since 2000-01-01) as ``YYYY-MM-DD HH:MM:SS.ffffff`` in the session's zone."""
    return F.date_format(F.timestamp_micros(micros + PG_EPOCH_MICROS), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def to_log_time(at: Column) -> Column:
    """Microseconds since 2000-01-01 of a timestamp."""
    return F.unix_micros(at.cast("timestamp")) - PG_EPOCH_MICROS


def format_lsn(lsn: Column) -> Column:
    """A 64-bit position as two hexadecimal halves, ``HI/LO``."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def parse_lsn(text: Column) -> Column:
    """The 64-bit position of ``HI/LO``; null for anything else."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    hi, lo = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return F.when(ok, F.shiftleft(F.conv(hi, 16, 10).cast("long"), 32) + F.conv(lo, 16, 10).cast("long"))


def row_hash(values: list[Column], missing: Column | None = None) -> Column:
    """MD5 of the non-null values side by side; null where a column is missing from the image.

    Values are told apart by their length, so that ('ab', 'c') and ('a', 'bc') differ.
    """
    texts = [F.when(v.isNotNull(), F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))).otherwise(F.lit("-")) for v in values]
    h = F.md5(F.concat(*texts))
    return h if missing is None else F.when(F.coalesce(F.size(missing), F.lit(0)) <= 0, h)


def crc32(text: Column) -> Column:
    return F.crc32(text)


def typmod(kind: Column, mod: Column) -> Column:
    """length, precision and scale that an attribute's type modifier stands for; null where it has none."""
    body = mod - 4
    sized, exact = kind.isin("varchar", "bpchar", "char"), kind == "numeric"
    timed = kind.isin("time", "timetz", "timestamp", "timestamptz", "interval")
    bits = kind.isin("bit", "varbit")
    given = mod >= 0
    return F.struct(
        F.when(given & sized, body).when(given & bits, mod).alias("length"),
        F.when(given & exact, F.shiftright(body, 16)).when(given & timed, mod).alias("precision"),
        F.when(given & exact, body.bitwiseAND(F.lit(0xFFFF))).alias("scale"),
    )


def shard_name(schema: Column, table: Column, total: Column, number: Column) -> Column:
    return F.concat_ws("_", schema, table, total.cast("string"), number.cast("string"))


def parse_shard_name(name: Column) -> Column:
    """schema (up to the first underscore), table, total and number of a shard's name."""
    pattern = r"^([^_]+)_(.+)_([0-9]+)_([0-9]+)$"
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("schema"),
        F.regexp_extract(name, pattern, 2).alias("table"),
        F.regexp_extract(name, pattern, 3).try_cast("long").alias("total"),
        F.regexp_extract(name, pattern, 4).try_cast("long").alias("number"),
    )


def refresh_uuid(name: Column) -> Column:
    """A stable id in UUID form for a refresh's name."""
    h = F.md5(name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def value_text(value: Column, kind: str) -> Column:
    """A value's text as the log writes it: booleans as t and f, bytes as ``\\x`` and hex, times in ISO form."""
    if kind == "boolean":
        return F.when(value, "t").when(~value, "f")
    if kind == "binary":
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def text_value(text: Column, kind: str) -> Column:
    """The value of a log text; null where the text isn't one of the type."""
    if kind == "boolean":
        return F.when(text == "t", True).when(text == "f", False)
    if kind == "binary":
        return F.unhex(F.substring(text, 3, 1 << 30))
    return text.try_cast(kind)


#: How the log's types are held here.
SPARK_TYPES = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "money": "decimal(19,2)",
    "text": "string", "varchar": "string", "bpchar": "string", "bool": "boolean", "bytea": "binary", "date": "date",
    "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "oid": "bigint", "pg_lsn": "bigint", "uuid": "string",
    "json": "string", "jsonb": "string", "xml": "string", "inet": "string", "cidr": "string", "time": "string", "timetz": "string",
    "point": "string", "line": "string", "lseg": "string", "box": "string", "path": "string", "polygon": "string", "circle": "string",
    "bit": "string", "varbit": "string", "tsvector": "string", "tsquery": "string", "macaddr": "string", "macaddr8": "string",
}


def spark_type(kind: str, mod: int = -1) -> str:
    """The Spark type that holds a log type; numeric beyond 38 digits, or without a bound, stays text."""
    if kind.startswith("_"):
        return f"array<{spark_type(kind[1:], mod)}>"
    if kind == "numeric":
        precision, scale = ((mod - 4) >> 16, (mod - 4) & 0xFFFF) if mod >= 0 else (99, 0)
        return f"decimal({precision},{scale})" if precision <= 38 else "string"
    return SPARK_TYPES.get(kind, "string")
