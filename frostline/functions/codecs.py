"""Column expressions between native text, archive types and comparable values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType

from frostline.plans.model import Column as Native

# Native types and the archive types that hold them.
ARCHIVE_TYPES = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "bool": "boolean",
    "text": "string", "varchar": "string", "bpchar": "string", "numeric": "string", "date": "string", "timestamp": "string",
    "timestamptz": "string", "uuid": "string", "json": "string", "jsonb": "string",
}
TRUE_TEXTS, FALSE_TEXTS = ("t", "true"), ("f", "false")
KEY_BIAS = 1 << 63


def parse_bool(col: Column) -> Column:
    """t, true, f, false; null stays null; other text fails the job."""
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), col)).cast("boolean")
    return F.when(col.isNull(), F.lit(None).cast("boolean")).when(col.isin(*TRUE_TEXTS), True).when(col.isin(*FALSE_TEXTS), False).otherwise(bad)


def hex_encode(col: Column, upper: bool = False) -> Column:
    """Hex of a string's UTF-8 or of binary."""
    h = F.hex(col.cast("binary"))
    return h if upper else F.lower(h)


def is_hex(col: Column) -> Column:
    return col.rlike("^([0-9A-Fa-f]{2})*$")


def hex_decode(col: Column) -> Column:
    """Binary; an odd length or another character fails the job."""
    return F.when(is_hex(col), F.unhex(col)).when(col.isNotNull(), F.raise_error(F.lit("not hex")).cast("binary"))


def temporal_text(col: Column, kind: str) -> Column:
    """A date as yyyy-MM-dd, another time as yyyy-MM-dd HH:mm:ss.SSSSSS."""
    return F.date_format(col, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss.SSSSSS")


def duration_text(micros: Column) -> Column:
    """A signed duration as [-]HH:mm:ss.SSSSSS; hours may be over 24."""
    n = F.abs(micros)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(n / 3_600_000_000)
    hours = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    clock = F.concat_ws(":", hours, two(F.floor(n / 60_000_000) % 60), two(F.floor(n / 1_000_000) % 60))
    return F.when(micros.isNotNull(), F.concat(F.when(micros < 0, "-").otherwise(""), clock, F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0")))


def zero_dates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(rule, entity, detail) for each row with a date text that has a zero month or day: no archive type holds it."""
    bad = F.array_compact(F.array(*(F.when(F.col(c).rlike(r"^\d{4}-(00-\d\d|\d\d-00)"), F.lit(c)) for c in columns)))
    return df.select(F.lit("zero_date").alias("rule"), F.col(key).cast("string").alias("entity"), F.array_join(bad, ",").alias("detail")).where("detail <> ''")


def key_token(col: Column) -> Column:
    """The signed long in whose order unsigned 64-bit keys, given as decimal(20,0), stand."""
    return (col.cast("decimal(20,0)") - F.lit(str(KEY_BIAS)).cast("decimal(20,0)")).cast("bigint")


def key_from_token(col: Column) -> Column:
    return (col.cast("decimal(20,0)") + F.lit(str(KEY_BIAS)).cast("decimal(20,0)")).cast("decimal(20,0)")


def canonical_unsigned(text: Column) -> Column:
    """Whether text is an unsigned 64-bit number written as such: no sign, no leading zero, not over the limit."""
    shape = text.rlike("^(0|[1-9][0-9]{0,19})$")
    return shape & F.coalesce(text.try_cast("decimal(20,0)") <= F.lit(str(2 * KEY_BIAS - 1)).cast("decimal(20,0)"), F.lit(False))


def to_archive_types(df: DataFrame, columns: list[Native]) -> DataFrame:
    """The columns of df, given as native text, in their archive types; a value that is none of its type fails the job.

    A type that is not in ARCHIVE_TYPES refuses the table. The native type and nullability go into the field's metadata, which Parquet keeps.
    """
    refused = [c.name for c in columns if c.native_type not in ARCHIVE_TYPES]
    if refused:
        raise ValueError(f"no archive type for {', '.join(refused)}")
    as_type = lambda c: parse_bool(F.col(c.name)) if c.native_type == "bool" else F.col(c.name).cast(ARCHIVE_TYPES[c.native_type])
    return df.select(*(as_type(c).alias(c.name, metadata={"native_type": c.native_type, "nullable": c.nullable}) for c in columns))


def type_violations(df: DataFrame, columns: list[Native]) -> DataFrame:
    """(rule, entity, detail) with the number of values of each column that are not of its native type."""
    ok = {
        c.name: F.col(c.name).isin(*TRUE_TEXTS, *FALSE_TEXTS) if c.native_type == "bool" else F.col(c.name).try_cast(ARCHIVE_TYPES[c.native_type]).isNotNull()
        for c in columns
    }
    counted = df.agg(*(F.count_if(F.col(n).isNotNull() & ~x).alias(n) for n, x in ok.items()))
    each = counted.select(F.explode(F.array(*(F.struct(F.lit("type").alias("rule"), F.lit(n).alias("entity"), F.col(n).alias("detail")) for n in ok))).alias("v"))
    return each.select("v.*").where("detail > 0")


def to_text_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns or df.columns))


def envelope(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, body): a document's key and the hex of its bytes."""
    return df.select(F.col(key).alias("key"), hex_encode(F.col(raw)).alias("body"))


def unenvelope(df: DataFrame) -> DataFrame:
    """The exact inverse: (key, raw)."""
    return df.select("key", F.decode(hex_decode(F.col("body")), "UTF-8").alias("raw"))


def exact_equal(a: Column, b: Column, floating: bool = False) -> Column:
    """Equal without any rounding: null only equals null, NaN equals NaN, and -0.0 differs from 0.0."""
    return a.cast("string").eqNullSafe(b.cast("string")) if floating else a.eqNullSafe(b)


def rows_equal(left: DataFrame, a: str, b: str, columns: list[str]) -> Column:
    """Whether structs a and b of left agree on every column, by exact_equal."""
    kinds = left.schema[a].dataType
    out = F.lit(True)
    for c in columns:
        out = out & exact_equal(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"), isinstance(kinds[c].dataType, (FloatType, DoubleType)))
    return out


def non_finite(df: DataFrame, key: str) -> DataFrame:
    """(rule, entity, detail) for each row with a NaN or infinite value, which a serving copy can't hold."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))]
    bad = lambda c: F.isnan(c) | F.abs(F.col(c)).eqNullSafe(F.lit(float("inf")))
    hits = F.filter(F.array(*(F.when(bad(c), F.lit(c)) for c in floats)), lambda x: x.isNotNull())
    return df.select(F.lit("non_finite").alias("rule"), F.col(key).cast("string").alias("entity"), F.array_join(hits, ",").alias("detail")).where("detail <> ''")


def native_value(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON for comparison with a serving copy: integers, booleans and finite floats as such, all else as text; NaN and infinity fail the job."""
    kinds = {f.name: f.dataType for f in df.schema}

    def value(c: str) -> Column:
        if isinstance(kinds[c], (FloatType, DoubleType)):
            finite = ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
            return F.when(F.col(c).isNull() | finite, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast(kinds[c]))
        return F.col(c) if isinstance(kinds[c], (IntegralType, BooleanType)) else F.col(c).cast("string")

    return F.to_json(F.struct(*(value(c).alias(c) for c in columns)), {"ignoreNullFields": "false"})


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns' canonical text; a null differs from an empty text."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def schema_signature(columns: DataFrame) -> DataFrame:
    """(schema, table, signature) of (schema, table, position, name, type, nullable) rows: SHA-256 over the ordered columns."""
    each = F.concat_ws(":", "name", "type", F.when(F.col("nullable"), "null").otherwise("not null"))
    ordered = F.array_sort(F.collect_list(F.struct("position", each.alias("c"))))
    return columns.groupBy("schema", "table").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["c"]), "\n"), 256).alias("signature"))
