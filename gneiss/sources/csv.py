"""CSV: S5, S6, C4-C9. Lines in, list columns out; types from a schema, or inferred in one aggregate pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.plans.features import SPARK_TYPES, FeatureSchema

UNKNOWN, INT, FLOAT, STRING = -1, 0, 1, 2
NAMES = {UNKNOWN: "UNKNOWN", INT: "INT", FLOAT: "FLOAT", STRING: "BYTES"}
IGNORE = "IGNORE"

# What Python's int() and float() read, which the inference follows: single underscores between digits, blanks around.
_BLANK = r"[\s\x1c-\x1f]*"
_INT = rf"^{_BLANK}[+-]?[0-9]+(_[0-9]+)*{_BLANK}$"
_DIGITS = r"[0-9]+(_[0-9]+)*"
_FLOAT = rf"(?i)^{_BLANK}[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|nan|inf|infinity){_BLANK}$"


def cells(line: Column | str, delimiter: str = ",") -> Column:
    """C4: the line's cells as a list of strings by RFC 4180, as many as it has; a blank line has none."""
    c = F.col(line) if isinstance(line, str) else line
    if len(delimiter) != 1 or delimiter == '"':
        raise ValueError("a delimiter is one character, and no quote")
    sep, other = f"\\Q{delimiter}\\E", f"[^\\Q{delimiter}\\E]"
    # with a delimiter put before the line, every cell begins with one; quoted parts may hold delimiters
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), c), F.lit(f'{sep}("[^"]*+(?:""[^"]*+)*+"{other}*+|{other}*+)'), F.lit(1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), '""', '"')
    quoted = F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), bare(x)).otherwise(x))
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).when(F.contains(c, F.lit('"')), quoted).otherwise(F.split(c, sep, -1))


def value_rank(c: Column) -> Column:
    """The type of one cell. Whole numbers outside 64 bits are text, not floating."""
    digits = F.regexp_replace(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f_+]", "")), "^(-?)0+(?=[0-9])", "$1")
    inside = (F.length(digits) <= 20) & F.coalesce(digits.try_cast("decimal(38,0)").between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")), F.lit(False))
    return (
        F.when(c.isNull() | (c == ""), UNKNOWN)
        .when(c.rlike(_INT), F.when(inside, INT).otherwise(STRING))
        .when(c.rlike(_FLOAT), FLOAT)
        .otherwise(STRING)
    )


def _number(c: Column, kind: str) -> Column:
    clean = F.regexp_replace(c, r"[\s\x1c-\x1f_]", "")
    if kind == "INT":
        return F.regexp_replace(clean, r"^\+", "").cast("bigint")
    low = F.lower(clean)
    special = F.when(low.rlike("^[+-]?nan$"), F.lit("NaN")).when(low.rlike("^-inf(inity)?$"), F.lit("-Infinity")).when(low.rlike(r"^\+?inf(inity)?$"), F.lit("Infinity"))
    return F.coalesce(special, clean).cast("float")


def _convert(c: Column, kind: str) -> Column:
    return F.encode(c, "UTF-8") if kind == "BYTES" else _number(c, kind)


def _converter(kind: str):
    return lambda x: _convert(x, kind)


@dataclass(frozen=True)
class CsvFormat:
    column_names: tuple[str, ...]
    delimiter: str = ","
    skip_blank_lines: bool = True
    multivalent: tuple[str, ...] = ()
    secondary: str | None = None

    def __post_init__(self):
        if self.multivalent and not self.secondary:
            raise ValueError("multivalent columns need a secondary delimiter")
        if set(self.multivalent) - set(self.column_names):
            raise ValueError("a multivalent column is not among the columns")


def _rows(lines: DataFrame, column: str, form: CsvFormat) -> DataFrame:
    """Lines with their cells `_c`; a width other than the columns' is an error, blank lines go or stay."""
    n = len(form.column_names)
    rows = lines.withColumn("_c", cells(column, form.delimiter))
    if form.skip_blank_lines:
        rows = rows.where(F.trim(F.col(column)) != "")
    wrong = (F.size("_c") != n) & (F.size("_c") > 0)
    return rows.withColumn("_c", F.when(wrong, F.raise_error(F.concat(F.lit(f"a line should have {n} cells: "), F.col(column))).cast("array<string>")).otherwise(F.col("_c")))


def _parts(form: CsvFormat, i: int) -> Column:
    c = F.get(F.col("_c"), i)
    return F.split(c, "\\Q" + form.secondary + "\\E", -1) if form.column_names[i] in form.multivalent else F.array(c)


def infer_types(lines: DataFrame, column: str, form: CsvFormat) -> dict[str, str]:
    """The type of each column: the largest of its cells' in UNKNOWN < INT < FLOAT < BYTES. One row comes back."""
    rows = _rows(lines, column, form)
    ranks = []
    for i, name in enumerate(form.column_names):
        c = F.get(F.col("_c"), i)
        rank = F.when(F.coalesce(c, F.lit("")) == "", UNKNOWN).otherwise(F.array_max(F.transform(_parts(form, i), value_rank))) if name in form.multivalent else value_rank(c)
        ranks.append(F.coalesce(F.max(rank), F.lit(UNKNOWN)).alias(name))
    row = rows.agg(*ranks).first()
    return {n: NAMES[row[n]] for n in form.column_names}


def types_from_schema(column_names: tuple[str, ...], schema: FeatureSchema) -> dict[str, str]:
    """Types of the schema's features; columns it doesn't have are ignored."""
    names = {f.name for f in schema.features}
    if names - set(column_names):
        raise ValueError(f"features are not among the columns: {', '.join(sorted(names - set(column_names)))}")
    out = {}
    for n in column_names:
        f = schema.feature(n)
        if f is not None and f.type not in SPARK_TYPES:
            raise ValueError(f"{n}: a CSV column can't be {f.type}")
        out[n] = f.type if f is not None else IGNORE
    return out


def spark_schema(column_names: tuple[str, ...], schema: FeatureSchema, raw_record: str | None = None) -> T.StructType:
    """The columns that decoding gives, in the order of column_names, the raw line last."""
    kinds = types_from_schema(column_names, schema)
    fields = [T.StructField(n, T.ArrayType(SPARK_TYPES[k])) for n, k in kinds.items() if k != IGNORE]
    if raw_record is not None:
        if raw_record in column_names:
            raise ValueError(f"{raw_record} is a column already")
        fields.append(T.StructField(raw_record, T.ArrayType(T.BinaryType())))
    return T.StructType(fields)


def decode(lines: DataFrame, column: str, form: CsvFormat, schema: FeatureSchema | None = None, raw_record: str | None = None, keep: list[str] = ()) -> DataFrame:
    """List columns of the lines' cells.

    An empty cell is null, another a list of one, a multivalent one a list of its parts (without a schema, parts of
    nothing but delimiters are empty texts, and null where the column has no type). Types come from the schema or
    from infer_types(), the first of two passes; only they come to the driver. Columns in keep pass through.
    """
    if raw_record is not None and raw_record in form.column_names:
        raise ValueError(f"{raw_record} is a column already")
    kinds = types_from_schema(form.column_names, schema) if schema is not None else infer_types(lines, column, form)
    out = [F.col(k) for k in keep]
    for i, (name, kind) in enumerate(kinds.items()):
        if kind == IGNORE:
            continue
        if kind == "UNKNOWN":
            out.append(F.lit(None).alias(name))
            continue
        c = F.get(F.col("_c"), i)
        values = F.transform(_parts(form, i), _converter(kind)) if name in form.multivalent else F.array(_convert(c, kind))
        out.append(F.when(F.coalesce(c, F.lit("")) != "", values).alias(name))
    if raw_record is not None:
        out.append(F.array(F.encode(F.col(column), "UTF-8")).alias(raw_record))
    return _rows(lines, column, form).select(*out)


def read(spark: SparkSession, paths: str | list[str], form: CsvFormat, schema: FeatureSchema | None = None, raw_record: str | None = None, skip_header_lines: int = 0) -> DataFrame:
    """The CSV files of some patterns; one physical line is one record.

    Header lines to skip are counted in each file's first split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("at least one pattern is needed")
    lines = spark.read.text(paths)
    if skip_header_lines:
        lines = _without_headers(spark, paths, skip_header_lines)
    return decode(lines, "value", form, schema, raw_record)


def _without_headers(spark: SparkSession, paths: list[str], n: int) -> DataFrame:
    """Lines of files but for the first n of each. A split knows its place in the file by the block's start offset.

    Only a file's first split has its lines counted, in runs of one file; batches of later splits pass as they are.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))

    def drop(batches):
        seen: dict = {}
        for b in batches:
            first = b.column(2).to_numpy() == 0
            if not first.any():
                yield b.select(["value"])
                continue
            files = b.column(1).dictionary_encode()
            keep = ~first
            for i, f in enumerate(files.dictionary.to_pylist()):
                at = np.flatnonzero(first & (files.indices.to_numpy() == i))
                keep[at[max(0, n - seen.get(f, 0)) :]] = True
                seen[f] = seen.get(f, 0) + len(at)
            yield b.select(["value"]).filter(pa.array(keep))

    return lines.mapInArrow(drop, "value string")
