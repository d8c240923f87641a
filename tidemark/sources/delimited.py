"""LOAD DATA INFILE and SELECT ... INTO OUTFILE over any path that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dialect's escapes of single characters.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def load_data(spark: SparkSession, path: str, schema: str, sep: str = "\t", quote: str = "", escape: str = "\\", line_end: str | None = None, line_start: str = "", skip: int = 0, encoding: str = "UTF-8", set_: dict[str, Column] | None = None, null: str = "\\N") -> DataFrame:
    """Read delimited text with a declared schema: separators, optional quotes, a line prefix, skipped lines, SET columns.

    One skipped line is the reader's header option; more are dropped by their line numbers, which takes one pass for
    the sizes of the partitions. A column named like @x in MySQL is declared in the schema and dropped by the caller.
    """
    options = {"sep": sep, "escape": escape, "nullValue": null, "encoding": encoding, "quote": quote or "", "mode": "PERMISSIVE"}
    if line_end:
        options["lineSep"] = line_end
    if not quote and not line_start and not skip and len(sep) == 1 and escape == "\\" and null == "\\N" and encoding == "UTF-8":
        df = _escaped_lines(spark, path, schema, sep, line_end or "\n")
    elif skip <= 1 and not line_start:
        df = spark.read.schema(schema).options(header=str(skip == 1).lower(), enforceSchema="true", **options).csv(path)
    else:
        text = spark.read.option("encoding", encoding)
        lines = (text.option("lineSep", line_end) if line_end else text).text(path)
        if skip:
            lines = lines.rdd.zipWithIndex().filter(lambda x: x[1] >= skip).map(lambda x: x[0]).toDF("value string")
        if line_start:
            at = F.instr("value", line_start)
            lines = lines.filter(at > 0).select(F.substr("value", at + len(line_start)).alias("value"))
        struct = F.from_csv("value", schema, {k: v for k, v in options.items() if k not in ("encoding", "lineSep")})
        df = lines.select(struct.alias("r")).select("r.*")
    return df.withColumns(set_) if set_ else df


def _escaped_lines(spark: SparkSession, path: str, schema: str, sep: str, line_end: str) -> DataFrame:
    """Lines whose line ends, separators and backslashes are escaped by a backslash; \\N alone is NULL, an empty field is ''.

    A row is a line: a line feed within a field is written as backslash and n. Missing fields are NULL, fields beyond the
    schema are dropped.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    rows = spark.read.option("lineSep", line_end).text(path)
    s = re.escape(sep)
    parts = F.regexp_extract_all("value", F.lit(rf"(?:^|{s})((?:\\.|[^\\{s}])*)"), 1)
    split = rows.select(parts.alias("p"))
    return split.select(*(F.when(F.get("p", F.lit(k)) != "\\N", _unescaped(F.get("p", F.lit(k)))).cast(f.dataType).alias(f.name) for k, f in enumerate(fields)))


def _unescaped(field: Column) -> Column:
    """The dialect's escapes: \\n, \\t, \\r, \\0, \\b, \\Z; any other character stands for itself."""
    held = F.replace(field, F.lit("\\\\"), F.lit("\ufdd0"))  # a noncharacter marks a backslash of its own
    for code, char in ESCAPES.items():
        held = F.replace(held, F.lit("\\" + code), F.lit(char))
    return F.replace(F.regexp_replace(held, r"\\(.)", "$1"), F.lit("\ufdd0"), F.lit("\\"))


def _escaped(field: Column, sep: str) -> Column:
    held = F.replace(field.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for code, char in ESCAPES.items():
        if char != sep:
            held = F.replace(held, F.lit(char), F.lit("\\" + code))
    return F.coalesce(F.replace(held, F.lit(sep), F.lit("\\" + sep)), F.lit("\\N"))


def into_outfile(df: DataFrame, path: str, sep: str = "\t", quote: str = "", escape: str = "\\", line_end: str = "\n", null: str = "\\N", files: int | None = None) -> None:
    """Write delimited text, `\\N` for NULL. A folder of files in parallel; files=1 only for small results.

    Without quotes, separators, line feeds and backslashes within a field are escaped by a backslash, so that
    load_data gives every field back as it was, '' and the text \\N included.
    """
    out = df.coalesce(files) if files else df
    if not quote and len(sep) == 1 and escape == "\\" and null == "\\N":
        line = F.array_join(F.array(*(_escaped(F.col(f"`{c}`"), sep) for c in df.columns)), sep)
        out.select(line.alias("value")).write.mode("errorifexists").option("lineSep", line_end).text(path)
        return
    options = {"sep": sep, "escape": escape, "nullValue": null, "emptyValue": "", "lineSep": line_end, "quote": quote or "\0"}
    out.write.mode("errorifexists").options(**options).csv(path)


def into_variables(df: DataFrame) -> dict[str, object]:
    """SELECT ... INTO @v: one row at most; no row gives NULLs."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("the result has more than one row")
    return rows[0].asDict() if rows else dict.fromkeys(df.columns)
