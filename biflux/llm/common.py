"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that separate words in most contracts: blank and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def utf8(text: Column) -> Column:
    """The text as bytes, so that Python workers need no decoding; null is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def literal_table(spark: SparkSession, json_text: str, row: str) -> DataFrame:
    """A small table of parameters from JSON, made by the JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json_text), f"array<struct<{row}>>")).alias("r")).select("r.*")


def carried(columns: list[str] | tuple[str, ...]) -> Column:
    """Columns that travel with a row through an operator, as one struct ``carried``."""
    return (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(True)).alias("carried")
