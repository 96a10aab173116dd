"""Columns on whole texts that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words and pads lines.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than blanks."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
