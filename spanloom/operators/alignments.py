"""Typing and normalising raw alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.schemas import RAW_ALIGNMENT


_BLANKS = " \t\n\x0B\f\r"
_DIGITS = r"\d+(?:_\d+)*"
#: A decimal number, in blanks; single underscores may stand between its digits.
_NUMBER = rf"^[ \t\n\x0B\f\r]*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[ \t\n\x0B\f\r]*\z"


def _spelled(text: Column) -> Column:
    """The number without blanks around it and single underscores between its digits."""
    bare = F.trim(text, F.lit(_BLANKS))
    return F.when(F.contains(text, F.lit("_")), F.regexp_replace(bare, r"(?<=\d)_(?=\d)", "")).otherwise(bare)


def rounded(text: Column, to: str) -> Column:
    """Text as a number of an integral type, rounded half away from zero: '12.6' is 13, '1e2' 100, '.5' 1.

    Text that isn't a decimal number, or is beyond the type, is an error; null stays null. The exact number
    is rounded, however many digits it has. Hexadecimal and binary numbers aren't read. One pattern
    tells whether a text is a number, and casting it to a decimal without a scale rounds it.
    """
    near = F.replace(text, F.lit("_")).cast("decimal(38,0)")
    bare = _spelled(text)
    # Other text is left to the cast, which names it in its error.
    return F.when(text.rlike(_NUMBER), near.cast(to)).otherwise(F.when(bare.rlike("[.eE]"), F.concat(bare, F.lit("?"))).otherwise(bare).cast(to))


def typed(raw: DataFrame, *, rounding: bool = False) -> DataFrame:
    """The 14 columns with their types. Text that isn't a number of its type is an error (ANSI casts).

    With ``rounding``, integers can be written as decimal numbers (``rounded``).
    """
    cast = lambda f: rounded(F.col(f.name), "int") if rounding and f.dataType == T.IntegerType() else F.col(f.name).cast(f.dataType)
    if rounding:
        raw = raw.withColumns({f.name: _spelled(F.col(f.name)) for f in T.StructType.fromDDL(RAW_ALIGNMENT) if f.dataType == T.DoubleType()})
    return raw.select(*(cast(f).alias(f.name) for f in T.StructType.fromDDL(RAW_ALIGNMENT)))


def normalised(raw: DataFrame) -> DataFrame:
    """Non-self alignments with ordered intervals and relative orientation.

    Rows with a null query or target go with the self hits: no comparison holds for them.
    """
    ordered = [f(F.col(f"{side}_start"), F.col(f"{side}_end")).cast("int").alias(f"{side}_{name}") for side in ("query", "target") for f, name in ((F.least, "from"), (F.greatest, "to"))]
    same = (F.col("query_end") >= F.col("query_start")) == (F.col("target_end") >= F.col("target_start"))
    return raw.where("query_id <> target_id").select(*raw.columns, *ordered, F.when(same, 1).otherwise(-1).cast("short").alias("relative_orientation"))


def counts(raw: DataFrame) -> DataFrame:
    """One row: alignments, self hits, rows without an id, and what normalising keeps."""
    self_hit, keep = F.col("query_id") == F.col("target_id"), F.col("query_id") != F.col("target_id")
    return raw.agg(F.count("*").alias("input_alignments"), F.count_if(self_hit).alias("self_alignments"), F.count_if(F.col("query_id").isNull() | F.col("target_id").isNull()).alias("alignments_without_id"), F.count_if(keep).alias("normalized_alignments"))
