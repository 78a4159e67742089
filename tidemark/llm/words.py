"""Words as the scanning operators see them: runs of 0-9, A-Z folded to a-z, and every character beyond ASCII."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.llm.common import lower_ascii

#: what separates words while A-Z is not folded yet
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The array of words, folded; empty for null or a text without words."""
    spaced = F.btrim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, " "))
    return F.when(spaced != "", F.split(lower_ascii(spaced), " ")).otherwise(F.array().cast("array<string>"))
