"""Words as all operators here read them: runs of [^\\x20\\x09-\\x0D], A-Z folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | None) -> list[str]:
    """Folded words of one text; null and empty texts have none. bytes.lower and bytes.split know A-Z and \\x20\\x09-\\x0D alone."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(found).decode("utf-8", "surrogatepass").split(" ") if found else []


def word_array(text: Column) -> Column:
    """The same as a Column of array<string>."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+")
    return F.filter(cut, lambda w: w != "")


def row_hash(*columns: Column) -> list[Column]:
    """h1 and h2: 128 bits that stand for a row's values in these columns, nulls told apart."""
    flat = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*flat).alias("h1"), F.xxhash64(F.lit("second"), *flat).alias("h2")]
