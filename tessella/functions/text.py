"""Text functions of plate reading, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_label(s: Column) -> Column:
    """The first letter or digit of a label, upper case; empty where it has none."""
    return F.regexp_extract(F.upper(s), "([0-9A-Z])", 1)


def for_slot(ch: Column, slot: Column) -> Column:
    """Letters that look like digits in a digit slot, and the other way round."""
    c = clean_label(ch)
    return F.when(slot == "D", F.translate(c, "OQDILZSGB", "000112568")).when(slot == "L", F.translate(c, "012568", "OIZSGB")).otherwise(c)


def plate_slots(n: Column) -> Column:
    return F.substring(F.concat(F.lit("DDL"), F.repeat(F.lit("D"), n)), F.lit(1), n)


def compact(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^0-9A-Z]", "")


def format_plate(s: Column) -> Column:
    c = compact(s)
    return F.when(F.length(c) <= 3, c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, F.lit(4), F.length(c))))


def corrected(s: Column) -> Column:
    """Each character of the compact text for its slot."""
    c = compact(s)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.when(i > F.length(c), "").otherwise(for_slot(F.substring(c, i, F.lit(1)), F.when(i == 3, "L").otherwise("D")))), "")


def low_confidence(confidences: Column, least: float = 0.5) -> Column:
    return F.filter(F.transform(confidences, lambda c, i: F.when(c < least, i)), lambda i: i.isNotNull())


def normalize_label(s: Column) -> Column:
    """Letters and digits of any script, upper case; an empty result is an error."""
    out = F.regexp_replace(F.upper(s), r"[^\p{L}\p{N}]", "")
    return F.when(out == "", F.raise_error(F.lit("a label has no letter or digit")).cast("string")).otherwise(out)


def ocr_result(summary: Column) -> Column:
    return F.regexp_extract(summary, "Character OCR result = ([A-Z0-9]+)", 1)
