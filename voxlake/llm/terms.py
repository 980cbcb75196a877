"""Terms of whole texts, in DataFrame functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lowered(text: Column) -> Column:
    """text with A-Z alone lower-cased; a text of ASCII takes the function that works on bytes."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def matches(text: Column, pattern: str) -> Column:
    """All matches of pattern in text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
