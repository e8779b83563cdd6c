"""Text expressions that follow Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.split() and str.strip() treat as white space: the Unicode property,
# plus four separators it leaves out. Much faster than listing the characters.
_SPACE = r"\s\x1c-\x1f"


def word_count(text: Column | str) -> Column:
    """Number of white-space separated words; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U)[^{_SPACE}]+")), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove white space, of all kinds, from both ends."""
    return F.regexp_replace(text, f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")
