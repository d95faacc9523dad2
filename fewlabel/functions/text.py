"""Text cleaning."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Python's notion of surrounding whitespace, in Java regex form.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _EDGE, "")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c) -> Column:
    """HTML entities to characters. Every entity begins with '&', so texts without one
    take the cheap branch; the Arrow batch still carries nulls for them, not their text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def link_placeholder(c) -> Column:
    """Pre-step for sources that already carry '@url'."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("@url"), F.lit("http"))


def clean_text(c) -> Column:
    """Unescape, mask user names and links, flatten line breaks and tabs, strip. Fixed patterns."""
    t = unescape(c)
    t = F.regexp_replace(t, r"@[A-Za-z0-9_-]+", "@user")
    t = F.regexp_replace(t, r"(?U)http\S+", "http")
    t = F.translate(t, "\n\t", "  ")
    t = F.replace(t, F.lit("[URL]"), F.lit("http"))
    return strip(t)
