"""Per-row signals: entropy, margin, token counts and the criteria built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fewlabel.functions.vectors import total

ENTROPY_EPSILON = 1e-10


def entropy(p) -> Column:
    """-sum p ln(p + eps) of a probability array."""
    return -total(F.transform(p, lambda x: x * F.log(x + F.lit(ENTROPY_EPSILON))))


def exact_entropy(p) -> Column:
    """Entropy of the renormalised array, with 0 ln 0 = 0."""
    mass = total(F.col(p) if isinstance(p, str) else p)
    return -total(F.transform(p, lambda x: F.when(x > 0, (x / mass) * F.log(x / mass)).otherwise(0.0)))


def margin(p) -> Column:
    """Gap between the two largest probabilities."""
    ordered = F.sort_array(p, asc=False)
    return ordered[0] - ordered[1]


def words(text) -> Column:
    """Lower-cased whitespace tokens without empty ones."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def unique_tokens(text) -> Column:
    return F.size(F.array_distinct(words(text))).cast("long")


def is_blank(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t.isNull() | ~t.rlike(r"(?U)[^\s]")


# Sign of each criterion: results are sorted ascending by the weighted sum, so a negative sign
# favours large values. Fixed values.
CRITERION_SIGN = {"uncertainty": -1.0, "perplexity": -1.0, "margin": 1.0}


def signed(column: str) -> Column:
    """A stored signal with its direction applied; a missing value counts as 0."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) * F.lit(CRITERION_SIGN[column])
