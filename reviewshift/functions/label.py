"""Label rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_keyword(text, keywords: tuple[str, ...] = lx.NEGATIVE_KEYWORDS) -> Column:
    """Any keyword as a plain substring of the lower-cased text, which is computed once: plain searches one after
    another take less than half the time of one regex of all keywords."""
    if not keywords:
        return F.lit(False)
    low = F.array(F.lower(F.coalesce(_c(text), F.lit(""))))
    return F.exists(low, lambda x: reduce(lambda a, b: a | b, [x.contains(F.lit(k)) for k in keywords]))


def auto_label(rating, text, keywords: tuple[str, ...] = lx.NEGATIVE_KEYWORDS) -> Column:
    """M1: rating 1/2 -> Negatif; else keyword hit -> Negatif; 3 -> Netral; else Positif."""
    r = _c(rating)
    return (F.when(r.isin(1, 2), F.lit("Negatif"))
            .when(has_keyword(text, keywords), F.lit("Negatif"))
            .when(r == 3, F.lit("Netral"))
            .otherwise(F.lit("Positif")))


def keyword_hits(text, keywords: tuple[str, ...] = lx.NEGATIVE_KEYWORDS) -> Column:
    """M3: the keywords found in the text, in list order."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.filter(arr, lambda k: low.contains(k))


def encode_label(label) -> Column:
    """M2: label name -> id (null for unknown names)."""
    out = None
    for name, i in lx.LABEL2ID.items():
        out = (F.when(_c(label) == name, F.lit(i)) if out is None
               else out.when(_c(label) == name, F.lit(i)))
    return out


def decode_label(label_id) -> Column:
    out = None
    for i, name in lx.ID2LABEL.items():
        out = (F.when(_c(label_id) == i, F.lit(name)) if out is None
               else out.when(_c(label_id) == i, F.lit(name)))
    return out


def binary_to_rating(label) -> Column:
    """Binary source label 0 -> 1 star, 1 -> 5 stars, other/missing -> 3."""
    x = _c(label).cast("string").try_cast("double")
    return F.when(x == 0.0, F.lit(1)).when(x == 1.0, F.lit(5)).otherwise(F.lit(3))


def coerce_rating(rating) -> Column:
    """C4: numeric or 3, truncated to int, clipped to 1..5."""
    x = _c(rating).cast("string").try_cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    x = F.coalesce(x, F.lit(3.0))
    return F.least(F.greatest(x, F.lit(1.0)), F.lit(5.0)).cast("int")
