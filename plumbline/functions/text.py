"""Names and their similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy_name(name: Column) -> Column:
    """Capitals without outer spaces; null becomes the empty text."""
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def _share(a: Column, b: Column) -> Column:
    """Jaccard share of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def char_jaccard(a: Column, b: Column, keep_spaces: bool = True) -> Column:
    """Shared characters over all characters of two texts."""
    one, two = (F.split(x if keep_spaces else F.replace(x, F.lit(" "), F.lit("")), "") for x in (a, b))
    drop = lambda s: F.filter(s, lambda c: c != "")
    return _share(drop(one), drop(two))


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return _share(words(a), words(b))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, else 0.4 characters + 0.4 words + 0.2 containment, to 4 places; 0 if either is null or empty."""
    x, y = tidy_name(a), tidy_name(b)
    inside = F.when(F.contains(x, y) | F.contains(y, x), F.lit(1.0)).otherwise(F.lit(0.0))
    score = F.lit(0.4) * char_jaccard(x, y, False) + F.lit(0.4) * token_jaccard(x, y) + F.lit(0.2) * inside
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(F.bround(score, 4))


def closeness(a: Column, b: Column, tolerance: float) -> Column:
    """1 for equal positive numbers, falling to 0 at a relative difference of ``tolerance``; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b) / F.lit(tolerance)))
