"""Context windows of generation: shared prefixes and eviction behind a pinned head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading elements of two arrays; 0 for null."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))

    def step(s: Column, i: Column) -> Column:
        same = s["same"] & F.get(a, i).eqNullSafe(F.get(b, i))
        return F.struct((s["n"] + F.when(same, 1).otherwise(0)).alias("n"), same.alias("same"))

    return F.coalesce(F.aggregate(places, start, step)["n"], F.lit(0))


def reusable(matched: Column, prompt: Column) -> Column:
    """Tokens that need no new pass: all matched ones, but at least one token of a prompt is always passed again."""
    return F.when((prompt > 0) & (matched >= prompt), prompt - 1).otherwise(matched)


def eviction(length: Column, more: Column, capacity: int, keep: int = 4) -> Column:
    """Tokens to drop behind the pinned head so that ``more`` fit: what is missing and a quarter of the capacity, if there.

    0 if they fit; null if the head and the new tokens exceed the capacity.
    """
    pinned = F.least(F.lit(keep), length)
    need = length + more - capacity
    discard = F.least(length - pinned, need + capacity // 4)
    return F.when(need <= 0, 0).when(pinned + more > capacity, None).otherwise(discard).cast("bigint")


def pinned_status(seed: Column, sinks: int, window: int) -> Column:
    """``error`` where the pinned head (seed and sink tokens) fills the window, ``warning`` where the seed passes a fifth of it, else ``ok``."""
    return F.when(seed + sinks >= window, "error").when(seed * 5 > window, "warning").otherwise("ok")
