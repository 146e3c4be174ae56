"""Array columns without exploding: running sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 16


def starts(sizes: Column, levels: int = 2) -> Column:
    """For each number of an array the sum of those before it.

    Sums are made within parts of ``PART`` numbers and then in the same way over the parts, as an array can only be
    built up by copying it.
    """
    empty = F.array().cast("array<int>")
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    running = lambda a, at: F.aggregate(a, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])
    if not levels:
        return running(sizes, F.lit(0))

    def summed(parts: Column) -> Column:
        heads = starts(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x)), levels - 1)
        return F.flatten(F.zip_with(parts, heads, running))

    def of(a: Column) -> Column:
        last = F.greatest(F.floor((F.size(a) - 1) / PART), F.lit(0)).cast("int")
        return summed_of(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(a, k * PART + 1, PART)))

    # Each array is bound by a lambda, so it is worked out once however often it is named.
    summed_of = lambda parts: F.get(F.transform(F.array(parts), summed), F.lit(0))
    return F.get(F.transform(F.array(sizes), of), F.lit(0))
