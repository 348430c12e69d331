"""Reproducible random draws.

A draw is a function of the row's key and a seed, never of the row's position, so a task that is
run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_key(*parts: Column | str | int) -> Column:
    """A uniform 128 bit key, as 32 hex digits, of the given columns and literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw_below(bound: Column, *parts: Column | str | int) -> Column:
    """A uniform integer in 0..bound-1 (60 random bits); null when the bound is zero."""
    number = F.conv(F.substring(hex_key(*parts), 1, 15), 16, 10).cast("long")
    return F.when(bound > 0, F.pmod(number, F.nullif(bound, F.lit(0).cast("long"))))


def free_below(taken: Column) -> Column:
    """For each item of `taken` (sorted, distinct ids), how many smaller ids are not in it."""
    return F.transform(taken, lambda p, i: p - i)


def unseen_item(free: Column, r: Column) -> Column:
    """The r-th item id (from 0) that is not taken, given `free_below` of the taken ones.

    It is r plus the number of taken ids that have at most r free ids below them: the place that r + 1
    would have among those (sorted) counts.  Sorting an almost sorted array of numbers is cheaper than
    testing its elements one by one in a lambda.
    """
    following = r + 1
    return r + F.array_position(F.sort_array(F.array_append(free, following)), following) - 1
