"""Running values over arrays within a row, at a cost that grows with the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Appending copies an array, so running values are taken in blocks of this size.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, step) -> Column:
    """Running values of a short array."""
    return F.slice(
        F.aggregate(
            items, F.array(F.lit(0).cast("bigint")), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x))
        ),
        2,
        F.size(items),
    )


def _blocked(items: Column, step) -> Column:
    def in_blocks(values: Column) -> Column:
        blocks = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
        numbers = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: _running(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), step))

    def carried(parts: Column) -> Column:
        lasts = _running(F.transform(parts, lambda p: F.element_at(p, -1)), step)
        before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), lasts), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda p, o: F.transform(p, lambda x: step(o, x))))

    return let(let(items, in_blocks), carried)


def running_sums(items: Column) -> Column:
    """Sums up to and with each item of an array of longs."""
    return _blocked(items, lambda a, x: a + x)


def running_maxima(items: Column) -> Column:
    """Maxima up to and with each item of an array of non-negative longs."""
    return _blocked(items, lambda a, x: F.greatest(a, x))


def following(items: Column, then) -> Column:
    """``then(item, next item)`` of each item; the last one has NULL next."""
    return F.transform(items, lambda x, i: then(x, F.get(items, i + 1)))


def matching_ends(events: Column) -> Column:
    """``array<struct<place,end>>`` of all starts, by place, from ``struct<name,place,step>``.

    ``step`` is 1 at a start and -1 at an end. The end of a start is the first later place where the
    running sum of its name falls below the start's; NULL if it never does. Steps up and down
    between the same two levels alternate, so sorted by level each start stands before its end.
    """

    def levelled(ordered: Column) -> Column:
        after = running_sums(F.transform(ordered, lambda e: e["step"]))
        level = lambda e, sum_: F.struct(
            e["name"].alias("name"), (sum_ + F.when(e["step"] < 0, 1).otherwise(0)).alias("level"),
            e["place"].alias("place"), e["step"].alias("step"),
        )
        return F.array_sort(F.zip_with(ordered, after, level))

    def paired(placed: Column) -> Column:
        def pair(e: Column, following_: Column) -> Column:
            same = (following_["name"] == e["name"]) & (following_["level"] == e["level"])
            return F.when(e["step"] > 0, F.struct(e["place"].alias("place"), F.when(same, following_["place"]).alias("end")))

        return F.array_sort(F.filter(following(placed, pair), lambda p: p.isNotNull()))

    return let(let(F.array_sort(events), levelled), paired)


def last_of_each(rows: Column, key: str) -> Column:
    """Of sorted structs the last one of each value of ``key``."""
    alone = following(rows, lambda x, y: F.when(y.isNull() | (y[key] != x[key]), x))
    return F.filter(alone, lambda x: x.isNotNull())
