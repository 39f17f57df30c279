"""A join by a key whose rows are counted, for tables in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so at most SHARE + 1 keys are, which bounds what is broadcast.
SHARE = 1000


def counted_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left") to right, which has one row per key and, in `count`, how many rows of left have that key.

    The hot keys' rows of right, at most SHARE + 1, are broadcast, so that hot rows of left stay where they are; all others meet
    by a shuffle. `count` is not in the result. Null keys find nothing. Both tables are read twice and should be written ones.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * SHARE >= F.lit(total)
    few, rest = right.where(hot).drop(count), right.where(~hot).drop(count)
    keys = F.broadcast(few.select(key))
    return left.join(F.broadcast(few), key).unionByName(left.join(keys, key, "left_anti").join(rest, key, how))
