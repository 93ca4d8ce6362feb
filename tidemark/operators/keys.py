"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hint of joins that come round by round: none is broadcast, so that nothing of a table goes to the driver.
SPREAD = "merge"


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of the same names, a null key to a null key; keys come once. It stays an equi-join."""
    own = {k: f"_key_{i}" for i, k in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()])
    joined = left.join(right.withColumnsRenamed(own), on, how)
    if how in ("left_anti", "left_semi"):
        return joined
    if how == "full_outer":
        joined = joined.withColumns({k: F.coalesce(k, o) for k, o in own.items()})
    return joined.drop(*own.values())
