"""Joins that stay spread when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_on: Sequence[str] | None = None,
    salts: int = 1,
) -> DataFrame:
    """Join many ``rows`` with a smaller ``lookup`` on keys that may be hot.

    The join has a further key, computed alike on both sides. It makes both sides plain
    shuffles even where the lookup is already grouped by ``on``, which is what lets the
    adaptive skew join split a hot key. The lookup is shuffled once, whatever its size; a
    lookup under the broadcast threshold is still broadcast by the planner. With ``salts``
    over 1, rows of one key are also dealt over so many sub-keys by a hash of their own
    columns, and the lookup is repeated for each, for keys hotter than that join can split.
    """
    if salts == 1:
        zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")
        return rows.withColumn(SALT, zero).join(lookup.withColumn(SALT, zero), [*on, SALT], how).drop(SALT)
    dealt = rows.withColumn(SALT, F.pmod(F.xxhash64(*(salt_on or rows.columns)), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn(SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(repeated, [*on, SALT], how).drop(SALT)
