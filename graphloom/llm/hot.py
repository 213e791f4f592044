"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import written

#: Keys that may be broadcast, and places over which a hot key's rows are dealt.
BROADCAST_KEYS, SALTS = 200_000, 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, many: str, deal: str, how: str = "left", bound: int | None = None) -> DataFrame:
    """rows joined ('left' or 'inner') with keyed, which has each key once and counts its rows in column `many`.

    If there are more keys than `bound`, the most frequent ones are broadcast; the others meet by a shuffle, for
    which the rows of hot keys, and rows without a key, are dealt by a hash of column `deal`. Salts depend on the
    row only, so a task that runs again deals alike. rows are read once.
    """
    bound = BROADCAST_KEYS if bound is None else bound
    if keyed.count() <= bound:
        return rows.join(F.broadcast(keyed), key, how)
    added = [c for c in keyed.columns if c != key]
    hot = written(keyed.orderBy(F.desc(many), key).limit(bound), "hot")
    rest = keyed.join(F.broadcast(hot.select(key)), key, "left_anti").withColumn("salt_", F.lit(0).cast("long"))
    near = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"hot_{c}") for c in added])), key, "left")
    salt = F.when(F.col(f"hot_{many}").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(deal), F.lit(SALTS)))
    out = near.withColumn("salt_", salt.cast("long")).join(rest, [key, "salt_"], "left")
    out = out.select(*rows.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in added])
    return out if how == "left" else out.where(F.col(many).isNotNull())
