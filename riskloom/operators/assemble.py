"""Joins, unions and projections that assemble the wide feature table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from riskloom.functions.exprs import qcol

NAME_PATTERN = re.compile(r"[^A-Za-z0-9_]+")


def left_join_chain(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left outer joins of per-key roll-ups onto the base table.

    Each part is unique per key (it is a group-by output), so there is
    no fan-out. Every part is already hash-partitioned on the key by its
    own aggregate, so the chain needs one exchange for the base table
    and none for the parts; AQE turns small parts into broadcasts at run
    time from their measured size.
    """
    return reduce(lambda acc, p: acc.join(p, on=key, how="left"), parts, base)


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (J3, ``isin``)."""
    return df.join(keys.select(qcol(key)), on=key, how="left_semi")


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sanitize_names(df: DataFrame, pattern: re.Pattern = NAME_PATTERN) -> DataFrame:
    """Strip characters outside ``[A-Za-z0-9_]`` from every column name.

    Raises when two names become equal, exactly or ignoring case (Spark
    resolves names case-insensitively by default).
    """
    clean = [pattern.sub("", c) for c in df.columns]
    seen: dict[str, str] = {}
    for orig, new in zip(df.columns, clean):
        k = new.lower()
        if k in seen:
            raise ValueError(f"column names collide after cleaning: {seen[k]!r} and {orig!r} -> {new!r}")
        seen[k] = orig
    return df.toDF(*clean)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in a stated order (T3, ``head``): Spark rows have
    no order of their own, so the order is an argument."""
    return df.orderBy(*[qcol(c) for c in order]).limit(n)
