"""Rules that differ from source to source, chosen by a table.

A policy is compiled to one expression; which policy a source follows is a row
of a table.  The table is joined once, and a row evaluates the expression of
its own policy only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.session import sized_broadcast


def by_policy(rows: DataFrame, chosen: DataFrame, compiled: Mapping[str, Column], name: str,
              source: str = "source", default: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the expression that ``chosen`` (source, policy)
    names for the row's source.

    Sources without a row follow ``default``, or get null.  A policy that is
    not compiled is an error at once, not a null.  Of several rows of a
    source the smallest policy name counts."""
    if default is not None and default not in compiled:
        raise ValueError(f"no policy {default!r}")
    once = chosen.groupBy(F.col(source).alias("_source")).agg(F.min("policy").alias("_policy"))
    unknown = once.filter(~F.col("_policy").isin(*compiled)).select("_policy").limit(5).collect()
    if unknown:
        raise ValueError(f"no policy {sorted({r[0] for r in unknown})}")
    joined = rows.join(sized_broadcast(once), rows[source].eqNullSafe(F.col("_source")), "left")
    policy = F.coalesce("_policy", F.lit(default)) if default is not None else F.col("_policy")
    value = None
    for key, expr in compiled.items():
        value = F.when(policy == key, expr) if value is None else value.when(policy == key, expr)
    return joined.withColumn(name, value).drop("_source", "_policy")
