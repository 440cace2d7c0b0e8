"""Choosing tools under a deny list and a ceiling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def denied(name: Column, patterns: list[str]) -> Column:
    """Whether a name is one of the patterns, without regard to case; `*` stands for anything."""
    out = F.lit(False)
    for p in patterns:
        if p.strip():
            like = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
            out = out | name.ilike(like)
    return out


def select_tools(tools: DataFrame, most: float, deny: list[str], *, name: str = "name", order: str = "position") -> DataFrame:
    """tools with status: denied, selected or truncated. The ceiling is counted after denying; a negative one means none."""
    most = max(0, math.floor(most))
    marked = tools.withColumn("__denied", denied(F.col(name), deny))
    # the few that are selected are found by a bounded sort, not by numbering all rows in one task
    first = marked.where(~F.col("__denied")).orderBy(order, name).limit(most).select(F.col(order).alias("__o"), F.col(name).alias("__n"), F.lit(True).alias("__s"))
    joined = marked.join(first, (marked[order] == first["__o"]) & (marked[name] == first["__n"]), "left")
    status = F.when(F.col("__denied"), "denied").when(F.col("__s"), "selected").otherwise("truncated")
    return joined.select(*tools.columns, status.alias("status"))


def limit_from_error(message: Column) -> Column:
    """The number of tools that a provider's error message allows, or null."""
    number = F.coalesce(F.nullif(F.regexp_extract(message, r"(?i)more than (\d+)\s+tools?", 1), F.lit("")), F.nullif(F.regexp_extract(message, r"(?i)maximum of (\d+)\s+tools?", 1), F.lit(""))).cast("long")
    return F.when(message.rlike("(?i)tool") & (number > 0), number)


def best_by(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
