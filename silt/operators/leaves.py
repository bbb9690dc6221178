"""JSON documents as rows of their scalars, one level of nesting after the other, by variants and without Python.

Each round takes the documents that are left one level apart (a generator in the JVM) and puts their scalars aside; it ends
when nothing nested is left, so documents of any depth are taken whole and the work of a round is what that level holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.operators import graph


def json_leaves(df: DataFrame, keep: Sequence[str], doc: str, cut: Callable[[DataFrame], DataFrame] = graph._cut) -> DataFrame:
    """``keep`` with (path, value) of every scalar: names joined by dots, places in brackets, as in a.b.[0].c.

    Values are shown as variants show them: whole numbers and decimals in plain digits, without zeros at their end. Null and
    false leaves are left out, as is what is no JSON; empty objects and arrays have no leaves.
    """
    level = df.select(F.struct(*keep).alias("kept"), F.lit("").alias("path"), F.try_parse_json(doc).alias("v")).filter("v IS NOT NULL")
    done: list[DataFrame] = []
    while True:
        level = cut(level.withColumn("nested", F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<")))
        done.append(level.filter("NOT nested").select("kept", "path", F.try_variant_get("v", "$", "string").alias("value")))
        inner = level.filter("nested")
        if inner.isEmpty():
            break
        each = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = each.select("kept", F.when(F.col("path") == "", name).otherwise(F.concat_ws(".", "path", name)).alias("path"), F.col("value").alias("v"))
    rows = reduce(DataFrame.unionByName, done).filter(F.col("value").isNotNull() & (F.col("value") != "false"))
    return rows.select("kept.*", "path", "value")


def selected(doc: Column, fields: dict[str, str]) -> Column:
    """A JSON object of the named paths of a variant or of JSON text, without those that are missing or null; null for what is no JSON.

    ``fields`` maps names to paths such as ``$.format.duration``; values keep their types.
    """
    v = F.try_parse_json(doc)
    real = lambda x: F.when(~F.is_variant_null(x), x)
    picked = F.to_json(F.struct(*[real(F.try_variant_get(v, path, "variant")).alias(name) for name, path in fields.items()]))
    return F.when(v.isNotNull(), picked)
