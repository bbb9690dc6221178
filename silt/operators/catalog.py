"""Snapshot catalogues: redundancy, diffs, integrity, content joins, upserts.

Everything is an equi-join or a partial aggregate, so work follows the rows and no side is collected. Folders that could
not be read, or that were scanned, may be a table of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.operators import prefixes


def redundancy(files: DataFrame, keys: Sequence[Column], place: str, fewer_than: int, within: Sequence[str] | None = None) -> DataFrame:
    """Keys held in fewer than ``fewer_than`` distinct places; null digests are skipped."""
    rows = files if within is None else files.filter(F.col(place).isin(list(within)))
    for key in keys:
        rows = rows.filter(key.isNotNull())
    return rows.groupBy(*keys).agg(F.countDistinct(place).alias("copies")).filter(F.col("copies") < fewer_than)


def changed(a: Column, b: Column, tolerance: float | None = None) -> Column:
    """Whether two values differ: null-safely, or by at least ``tolerance``."""
    return ~a.eqNullSafe(b) if tolerance is None else F.coalesce(F.abs(a - b) >= tolerance, ~a.eqNullSafe(b))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """INSERT, UPDATE, DELETE or SAME for every key of either side; UPDATE also where the old digest is missing."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("in_old"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("in_new"))
    differs = reduce(lambda x, y: x | y, [changed(F.col(f"old_{v}"), F.col(f"new_{v}")) for v in values])
    status = F.when(F.col("in_old").isNull(), "INSERT").when(F.col("in_new").isNull(), "DELETE").when(differs, "UPDATE").otherwise("SAME")
    return o.join(n, list(keys), "full_outer").select(*keys, status.alias("status"))


def under(path: Column, folder: str) -> Column:
    """Whether ``path`` is ``folder`` or lies below it; the empty folder and '.' hold everything."""
    return F.lit(True) if folder in ("", ".") else (path == folder) | path.startswith(f"{folder}/")


def protected_deletes(old: DataFrame, new: DataFrame, path: str, failed: DataFrame | Sequence[str], folder: str = "folder") -> DataFrame:
    """Paths that went, but for those below folders that could not be read: a table with a column ``folder``, or a few names."""
    return prefixes.not_below(old.select(path).join(new.select(path), path, "left_anti"), path, failed, folder)


def integrity(known: DataFrame, found: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """MATCH, MISMATCH, MISSING (known only) or NEW (found only); two unreadable digests match."""
    k = known.select(*keys, F.col(digest).alias("known_digest"), F.lit(True).alias("in_known"))
    f = found.select(*keys, F.col(digest).alias("found_digest"), F.lit(True).alias("in_found"))
    status = F.when(F.col("in_known").isNull(), "NEW").when(F.col("in_found").isNull(), "MISSING").when(F.col("known_digest").eqNullSafe(F.col("found_digest")), "MATCH").otherwise("MISMATCH")
    return k.join(f, list(keys), "full_outer").select(*keys, status.alias("status"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order; only one row a key and task is shuffled (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def content_join(new: DataFrame, old: DataFrame, keys: Sequence[str], new_id: str, old_id: str) -> DataFrame:
    """Each new row with the first old row of equal content; null keys match nothing."""
    firsts = old.groupBy(*keys).agg(F.min(old_id).alias(old_id))
    return new.select(new_id, *keys).join(firsts, list(keys)).select(new_id, old_id, *keys)


def growth(before: DataFrame, now: DataFrame, key: str, size: str) -> DataFrame:
    """[N] new and [C] changed rows with what they add; unchanged and removed rows are not reported."""
    b = before.select(key, F.col(size).alias("old_size"))
    delta = F.when(F.col("old_size").isNull(), F.col(size)).otherwise(F.col(size) - F.col("old_size"))
    rows = now.select(key, size).join(b, key, "left").withColumn("delta", delta)
    mark = F.when(F.col("old_size").isNull(), "[N]").when(F.col("delta") != 0, "[C]")
    return rows.withColumn("mark", mark).filter("mark IS NOT NULL").select(key, "mark", "delta")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``updates`` put in by key; an updated row is taken whole."""
    rest = [c for c in base.columns if c not in keys]
    u = updates.select(*keys, F.struct(*rest).alias("_new"))
    b = base.select(*keys, F.struct(*rest).alias("_old"))
    return b.join(u, list(keys), "full_outer").withColumn("_row", F.coalesce("_new", "_old")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def deleted(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``base`` without the rows of the listed keys."""
    return base.join(keys.select(*on).distinct(), list(on), "left_anti")


def pruned(base: DataFrame, seen: DataFrame, path: str, root: DataFrame | str, folder: str = "folder") -> DataFrame:
    """``base`` without rows below the scanned ``root``, or roots (a table), that were not seen; a sibling whose name starts alike stays."""
    if isinstance(root, str):
        below = base.filter(under(F.col(path), root)).join(seen.select(path), path, "left_semi")
        return base.filter(~under(F.col(path), root)).unionByName(below)
    there = seen.select(path).distinct().withColumn("seen_", F.lit(True))
    return prefixes.marked_below(base, path, root, folder, "below_").join(there, path, "left").filter("NOT below_ OR seen_").select(*base.columns)


def same_place_duplicates(a: DataFrame, b: DataFrame, path: str, tests: Sequence[str]) -> DataFrame:
    """Paths of ``b`` whose row in ``a`` agrees in all ``tests`` (size and digest, or size and time)."""
    left, right = a.select(path, *[F.col(t).alias(f"_{t}") for t in tests]), b.select(path, *tests)
    return right.join(left, path).filter(reduce(lambda x, y: x & y, [F.col(t) == F.col(f"_{t}") for t in tests])).select(path)
