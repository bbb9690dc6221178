"""Joins on beginnings: paths below a table of folders, names that fit a table of patterns.

Both are equi-joins on pieces that either side can name, so no plan has a nested loop and none grows with the number of
folders or patterns. Rows meet folders by directory: each distinct directory is taken apart into its ancestors once,
however many rows it has. A folder that a third of all rows lie below is one hot key of a join whose other side holds it
once, which adaptive execution splits.

A row is below a folder if its path is the folder or goes on after it with a slash. The folders "", "." and "/" hold
everything; slashes at a folder's end do not count. Null paths are below nothing; null folders are skipped; repeated folders count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_key(folder: Column) -> Column:
    """A folder without slashes at its end; "" for what holds everything."""
    bare = F.regexp_replace(folder, "/+$", "")
    return F.when(bare == ".", "").otherwise(bare)


def directory(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder, all folders that hold it, and ""."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def folder_table(df: DataFrame, folders: DataFrame | Sequence[str], folder: str = "folder") -> DataFrame:
    """(folder_) of distinct keys, from a table or from a few names."""
    if not isinstance(folders, DataFrame):
        folders, folder = df.sparkSession.createDataFrame([(f,) for f in folders], "folder string"), "folder"
    return folders.filter(F.col(folder).isNotNull()).select(folder_key(F.col(folder)).alias("folder_")).distinct()


def marked_below(df: DataFrame, path: str, folders: DataFrame | Sequence[str], folder: str = "folder", mark: str = "below") -> DataFrame:
    """``df`` with ``mark``: whether ``path`` is below any of the folders."""
    held = folder_table(df, folders, folder)
    dirs = df.filter(F.col(path).isNotNull()).select(directory(F.col(path)).alias("dir_")).distinct()
    up = dirs.select("dir_", F.explode(ancestors(F.col("dir_"))).alias("folder_"))
    covered = up.join(held, "folder_", "left_semi").select("dir_").distinct().withColumn("by_dir_", F.lit(True))
    rows = df.select(F.struct("*").alias("row_"), directory(F.col(path)).alias("dir_"), F.regexp_replace(path, "/+$", "").alias("folder_"))
    itself = held.withColumn("by_name_", F.lit(True))
    joined = rows.join(covered, "dir_", "left").join(itself, "folder_", "left")
    return joined.select("row_.*", F.coalesce("by_dir_", "by_name_", F.lit(False)).alias(mark))


def below(df: DataFrame, path: str, folders: DataFrame | Sequence[str], folder: str = "folder") -> DataFrame:
    """Rows at or below any of the folders."""
    return marked_below(df, path, folders, folder, "below_").filter("below_").drop("below_")


def not_below(df: DataFrame, path: str, folders: DataFrame | Sequence[str], folder: str = "folder") -> DataFrame:
    """Rows below none of the folders."""
    return marked_below(df, path, folders, folder, "below_").filter("NOT below_").drop("below_")


#: Lengths of the literal ends by which patterns are found; a longer literal is found by as much of it.
LENGTHS = (1, 2, 4, 8, 16, 32)
WILD = r"[*?]"
#: Patterns of wildcards only (such as "*" or "??*") are told from the name's length alone; so many of them at most differ.
BARE = 64


def _cut(length: Column) -> Column:
    """The greatest of ``LENGTHS`` that is not over ``length``; 0 below all."""
    return F.greatest(F.lit(0), *[F.when(length >= n, n) for n in LENGTHS])


def pattern_regex(pattern: Column) -> Column:
    """A pattern in which * stands for any characters and ? for one, as a regular expression over whole names."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+\-^$|&~#])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def pattern_keys(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, how, key): by what each distinct pattern is found.

    "whole" has no wildcard, "begin" and "end" the longer of its literal ends (the beginning, if they are even), cut to one of
    ``LENGTHS``; "inside" has a literal of up to three characters from its middle, "bare" none.
    """
    p = F.col("pattern")
    begin, end = F.regexp_extract(p, r"(?s)^([^*?]*)", 1), F.regexp_extract(p, r"(?s)([^*?]*)$", 1)
    runs = F.filter(F.split(p, WILD), lambda x: x != "")
    longest = F.left(F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.lit(3))
    rows = patterns.filter(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    rows = rows.withColumns({"a": begin, "z": end, "m": longest})
    how = F.when(~p.rlike(WILD), "whole").when((F.length("a") >= F.length("z")) & (F.col("a") != ""), "begin").when(F.col("z") != "", "end").when(F.col("m").isNotNull(), "inside").otherwise("bare")
    key = F.when(F.col("how") == "whole", p).when(F.col("how") == "begin", F.left("a", _cut(F.length("a")))).when(F.col("how") == "end", F.right("z", _cut(F.length("z")))).otherwise(F.col("m"))
    return rows.withColumn("how", how).withColumn("key", key).select("pattern", "how", "key")


def pattern_matches(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(name, pattern): which distinct names fit which distinct patterns, as whole names.

    A name has one key for each way to be found: itself, its beginnings and ends of ``LENGTHS``, its runs of up to three
    characters. Names meet patterns on a key and are then compared. Patterns without any literal say no more than how long a
    name is; over ``BARE`` of those are refused.
    """
    keys = pattern_keys(patterns, pattern)
    each = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    n = F.length("name")
    asked = {(r.how, r.n) for r in keys.select("how", F.when(F.col("how") == "whole", 0).otherwise(F.length("key")).alias("n")).distinct().collect()}  # at most 17 kinds
    entry = lambda how, key: F.struct(F.lit(how).alias("how"), key.alias("key"))
    ways = [F.when(n >= k, entry(how, cut("name", F.lit(k)))) for k in LENGTHS for how, cut in (("begin", F.left), ("end", F.right)) if (how, k) in asked]
    ways += [entry("whole", F.col("name"))] if ("whole", 0) in asked else []
    inside = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: entry("inside", F.substring("name", i, F.lit(k))))
    runs = [inside(k) for k in (1, 2, 3) if ("inside", k) in asked]
    none = F.array().cast("array<struct<how:string,key:string>>")
    found = each.select("name", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(*ways) if ways else none, *runs)))).alias("e")).select("name", "e.*")
    regex = keys.filter("how <> 'bare'").withColumn("regex_", pattern_regex(F.col("pattern")))
    met = found.join(regex, ["how", "key"]).filter((F.col("how") == "whole") | F.expr("name RLIKE regex_")).select("name", "pattern")
    bare = [r.pattern for r in keys.filter("how = 'bare'").limit(BARE + 1).collect()]
    if len(bare) > BARE:
        raise ValueError(f"over {BARE} patterns without any literal character")
    fits = [F.when((n >= p.count("?")) if "*" in p else (n == len(p)), F.lit(p)) for p in bare]
    return met.unionByName(each.select("name", F.explode(F.array_compact(F.array(*fits))).alias("pattern"))) if fits else met


def pattern_sums(rows: DataFrame, name: str, value: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, n, total): rows and sum of those whose name fits each pattern, 0 and null without any; rows are summed by name first."""
    sums = rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    met = pattern_matches(sums, "name", patterns, pattern).join(sums, "name").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = patterns.filter(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    return every.join(met, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"), "total")
