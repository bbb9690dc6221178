"""Line-oriented operators: search with line numbers, recent patterns, minute headers, set and order helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, number, line) of the lines of each text; numbers start at 1."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("number", "line")).withColumn("number", (F.col("number") + 1).cast("long"))


def grep(lines: DataFrame, pattern: str, line: str = "line", ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Lines that a pattern is found in, or is not; null lines are neither."""
    found = F.col(line).rlike(f"(?i){pattern}" if ignore_case else pattern)
    return lines.filter(~found if invert else found)


def recent(patterns: Sequence[str], added: Sequence[str] = (), n: int = 40) -> list[str]:
    """The accumulated list of patterns: the last n."""
    return [*patterns, *added][-n:]


def with_headers(df: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, header: Column) -> DataFrame:
    """Rows without consecutive repeats of ``line``; ``header`` is null but where it changes, and on an entity's first row. Blank lines go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.trim(line) != "").withColumn("_before", F.lag(line).over(w)).filter(~F.col(line).eqNullSafe(F.col("_before")))
    rows = rows.withColumn("_h", header).withColumn("_last", F.lag("_h").over(w))
    return rows.withColumn("header", F.when(~F.col("_h").eqNullSafe(F.col("_last")), F.col("_h"))).drop("_before", "_h", "_last")


def zone_times(lines: DataFrame, parsed: Column, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Seconds between consecutive lines that hold a time; the first one of an entity has none."""
    rows = lines.withColumn("_at", F.unix_seconds(parsed)).filter("_at IS NOT NULL")
    return rows.withColumn("seconds", F.col("_at") - F.lag("_at").over(Window.partitionBy(*keys).orderBy(*order))).filter("seconds IS NOT NULL").drop("_at")


def members(df: DataFrame, group: str, member: str, size: str | None = None, least: int = 2) -> DataFrame:
    """(group, n, members) of groups with ``least`` members or more: ascending, or by descending size, then ascending.

    Ordered output is ``orderBy(desc n, members[0])``; a group's members are gathered in one array.
    """
    if size is None:
        listed = F.sort_array(F.collect_list(member))
    else:
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("s"), F.col(member).alias("m")))), lambda x: x["m"])
    return df.groupBy(group).agg(F.count(member).alias("n"), listed.alias("members")).filter(F.col("n") >= least)


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str], pattern: str, line: str = "line") -> DataFrame:
    """The first line of each entity that the pattern is found in; one row an entity and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.filter(F.col(line).rlike(pattern)).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def limited(df: DataFrame, keys: Sequence[str], order: Sequence[str], updates: int) -> DataFrame:
    """The first so many updates of each entity; -1: all."""
    if updates < 0:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= updates).drop("_k")


def media_summary(df: DataFrame, keys: Sequence[str], probe: str) -> DataFrame:
    """(keys, duration, audio_bps, width, height) of probe documents: greatest values over streams, the sum of the bit rates of those with channels; missing ones do not count."""
    schema = "struct<streams:array<struct<duration:double,channels:int,bit_rate:double,width:int,height:int>>>"
    streams = F.from_json(probe, schema)["streams"]
    most = lambda name: F.array_max(F.filter(F.transform(streams, lambda s: s[name]), lambda v: v.isNotNull()))
    audio = F.aggregate(F.filter(streams, lambda s: (s["channels"] > 0) & s["bit_rate"].isNotNull()), F.lit(0.0), lambda a, s: a + s["bit_rate"])
    return df.select(*keys, most("duration").alias("duration"), F.coalesce(audio, F.lit(0.0)).alias("audio_bps"), most("width").alias("width"), most("height").alias("height"))


def absolute(top: str, path: str) -> Column:
    """``path`` below ``top``; an absolute path stands alone."""
    return F.when(F.col(path).startswith("/"), F.col(path)).when(F.col(top).endswith("/"), F.concat(top, path)).otherwise(F.concat_ws("/", top, path))


def validation_report(statuses: DataFrame, status: str, line: str) -> DataFrame:
    """(section, at, line): a heading of each section that is not empty, its lines, and a blank line behind all but the last section.

    A writer sorts by section, at, line. Sections are MATCH, MISMATCH, MISSING, NEW.
    """
    names = ["MATCH", "MISMATCH", "MISSING", "NEW"]
    order = F.array_position(F.array(*map(F.lit, names)), F.col(status)).cast("int")
    rows = statuses.filter(F.col(status).isin(names)).select(order.alias("section"), F.lit(1).alias("at"), F.concat_ws(": ", status, line).alias("line"), F.col(status).alias("_s"))
    ends = rows.groupBy("section", "_s").agg(F.count("*").alias("_n"))
    heads = ends.select("section", F.lit(0).alias("at"), F.concat(F.lit("=== "), F.col("_s"), F.lit(" ===")).alias("line"))
    blanks = ends.filter("section < 4").select("section", F.lit(2).alias("at"), F.lit("").alias("line"))
    return rows.drop("_s").unionByName(heads).unionByName(blanks)


def duplicate_report(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(line) of each pair, or one line that says that there are none."""
    lines = pairs.select(F.concat(F.col(a).cast("string"), F.lit("\n\t"), F.col(b).cast("string"), F.lit("\n")).alias("line"))
    none = pairs.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("# No duplicates detected.").alias("line"))  # one row at most
    return lines.unionByName(none)


def verified(pairs: DataFrame, hashes: DataFrame, key: str, hash_col: str, most: int = 10) -> DataFrame:
    """Of candidate pairs (a, b), those whose looked-up hashes differ in at most so many bits; a missing hash is no match."""
    h = hashes.select(F.col(key), F.col(hash_col).alias("_h")).filter("_h IS NOT NULL")
    both = pairs.join(h.withColumnsRenamed({key: "a", "_h": "_x"}), "a").join(h.withColumnsRenamed({key: "b", "_h": "_y"}), "b")
    return both.withColumn("bits", F.bit_count(F.col("_x").bitwiseXOR(F.col("_y")))).filter(F.col("bits") <= most).drop("_x", "_y")


def changed_lazily(now: DataFrame, before: DataFrame, key: str, size: str, mtime: str, digest: Column) -> DataFrame:
    """Keys whose (size, time, digest) changed, new ones too; ``before`` has ``digest``.

    Where size and time agree nothing is read: ``digest``, over the columns of ``now``, is taken of the other rows only, and a row
    of the same size whose digest agrees was merely touched.
    """
    b = before.select(key, F.col(size).alias("_size"), F.col(mtime).alias("_time"), F.col("digest").alias("_digest"), F.lit(True).alias("_known"))
    moved = now.join(b, key, "left").filter(F.col("_known").isNull() | ~F.col(size).eqNullSafe(F.col("_size")) | ~F.col(mtime).eqNullSafe(F.col("_time")))
    differs = F.col("_known").isNull() | ~F.col(size).eqNullSafe(F.col("_size")) | ~digest.eqNullSafe(F.col("_digest"))
    return moved.filter(differs).select(key, F.when(F.col("_known").isNull(), "new").otherwise("changed").alias("why"))
