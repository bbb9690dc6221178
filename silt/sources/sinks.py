"""Sinks and report formats. Line formats are columns, so a caller writes them with any writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.functions import text as T


def lines(df: DataFrame, path: str, line: Column, separator: str = "\n") -> None:
    df.select(line.alias("value")).write.option("lineSep", separator).text(path)


def redundancy_line(path: str, copies: str, md5: str) -> Column:
    return F.concat(F.col(path), F.lit("#@#"), F.col(copies).cast("string"), F.lit(" "), F.col(md5))


def existing_line(new: str, old: str) -> Column:
    return F.concat_ws("###", new, old)


def similar_line(new: str, old: str, new_size: str, old_size: str) -> Column:
    return F.concat(F.col(old), F.lit("####"), F.col(new), F.lit("####"), F.col(old_size).cast("string"), F.lit(":"), F.col(new_size).cast("string"))


def validation_line(status: str, path: str, known: str, found: str) -> Column:
    show = lambda c: F.coalesce(F.col(c), F.lit("UNREADABLE"))
    return F.concat_ws(" ", F.col(status), F.col(path), F.when(F.col(status) == "MISMATCH", F.concat_ws(" ", show(known), show(found))))


def rename_line(old: str, new: str) -> Column:
    q = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.concat_ws(" ", F.lit("mv -i --"), q(old), q(new))


def html_rows(columns: Sequence[str]) -> Column:
    """One table row a row; cells are escaped."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), T.html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def semicolon_csv(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """A snapshot for later growth reports, as zstd Parquet."""
    df.write.option("compression", "zstd").parquet(path)


def bar_line(key: str, count: str) -> Column:
    return F.concat(F.lpad(F.col(key).cast("string"), 2, "0"), F.lit(" "), F.repeat(F.lit("="), F.col(count).cast("int")))


def by_stream(df: DataFrame, path: str, stream: str, line: Column) -> None:
    """One folder a stream."""
    df.select(F.col(stream), line.alias("value")).write.partitionBy(stream).text(path)


def benchmark_json(settings: dict[str, str | int | float], results: Sequence[str]) -> Column:
    """A benchmark's settings and the row's results as one JSON document."""
    return F.to_json(F.struct(F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("config"), F.struct(*results).alias("results")))


def binary_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """One file a row, in a folder that all executors see; a name that repeats is written again."""

    def put(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for n, c in rows:
            with open(os.path.join(folder, n), "wb") as f:
                f.write(bytes(c or b""))

    df.select(name, content).foreachPartition(put)


def playlist_lines(df: DataFrame, lists: str, track: str) -> DataFrame:
    """(playlist, pos, line): a header and the tracks of each playlist, in order of their names."""
    at = Window.partitionBy(lists).orderBy(track)
    rows = df.filter(F.col(track).isNotNull()).select(F.col(lists).alias("playlist"), F.row_number().over(at).cast("long").alias("pos"), F.col(track).alias("line"))
    heads = df.select(F.col(lists).alias("playlist")).distinct().withColumn("pos", F.lit(0).cast("long")).withColumn("line", F.lit("#EXTM3U"))
    return rows.unionByName(heads)


def fitted(value: Column, width: int) -> Column:
    """A whole number right-aligned in a width, in the largest of the units "", k, M, G in which it needs no more room."""
    out = F.lit("-" * width)
    for step, unit in ((1 << 30, "G"), (1 << 20, "M"), (1 << 10, "k"), (1, "")):
        shown = F.concat(F.floor(value / step).cast("string"), F.lit(unit))
        out = F.when((value >= step if step > 1 else F.lit(True)) & (F.length(shown) <= width), shown).otherwise(out)
    return F.lpad(out, width, " ")
