"""Table-valued functions, for lateral joins in SQL and of DataFrames; values cross to Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class _Numbers:
    """(pos, value) of each line of a text that is a number. ``policy`` says what another line is: "skip" leaves it out, "zero" makes it 0, "stop" ends there, "raise" fails."""

    def eval(self, text: str, policy: str) -> Iterator[tuple[int, float]]:
        if policy not in ("skip", "zero", "stop", "raise"):
            raise ValueError(f"unknown policy {policy!r}")
        for pos, line in enumerate((text or "").split("\n") if text is not None else ()):
            try:
                yield pos, float(line)
            except ValueError:
                if policy == "raise":
                    raise ValueError(f"line {pos} is no number: {line[:80]!r}") from None
                if policy == "stop":
                    return
                if policy == "zero":
                    yield pos, 0.0


class _Bins:
    """(bin, low, high) of ``n`` bins of equal width from ``lo`` to ``hi``; none for nulls or an empty range."""

    def eval(self, lo: float, hi: float, n: int) -> Iterator[tuple[int, float, float]]:
        if None in (lo, hi, n) or not lo < hi:
            return
        for k in range(n):
            yield k, lo + (hi - lo) * k / n, lo + (hi - lo) * (k + 1) / n


numbers_of = F.udtf(_Numbers, returnType="pos bigint, value double", useArrow=True)
bins_of = F.udtf(_Bins, returnType="bin int, low double, high double", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as ``numbers_of`` and ``bins_of``."""
    spark.udtf.register("numbers_of", numbers_of)
    spark.udtf.register("bins_of", bins_of)
