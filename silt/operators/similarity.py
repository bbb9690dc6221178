"""Similarity joins as block, equi-join, verify; none is a cross join.

Rows of equal value are one class, so a value that a third of all rows share is one row of the join. Pairs come between
the classes' least nodes; every other node of a class comes once more with its least node. No link between different
values is lost, and all pairs follow from the membership.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _members(rows: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    """(a, b): the least node of a class with each of its other nodes."""
    return rows.join(classes.select(value, F.col("v").alias("a")), value).filter("v <> a").select("a", F.col("v").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_bands(bits: int, at_most: int, n: int) -> list[tuple[list[int], int]]:
    """(bit numbers, radius) of up to ``n`` bands of the ones of ``bits``: numbers that differ in ``at_most`` of these differ on one band at least in no more than its radius."""
    ones = [i for i in range(64) if bits >> i & 1]
    n = max(1, min(n, at_most + 1, len(ones)))
    radii = [(at_most + 1 - n) // n + (i >= n - (at_most + 1 - n) % n) for i in range(n)]
    weights = [2 + r for r in radii]  # bands of a greater radius are wider
    cuts = [round(len(ones) * sum(weights[:i]) / sum(weights)) for i in range(n + 1)]
    return [(ones[cuts[i] : cuts[i + 1]], r) for i, r in enumerate(radii)]


def flips(band: list[int], most: int) -> list[int]:
    """Masks of ``most`` bits of a band or fewer."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(band, k)]


def within_band(h: Column, band: list[int]) -> Column:
    return h.bitwiseAND(F.lit(_signed(sum(1 << b for b in band))))


def longs(xs: list[int]) -> Column:
    return F.lit([_signed(x) for x in xs]).cast("array<bigint>")


def hamming_pairs(df: DataFrame, node: str, bits: str, at_most: int, other: DataFrame | None = None, bands: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b whose 64-bit hashes differ in ``at_most`` bits, between classes and with membership (distance 0).

    Bits that are the same in all hashes cannot differ and are left out. The others are cut into ``bands``, of a radius each: a
    pair that close differs on one band at least in no more bits than its radius. Both sides flip about half of that in each
    band, so that they meet; of the ways to meet, and of the bands, the first one counts, so nothing has to be made distinct. Of a
    pair that differs on a band only the hash whose lowest differing bit is 0 is looked up there. With ``other`` (the changed
    rows), only classes with one of them look for others. Null hashes are skipped.
    """
    rows = df.filter(F.col(bits).isNotNull()).select(F.col(node).alias("v"), F.col(bits).cast("long").alias("h"))
    varying = rows.agg(F.bit_or("h").bitwiseXOR(F.bit_and("h"))).first()[0] or 0
    cuts = bit_bands(varying % (1 << 64), at_most, bands or (max(2, at_most // 3 + 1) if at_most else 1))
    classes = rows.groupBy("h").agg(F.min("v").alias("v"))
    if other is None:
        classes = classes.withColumn("on", F.lit(True))
    else:
        changed = other.filter(F.col(bits).isNotNull()).select(F.col(bits).cast("long").alias("h"), F.lit(True).alias("on")).distinct()
        classes = classes.join(changed, "h", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    h = F.col("h")

    def asks(i: int, band: list[int], radius: int) -> Column:
        """(band, part, m1, enough) of the masks of the lower half of the radius; m1 are the lowest bits in which a pair differs."""
        few = (radius + 1) // 2
        masks = flips(band, few)
        mine = longs(masks) if other is not None else F.filter(longs(masks), lambda m, k: h.bitwiseAND(F.get(longs([m & -m for m in masks]), k)) == 0)
        return F.transform(mine, lambda m: F.struct(F.lit(i).alias("band"), within_band(h, band).bitwiseXOR(m).alias("part"), m.alias("m1"), (F.bit_count(m) == few).alias("all1")))

    def holds(i: int, band: list[int], radius: int) -> Column:
        """(band, part, s2) of the masks of the upper half; s2 is a mask's lowest bit and all above it, which m1 must not touch."""
        masks = flips(band, radius // 2)
        spans = longs([(m | -m) % (1 << 64) for m in masks])
        return F.transform(longs(masks), lambda m, k: F.struct(F.lit(i).alias("band"), within_band(h, band).bitwiseXOR(m).alias("part"), F.get(spans, k).alias("s2")))

    every = lambda f: F.inline(F.flatten(F.array(*[f(i, *c) for i, c in enumerate(cuts)])))
    left = classes.filter("on").select(F.col("v").alias("v1"), h.alias("h1"), every(asks))
    right = classes.select(F.col("v").alias("v2"), h.alias("h2"), F.col("on").alias("on2"), every(holds))
    once = (F.col("s2") == 0) | (F.col("all1") & (F.col("m1").bitwiseAND(F.col("s2")) == 0))
    first = (F.col("m1") != 0) & (F.col("s2") == 0) | (F.col("s2") != 0) if other is None else ~F.col("on2")
    apart = F.col("h1").bitwiseXOR(F.col("h2"))
    dealt = lambda df: df.repartition(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "band", "part")  # noqa: E731  the work is in meeting, not in bytes
    near = dealt(left).join(dealt(right), ["band", "part"]).filter(once & (F.bit_count(apart) <= at_most)).filter((F.col("h1") != F.col("h2")) & (first | (F.col("v1") < F.col("v2"))))
    for i, (band, radius) in enumerate(cuts[:-1]):
        near = near.filter((F.col("band") <= i) | (F.bit_count(within_band(apart, band)) > radius))
    found = near.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"), F.bit_count(apart).alias("distance"))
    return found.unionByName(_members(rows, classes.filter("on"), "h").withColumn("distance", F.lit(0)))


def either_pairs(df: DataFrame, node: str, first: str, second: str, at_most: int) -> DataFrame:
    """Pairs that are close in one of two hashes, between classes of either hash and with their memberships."""
    one = hamming_pairs(df, node, first, at_most).select("a", "b")
    return one.union(hamming_pairs(df, node, second, at_most).select("a", "b")).distinct()


def band_pairs(df: DataFrame, node: str, value: str, width: float) -> DataFrame:
    """(a, b) with a < b whose values differ by ``width`` at most, between classes and with membership: buckets of that width, and the next one."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(node).alias("v"), F.col(value).alias("x"))
    classes = rows.groupBy("x").agg(F.min("v").alias("v"))
    dealt = classes.withColumn("bucket", F.floor(F.col("x") / width))
    left = dealt.select(F.col("v").alias("n1"), F.col("x").alias("x1"), "bucket")
    right = dealt.select(F.col("v").alias("n2"), F.col("x").alias("x2"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), F.col("bucket").alias("home"))
    near = left.join(right, "bucket").filter((F.abs(F.col("x1") - F.col("x2")) <= width) & ((F.col("home") != F.col("bucket")) | (F.col("n1") < F.col("n2"))))
    return near.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).union(_members(rows, classes, "x"))


def allowed_edits(length: Column, percent: int) -> Column:
    return F.greatest(F.lit(1), F.floor(length * percent / 100)).cast("int")


def edit_pairs(new: DataFrame, old: DataFrame, name: str, percent: int, size: str | None = None, ratio: int = 10) -> DataFrame:
    """(new, old, edits): names within the edits t that the new name's length allows; sizes over ``ratio`` apart are dropped.

    The old name is cut into t + 1 segments: t edits leave one of them whole, and it stands in the new name at most t places
    away. So names meet on (t, old length, segment number, segment). Verification stops at the limit. Repeated rows count once.
    """
    if not 0 <= percent < 100:
        raise ValueError("percent must be from 0 to 99")
    keep = [size] if size else []
    begin, wide = "CAST(l * i DIV (t + 1) AS int)", "CAST(l * (i + 1) DIV (t + 1) - l * i DIV (t + 1) AS int)"
    looks = f"""flatten(transform(sequence(greatest(0, length(new) - t), length(new) + t), l -> flatten(transform(sequence(0, t), i ->
        transform(array_distinct(transform(filter(sequence({begin} - t, {begin} + t), s -> s >= 0 AND s + {wide} <= length(new)), s -> substring(new, s + 1, {wide}))),
        seg -> struct(t AS t, l AS l, i AS i, seg AS seg))))))"""
    holds = f"""flatten(transform(sequence(greatest(1, CAST(floor(l * {percent} / {100 + percent}) AS int) - 1), CAST(floor((l + 2) * {percent} / {100 - percent}) AS int) + 2), t ->
        transform(sequence(0, t), i -> struct(t AS t, l AS l, i AS i, substring(old, {begin} + 1, {wide}) AS seg))))"""
    n = new.filter(F.col(name).isNotNull()).select(F.col(name).alias("new"), *[F.col(k).alias("new_size") for k in keep]).withColumn("t", allowed_edits(F.length("new"), percent))
    n = n.select("new", *["new_size" for _ in keep], F.inline(F.expr(looks)))
    o = old.filter(F.col(name).isNotNull()).select(F.col(name).alias("old"), *[F.col(k).alias("old_size") for k in keep]).withColumn("l", F.length("old"))
    o = o.select("old", *["old_size" for _ in keep], F.inline(F.expr(holds)))
    near = n.join(o, ["t", "l", "i", "seg"]).withColumn("edits", F.expr("levenshtein(new, old, t)")).filter("edits >= 0")
    if size:
        near = near.filter(F.greatest("new_size", "old_size") <= ratio * F.greatest(F.lit(1), F.least("new_size", "old_size")))
    return near.select("new", "old", "edits").distinct()
