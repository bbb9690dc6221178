"""Joins on few differing bits: what is met, and how seldom what is not close is met."""

import random

from silt.operators import metric, similarity


def test_bands_leave_no_pair_out_and_no_bit_unused():
    for bits in (2**64 - 1, 2**60 - 1, 0b1011, 1, 0):
        for most in range(11):
            bands = similarity.bit_bands(bits, most, max(2, most // 3 + 1))
            assert sorted(b for band, _ in bands for b in band) == [i for i in range(64) if bits >> i & 1]
            assert sum(r + 1 for _, r in bands) == most + 1


def test_constant_bits_do_not_make_a_band(spark):
    """The top 24 bits are the same in all: a band of those alone would let every hash meet every other."""
    rng = random.Random(5)
    hs = [rng.getrandbits(40) - (1 << 63) for _ in range(300)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(40), k)) for h in hs[:100] for k in (1, 5, 10)]
    df = spark.createDataFrame(list(enumerate(hs)), "n long, h long")
    want = {(a, b) for b in range(len(hs)) for a in range(b) if 0 < (hs[a] ^ hs[b]).bit_count() <= 10}
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, "n", "h", 10).collect() if r.distance} == want


def test_lookup_by_keys_finds_all_and_meets_few(spark):
    rng = random.Random(6)
    hs = [rng.getrandbits(64) - (1 << 63) for _ in range(1000)]
    asked = [h ^ sum(1 << b for b in rng.sample(range(63), k)) for h in hs[:40] for k in (0, 3, 6, 7)]
    df, q = spark.createDataFrame([(h,) for h in hs], "h long"), spark.createDataFrame([(h,) for h in asked], "q long")
    index = metric.PivotIndex.of(df, "h", metric.hamming, 8, metric.hamming_keys)
    mask = 2**64 - 1
    want = {(a, h) for a in asked for h in hs if ((a ^ h) & mask).bit_count() <= 6}
    assert {(r.query, r.value) for r in index.within(q, "q", 6).collect()} == want
    assert index.candidates(q, "q", 6).count() < 1000 < metric.PivotIndex.of(df, "h", metric.hamming, 8).candidates(q, "q", 6).count()
