"""Faults that only larger tables, or tables as folders, showed."""

from pyspark.sql import functions as F

from silt.plans import load_all, registry
from silt.streaming import stateful, timed
from tests.compare import duck, rows

load_all()


def same(spark, name, sf_dir):
    df, rel = registry.QUERIES[name](spark, str(sf_dir)), duck(sf_dir).execute(registry.ORACLES[name])
    return rows(df.columns, df.collect()) == rows([d[0] for d in rel.description], rel.fetchall())


def test_streams_read_folders_that_are_named_like_files(spark, tmp_path):
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, "stream_pairing", tmp_path)


def test_streams_without_rows(spark, tmp_path):
    spark.createDataFrame([], "k string, kind string, at long").write.parquet(f"{tmp_path}/none.parquet")
    stream = stateful.pairs(stateful.file_stream(spark, f"{tmp_path}/none.parquet"), "k", "kind", "at", "a", "b")
    assert stateful.run_once(stream, "append", f"{tmp_path}/state", f"{tmp_path}/out").collect() == []


def test_timed_keys_share_states(spark):
    """A key's own call of Python costs about 10 ms, whatever its rows; so calls must not be as many as keys."""
    rows = spark.range(5000).select(F.col("id").alias("k"), F.timestamp_seconds("id").alias("ts"), F.lit("v").alias("v"))
    stream = timed.given_up(rows.sparkSession.readStream.format("rate").load().selectExpr("value AS k", "timestamp AS ts", "'v' AS v"), "k", "ts", "v", 60, "1 minute")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "bucket" in plan
    assert rows.select(F.pmod(F.xxhash64("k"), F.lit(timed.BUCKETS))).distinct().count() <= timed.BUCKETS < 5000
