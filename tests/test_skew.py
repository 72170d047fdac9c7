import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import diagnosis
from tidewatch.operators.numbering import numbered
from tidewatch.operators.skew import hot_keys, salted_join
from tidewatch.plans import catalog


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the left rows share one key; the right has it, and keys of its own."""
    left = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id"
    )
    right = spark.range(0, 40000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return left, right.union(spark.createDataFrame([(-1, 5)], "k long, v long"))


def test_hot_keys(spark, sides):
    hash_of_hot = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"))).first()[0]
    assert [r[0] for r in spark.range(1).select(hot_keys(sides[0], ["k"])).collect()] == [[hash_of_hot]]
    assert [r[0] for r in spark.range(1).select(hot_keys(sides[1], ["k"])).collect()] == [[]]
    assert [r[0] for r in spark.range(1).select(hot_keys(sides[0].limit(0), ["k"])).collect()] == [[]]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salting_changes_no_result(sides, how):
    left, right = sides
    plain = left.join(right, ["k"], how)
    salted = salted_join(left, right, ["k"], how)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hot_rows_are_spread(spark, sides):
    left, right = sides
    joined = salted_join(left, right.hint("merge"), ["k"], "inner")
    counts = joined.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 10000
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")
    try:
        joined = salted_join(left, right.hint("merge"), ["k"], "inner")
        parts = joined.withColumn("p", F.spark_partition_id()).filter("k = -1").groupBy("p").count().collect()
        assert len(parts) >= 3 and max(r["count"] for r in parts) < 7000
    finally:
        spark.conf.set(conf, "true")


def test_claims_of_one_diagnosis(spark):
    """Half of the claims in one diagnosis, a third of those dangling."""
    claims = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("diagnosis_id"),
        F.col("id").alias("pos"),
        F.concat(F.lit("c"), "id").alias("claim_id"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source_id"),
        F.lit("HIGH").alias("confidence"),
    )
    sources = spark.range(6000).select(
        F.col("id").alias("diagnosis_id"), F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("source_id")
    )
    got = diagnosis.dangling_claims(claims, sources)
    assert sorted(r.pos for r in got.collect()) == [i for i in range(6000) if i % 3 == 2]


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_numbers_within_a_key(spark, bits):
    """A third of all rows share a key; some orders are far apart, negative or null, some keys are null."""
    rng = random.Random(bits)
    orders = rng.sample(range(-5000, 5000), 900) + [2**62, -(2**62), 2**40, 2**40 + 1, None]
    rows = [(rng.choice([0, 0, 1, 2, 3, None]), o, str(o)) for o in orders]
    df = spark.createDataFrame(rows, "k int, o long, n string").repartition(5)
    out = numbered(df, "k", "o", "place", bits)
    assert out.columns == ["k", "o", "n", "place"]
    expected = {}
    for k, o, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        expected[k, o] = sum(1 for key, _ in expected if key == k)
    assert {(r.k, r.o): r.place for r in out.collect()} == expected


def _jobs(spark, build):
    """Jobs that building a query starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_forks_of_one_incident_are_spread(spark, monkeypatch):
    """A third of all diagnoses belong to one incident: no task gets them all."""
    heads = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("incident_id"),
        F.col("id").alias("diagnosis_id"), F.lit("t").alias("anomaly_type"), F.lit("s").alias("summary"),
    )
    claims = spark.range(0, 9000).select(
        F.col("id").alias("diagnosis_id"), F.lit(0).alias("pos"), F.lit("c").alias("claim_id"),
        F.when(F.col("id") == 4500, "HIGH").otherwise("LOW").alias("confidence"),
    )
    monkeypatch.setattr("tidewatch.operators.numbering.numbered.__defaults__", (8,))
    monkeypatch.setattr("tidewatch.operators.diagnosis.FORK_BLOCK_BITS", 8)
    made = []
    assert _jobs(spark, lambda: made.append(diagnosis.forks(numbered(heads, "incident_id", "diagnosis_id", "fork"), claims))) == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = made[0].withColumn("task", F.spark_partition_id()).filter("incident_id = -1").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.fork for r in rows) == list(range(3000))
    assert {(r.primary.diagnosis_id, r.primary.fork, r.fork_count) for r in rows} == {(4500, 1500, 3000)}
    counts = Counter(r.task for r in rows)
    assert len(counts) >= 3 and max(counts.values()) < 2000


def test_building_starts_no_job(spark):
    sf = "/root/testdata/sf0.001"
    names = ["integrity_errors", "incident_integrity", "dangling_claims", "fork_merge_claims", "fork_merge_conflicts", "search_logs_summary", "recent_events_tail", "decode_protobuf"]
    started = {name: _jobs(spark, lambda n=name: catalog.queries()[n](spark, sf)) for name in names}
    # Reading a file's schema is a job of its own.
    schemas = _jobs(spark, lambda: spark.read.parquet(f"{sf}/orders.parquet"))
    tables = {"integrity_errors": 3, "incident_integrity": 3, "dangling_claims": 2, "fork_merge_claims": 3, "fork_merge_conflicts": 3}
    assert all(n <= schemas * tables.get(name, 1) for name, n in started.items()), started


def test_integrity_reads_each_table_once(spark):
    plan = catalog.queries()["integrity_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
