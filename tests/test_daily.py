"""Statistics kept per day against those of all queries."""

from __future__ import annotations

import datetime
import glob
import os
import random

from pyspark.sql import functions as F

from sqltide.operators import daily, stats
from sqltide.schemas import SLOW_QUERY

START = datetime.datetime(2024, 1, 1)


def queries(spark, n, seed):
    draw = random.Random(seed)
    values = [
        (f"{seed}-{i}", f"p{min(int(draw.expovariate(1.0)), 4)}", START + datetime.timedelta(minutes=draw.randrange(7 * 1440)),
         None if draw.random() < 0.02 else round(draw.lognormvariate(6, 1.5), 3))
        for i in range(n)
    ]
    df = spark.createDataFrame(values, "id string, fingerprint string, captured_at timestamp_ntz, ms double")
    df = df.withColumns({"duration_ms": F.col("ms").cast("decimal(18,3)"), "source_db_type": F.lit("mysql"), "source_db_host": F.lit(None).cast("string")})
    for field in SLOW_QUERY.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*SLOW_QUERY.names)


def test_days_merge_to_the_whole(spark, tmp_path):
    path = str(tmp_path / "days")
    parts = [queries(spark, 6000, seed).cache() for seed in (1, 2, 3)]
    for batch, part in enumerate(parts):
        daily.add_days(part, batch, path)
    daily.add_days(parts[1], 1, path)  # once more, as after a failure
    every = parts[0].union(parts[1]).union(parts[2]).cache()
    days = daily.read_days(spark, path)
    got = {r.fingerprint: r for r in daily.summary_of_days(days).collect()}
    none = spark.createDataFrame([], "id string, slow_query_id string, improvement_level string")
    want = {r.fingerprint: r for r in stats.pattern_summary(every, none).collect()}
    assert set(got) == set(want)
    for name, r in want.items():
        for c in ("id", "execution_count", "avg_duration_ms", "min_duration_ms", "max_duration_ms", "total_duration_ms", "last_seen"):
            assert got[name][c] == r[c], (name, c)
        known = sorted(float(x[0]) for x in every.where(f"fingerprint = '{name}' AND duration_ms IS NOT NULL").select("duration_ms").collect())
        rank = sum(v <= got[name].p95_duration_ms for v in known) / len(known)
        assert abs(rank - 0.95) <= daily.RANK_ERROR + 1 / len(known)
    trend = sorted(tuple(r) for r in daily.trend_of_days(days).collect())
    assert trend == sorted(tuple(r) for r in stats.daily_trend(every, "2024-01-08 00:00:00", 30).collect())


def test_a_batch_touches_its_days_only(spark, tmp_path):
    path = str(tmp_path / "days")
    daily.add_days(queries(spark, 500, 1), 0, path)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    late = queries(spark, 500, 2).where(F.to_date("captured_at") == "2024-01-03")
    daily.add_days(late, 1, path)
    after = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    assert after - set(before) and all("captured_date=2024-01-03" in f for f in after - set(before))


def test_unknown_durations_only(spark, tmp_path):
    q = queries(spark, 5, 1).withColumn("duration_ms", F.lit(None).cast("decimal(18,3)"))
    daily.add_days(q, 0, str(tmp_path / "d"))
    rows = daily.summary_of_days(daily.read_days(spark, str(tmp_path / "d"))).collect()
    assert sum(r.execution_count for r in rows) == 5
    assert all(r.p95_duration_ms is None and r.avg_duration_ms is None for r in rows)
