from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from sqltide.operators import (
    dedup, filters, joins, knowledge, learning, ordered, percentile, ranking, similarity, stats,
)
from sqltide.plans import analysis
from sqltide.schemas import FEEDBACK, MYSQL_SLOW_LOG, PG_STAT_STATEMENTS, SLOW_QUERY
from sqltide.sources import ingest, store
from test_analysis import AS_OF, NOW, queries

MINUTE = datetime.timedelta(minutes=1)


def log_rows(spark, texts):
    rows = [
        (NOW + i * MINUTE, "u", datetime.timedelta(seconds=2 + i), None, 1, 10, None if i % 2 else "", t, None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, MYSQL_SLOW_LOG)


def test_ingest_mysql(spark):
    log = log_rows(spark, ["SELECT 1", "", None, " \t", "SELECT 2", "SELECT 'x'"])
    q = ingest.ingest_mysql_slow_log(log, "h", "fallback")
    rows = q.orderBy("captured_at").collect()
    assert [r.full_sql for r in rows] == ["SELECT 1", "SELECT 2", "SELECT 'x'"]
    assert {r.source_db_name for r in rows} == {"fallback"} and {r.fingerprint for r in rows} == {"SELECT ?"}
    assert rows[0].duration_ms == Decimal("2000.000") and rows[0].status == "NEW"
    since = ingest.ingest_mysql_slow_log(log, "h", "d", since=NOW + 4 * MINUTE)
    assert [r.full_sql for r in since.collect()] == ["SELECT 'x'"]
    # the newest rows are cut before blank ones go
    newest = ingest.ingest_mysql_slow_log(log, "h", "d", limit=3)
    assert sorted(r.full_sql for r in newest.collect()) == ["SELECT 'x'", "SELECT 2"]
    binary = log.withColumn("sql_text", F.col("sql_text").cast("binary"))
    again = ingest.ingest_mysql_slow_log(binary, "h", "fallback")
    assert {r.id for r in again.collect()} == {r.id for r in rows}


def test_ingest_postgres(spark):
    rows = [
        (i, q, 2, 1.0, mean, 1.0, 7, 3, 4, 0, None)
        for i, (q, mean) in enumerate(
            [("SELECT a", 1000.0), ("SELECT b", 999.0), ("select PG_Catalog.x", 5000.0), ("SELECT c", 3000.5)]
        )
    ]
    raw = spark.createDataFrame(rows, PG_STAT_STATEMENTS)
    q = ingest.ingest_pg_stat_statements(raw, "h", "d", AS_OF)
    got = {r.full_sql: (float(r.duration_ms), r.rows_examined, r.rows_returned) for r in q.collect()}
    assert got == {"SELECT a": (1000.0, 7, 7), "SELECT c": (3000.5, 7, 7)}
    top = ingest.ingest_pg_stat_statements(raw, "h", "d", AS_OF, limit=1).collect()
    assert [r.full_sql for r in top] == ["SELECT c"]


def test_dedup_is_idempotent(spark):
    q = queries(
        spark, {"sql_hash": "a"}, {"sql_hash": "a"}, {"sql_hash": "b", "fingerprint": "g"},
        {"sql_hash": "a", "duration_ms": Decimal("900.000"), "source_db_host": "h2"},
    )
    empty = spark.createDataFrame([], SLOW_QUERY)
    fresh = dedup.dedup_executions(q, empty)
    assert {r.id for r in fresh.collect()} == {"q0", "q2", "q3"}
    assert dedup.dedup_executions(q, fresh).count() == 0
    patterns = dedup.dedup_patterns(q, empty)
    assert patterns.count() == 3 and dedup.dedup_patterns(q, patterns).count() == 0
    slowest = queries(spark, {}, {"duration_ms": Decimal("101.000")})
    assert [r.id for r in dedup.dedup_patterns(slowest, empty).collect()] == ["q1"]


def test_load_bad_rows_go_to_the_side_column(spark, tmp_path):
    good = '{"id": "a", "rows_examined": 5}'
    (tmp_path / "x.json").write_text(f'{good}\n{{"id": "b", "rows_examined": "many"}}\nnot json\n')
    df = store.load_slow_queries(spark, str(tmp_path / "x.json"), "json", SLOW_QUERY).cache()
    assert df.where(F.col(store.CORRUPT).isNull()).count() == 1
    assert df.where(F.col(store.CORRUPT).isNotNull()).count() == 2
    q = queries(spark, {"full_sql": 'SELECT "a",\n 1'}, {})
    q.write.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    back = store.load_slow_queries(spark, str(tmp_path / "csv"), "csv", SLOW_QUERY)
    assert sorted(r.full_sql for r in back.collect()) == ['SELECT "a",\n 1', "SELECT 1 FROM t"]


def test_rewritten_batch_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    for batch, n in ((1, 3), (2, 4), (2, 4), (2, 2)):
        store.write_results(spark.range(n).withColumn("batch_id", F.lit(batch)), path)
    assert spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(1, 3), (2, 2)]


def quantile(values, fraction):
    values = sorted(values)
    place = (len(values) - 1) * fraction
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


def test_percentile_is_exact_for_skewed_groups(spark):
    rng = random.Random(7)
    groups = {
        "hot": [round(rng.lognormvariate(7, 2), 3) for _ in range(5000)],
        "flat": [5.0] * 300, "one": [42.125], "three": [1.0, 2.0, 10.0], "wide": [0.001, 999999999.999],
    }
    rows = [(k, Decimal(f"{v:.3f}")) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v decimal(12,3)").repartition(8)
    for fraction in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.p for r in percentile.exact_percentile(df, ["k"], "v", fraction, "p").collect()}
        for key, values in groups.items():
            assert got[key] == pytest.approx(quantile(values, fraction), rel=1e-12), (key, fraction)


def test_pattern_summary(spark):
    q = queries(
        spark, {"status": "ANALYZED", "duration_ms": Decimal("1.000")}, {"duration_ms": Decimal("2.000")},
        {"duration_ms": Decimal("10.000"), "captured_at": NOW + MINUTE}, {"fingerprint": "g", "sql_hash": "y"},
    )
    a = analysis.analyze(q, AS_OF).withColumn(
        "improvement_level",
        F.when(F.col("slow_query_id") == "q0", "HIGH").otherwise("MEDIUM"),
    )
    rows = {r.fingerprint: r for r in stats.pattern_summary(q, a).collect()}
    assert sum(r.execution_count for r in rows.values()) == 4
    f = rows["f"]
    # by severity, not by name
    assert f.max_improvement_level == "HIGH" and f.has_analysis and f.id == "q2"
    assert f.p95_duration_ms == pytest.approx(9.2) and f.avg_duration_ms == pytest.approx(13 / 3)
    # the newest execution, whatever the status that is listed
    listed = stats.pattern_summary(q, a, status="ANALYZED").collect()
    assert [(r.execution_count, r.id) for r in listed] == [(1, "q2")]
    slow = stats.pattern_summary(q, a, min_duration_ms=50).collect()
    assert [r.fingerprint for r in slow] == ["g"]
    with pytest.raises(ValueError):
        ranking.page_patterns(stats.pattern_summary(q, a), page=0)


def test_empty_tables(spark):
    q = spark.createDataFrame([], SLOW_QUERY)
    a = analysis.analyze(q, AS_OF)
    assert stats.global_totals(q).first().total_slow_queries == 0
    assert stats.analyzer_status(q, a).first().total == 0
    assert stats.pattern_summary(q, a).count() == 0


def test_analyzer_status_leaves_out_ignored_and_critical(spark):
    q = queries(spark, {}, {"status": "IGNORED"}, {"status": "ERROR"})
    a = analysis.analyze(q, AS_OF).withColumn("improvement_level", F.lit("CRITICAL"))
    row = stats.analyzer_status(q, a).first()
    assert (row.pending, row.error, row.total) == (1, 1, 2)
    assert (row.analyses_total, row.high_impact, row.low_impact) == (3, 0, 0)


def test_previous_row_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(400), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(16)
    got = ordered.with_previous(df, ["k"], ["t", "id"], "id", "prev").collect()
    last, want = {}, {}
    for key, t, i in sorted(rows):
        want[i] = last.get(key)
        last[key] = i
    assert {r.id: r.prev for r in got} == want


def test_query_detail_and_delete(spark):
    q = queries(spark, {}, {})
    a = analysis.analyze(q.where("id = 'q0'"), AS_OF)
    assert filters.query_detail(q, a, "q0").first().analysis.problem == "Slow query detected"
    assert filters.query_detail(q, a, "q1").first().analysis is None
    left, kept = filters.delete_queries(q, a, q.where("id = 'q0'"))
    assert [r.id for r in left.collect()] == ["q1"] and kept.count() == 0


def timeline(spark):
    """One old slow execution, then later ones of one pattern."""
    later = [Decimal(str(d)) for d in (900, 100, 100, 100, 100, 100)]
    return queries(
        spark, {"status": "ANALYZED", "duration_ms": Decimal("1000")},
        *[{"duration_ms": d, "captured_at": NOW + (11 + i) * MINUTE} for i, d in enumerate(later)],
        {"duration_ms": Decimal("1"), "captured_at": NOW + 10 * MINUTE},
    )


def test_effectiveness(spark):
    q = timeline(spark)
    a = analysis.analyze(q.where("id = 'q0'"), AS_OF)
    row = learning.evaluate_effectiveness(a, q).first()
    # the newest five alone, each strictly later than the tolerance
    assert (row.effectiveness, row.gain_ratio, row.new_duration_ms) == ("CONFIRMED", 0.9, 100.0)
    assert learning.evaluate_effectiveness(a, q, min_obs=6, last_n=9).first().new_duration_ms is not None
    waiting = learning.evaluate_effectiveness(a, q, min_obs=7, last_n=9).first()
    assert waiting.effectiveness == "PENDING" and waiting.gain_ratio is None
    failed = learning.evaluate_effectiveness(a, q.withColumn(
        "duration_ms", F.when(F.col("id") == "q0", F.lit(50)).otherwise(F.col("duration_ms")).cast("decimal(12,3)")
    )).first()
    assert failed.effectiveness == "FAILED" and failed.gain_ratio < 0
    done = a.withColumn("effectiveness", F.lit("FAILED"))
    assert learning.evaluate_effectiveness(done, q).first().new_duration_ms is None


def test_feedback_is_idempotent(spark):
    q = timeline(spark)
    measured = learning.evaluate_effectiveness(analysis.analyze(q.where("id = 'q0'"), AS_OF), q)
    none = spark.createDataFrame([], FEEDBACK)
    rows = learning.append_feedback(measured, none, AS_OF)
    assert rows.count() == 1
    assert learning.append_feedback(measured, rows, "2024-02-01 00:29:00").count() == 0
    assert learning.append_feedback(measured, rows, "2024-02-01 00:31:00").count() == 1
    backlog = knowledge.build_backlog(q, measured, rows)
    case = backlog.first()
    assert case.full_sql == "SELECT ? FROM table_1" and case.gain_ratio == 0.9
    again = knowledge.build_backlog(q, measured, rows, backlog)
    assert again.count() == 1
    line = knowledge.training_rows(backlog).first()
    assert line.output.gain_ratio == 0.9 and line.input.db_type == "mysql"


def test_export_writes_json_lines(spark, tmp_path):
    q = timeline(spark)
    measured = learning.evaluate_effectiveness(analysis.analyze(q.where("id = 'q0'"), AS_OF), q)
    none = spark.createDataFrame([], FEEDBACK)
    backlog = knowledge.build_backlog(q, measured, learning.append_feedback(measured, none, AS_OF))
    knowledge.export_training_dataset(backlog, str(tmp_path / "out"), 0.5)
    assert spark.read.json(str(tmp_path / "out")).first().output.gain_ratio == 0.9
    knowledge.export_training_dataset(backlog, str(tmp_path / "out"), 0.95)
    assert spark.read.text(str(tmp_path / "out")).count() == 0


def cases(spark, n, rng):
    words = [f"w{i}" for i in range(14)]
    rows = {}
    for i in range(n):
        chosen = rng.sample(words, rng.randrange(1, 8))
        rows[(" ".join(chosen), rng.choice(["mysql", "postgres"]))] = (f"p{i % 3}", rng.randrange(100) / 100)
    return spark.createDataFrame(
        [(f"c{i}", f, t, None, p, None, g) for i, ((f, t), (p, g)) in enumerate(rows.items())],
        "id string, fingerprint string, db_type string, plan_json string, problem string, "
        "suggestions array<struct<type:string>>, gain_ratio double",
    ).cache()


def nearest(new, known, limit, min_sim):
    """Brute force over all pairs of the small fixture."""
    result = set()
    for n in new:
        mine = set(n.fingerprint.split())
        found = []
        for c in known:
            theirs = set(c.fingerprint.split())
            sim = len(mine & theirs) / len(mine | theirs)
            if c.db_type == n.db_type and sim >= min_sim - 1e-9:
                found.append((-sim, -c.gain_ratio, c.fingerprint))
        for rank, (sim, _, text) in enumerate(sorted(found)[:limit], start=1):
            result.add((n.fingerprint, n.db_type, rank, text, round(-sim, 9)))
    return result


@pytest.mark.parametrize(("limit", "min_sim"), [(5, 0.5), (2, 0.3), (3, 1.0)])
def test_similar_cases_match_brute_force(spark, limit, min_sim):
    new, known = cases(spark, 60, random.Random(1)), cases(spark, 150, random.Random(2))
    got = {
        (r.fingerprint, r.db_type, r["rank"], r.case_fingerprint, round(r.similarity, 9))
        for r in similarity.similar_cases(new, known, limit, min_sim).collect()
    }
    assert got == nearest(new.collect(), known.collect(), limit, min_sim)


def test_components(spark):
    rng = random.Random(5)
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    rng.shuffle(chain)
    star = [("hub", f"leaf{i}") for i in range(40)]
    names = {x for e in chain + star for x in e} | {"alone"}
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    edges = spark.createDataFrame(chain + star, "a string, b string")
    got = {r.node: r.component for r in similarity.connected_components(nodes, edges).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"}
    assert {got[x] for x in names if x.startswith(("hub", "leaf"))} == {"hub"} and got["alone"] == "alone"


def test_clusters_join_copies(spark):
    rows = [(f"c{i}", " ".join(w), "mysql", None, "p", None, 0.5) for i, w in enumerate(
        [["a", "b", "c"], ["c", "b", "a"], ["b", "a", "c"], ["x", "y"]])]
    df = spark.createDataFrame(rows, cases(spark, 1, random.Random(0)).schema)
    got = {r.id: r.cluster for r in similarity.case_clusters(df).collect()}
    assert got["c0"] == got["c1"] == got["c2"] != got["c3"]


def test_clusters_do_not_depend_on_copies(spark):
    one = [f"w{i}" for i in range(20)]
    other = one[:18] + ["x", "y"]  # similarity 18 / 22
    found = []
    for copies in (2, 7):
        rows = [
            (f"{side}{i}", " ".join(words[i:] + words[:i]), "mysql", None, "p", None, 0.5)
            for side, words in (("a", one), ("b", other)) for i in range(copies)
        ]
        df = spark.createDataFrame(rows, cases(spark, 1, random.Random(0)).schema)
        found.append(len({r.cluster for r in similarity.case_clusters(df).collect()}))
    assert found == [1, 1]


def test_rows_that_do_not_fit(spark):
    long = datetime.timedelta(days=34)
    log = spark.createDataFrame([(NOW, "u", long, None, 1, 10, "d", "SELECT 1", None)], MYSQL_SLOW_LOG)
    assert ingest.ingest_mysql_slow_log(log, "h", "d").first().duration_ms == Decimal("2937600000.000")
    stats_rows = [(1, "SELECT a", 2, 1.0, mean, 1.0, 7, 3, 4, 0, plan) for mean, plan in ((2e9, '[ {"a": 1} ]'), (1e30, "[1, 2]"))]
    got = ingest.ingest_pg_stat_statements(spark.createDataFrame(stats_rows, PG_STAT_STATEMENTS), "h", "d", AS_OF)
    assert {(r.duration_ms, r.plan_json) for r in got.collect()} == {(Decimal("2000000000.000"), '{"a": 1}'), (None, "[1, 2]")}


def test_pattern_summary_with_nulls(spark):
    q = queries(
        spark, {"duration_ms": Decimal("100.000")}, {"duration_ms": None}, {"duration_ms": Decimal("300.000")},
        {"source_db_host": None}, {"source_db_host": None, "fingerprint": None, "sql_hash": None, "duration_ms": None},
    )
    none = analysis.analyze(q.limit(0), AS_OF)
    rows = {(r.fingerprint, r.source_db_host): r for r in stats.pattern_summary(q, none).collect()}
    row = rows["f", "h"]
    assert (row.execution_count, row.avg_duration_ms, row.p95_duration_ms) == (3, 200.0, pytest.approx(290.0))
    assert rows["f", None].p95_duration_ms == 100.0
    assert rows[None, None].execution_count == 1 and rows[None, None].avg_duration_ms is None


def test_schema_context_and_metadata(spark):
    q = queries(spark, {"full_sql": "SELECT 1 FROM t JOIN u ON 1 = 1"}, {"full_sql": "SELECT 1 FROM nowhere"}, {"full_sql": "SELECT 1"})
    meta = spark.createDataFrame(
        [("mysql", "h", "d", NOW, [("t", 1)], [("t", "old")]),
         ("mysql", "h", "d", NOW + MINUTE, [("t", 5), ("u", 6)], [("t", "b"), ("t", "a")])],
        "source_db_type string, source_db_host string, source_db_name string, captured_at timestamp_ntz, "
        "tables array<struct<name:string,row_count:bigint>>, indexes array<struct<table:string,name:string>>",
    )
    got = joins.schema_context(q, store.latest_db_metadata(meta)).collect()
    found = {r.id: [(e.table_name, e.row_count, e.indexes) for e in r.schema_context] for r in got}
    assert found == {"q0": [("t", 5, ["a", "b"]), ("u", 6, [])], "q1": [("nowhere", None, None)], "q2": []}


class Session:
    """As much of a session as the choice of the shared folder asks for."""

    def __init__(self, master, folder):
        self.conf = self.sparkContext = self
        self.master, self.folder = master, folder

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder


def test_shared_folder():
    assert store.shared_folder(Session("spark://host", "hdfs://store/folder/")) == "hdfs://store/folder"
    assert store.shared_folder(Session("local[2]", None)).startswith("/tmp/run-")
    with pytest.raises(ValueError):
        store.shared_folder(Session("spark://host", None))


def test_unknown_durations_do_not_block_a_measurement(spark):
    q = spark.createDataFrame(
        [("a", "p", NOW, Decimal(100)), ("b", "p", NOW + 20 * MINUTE, Decimal(10)), ("c", "p", NOW + 30 * MINUTE, None)]
        + [(f"n{i}", "p", NOW + (40 + i) * MINUTE, None) for i in range(7)],
        "id string, fingerprint string, captured_at timestamp_ntz, duration_ms decimal(18,3)",
    )
    a = spark.createDataFrame(
        [("x", "a", "PENDING", None)], "id string, slow_query_id string, effectiveness string, gain_ratio double"
    )
    got = learning.evaluate_effectiveness(a, q).first()
    assert (got.effectiveness, got.new_duration_ms, got.gain_ratio) == ("CONFIRMED", 10.0, 0.9)


def test_places_and_ranks_by_piece(spark):
    draw = random.Random(3)
    values = [(i, draw.choice([None, 1.0, 2.0, 2.5, 7.0])) for i in range(500)]
    df = spark.createDataFrame(values, "id int, v double").repartition(6)
    by = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r.place: r.id for r in ordered.numbered(df, by, "place").collect()}
    assert [got[i + 1] for i in range(500)] == [i for i, _ in want]
    page = ordered.numbered(df, by, "place", 101, 130).orderBy("place").collect()
    assert [(r.place, r.id) for r in page] == [(i + 1, want[i][0]) for i in range(100, 130)]
    assert ordered.numbered(df, by, "place", 501, 600).collect() == []
    ranks = {r.id: r["rank"] for r in ordered.dense_ranked(df, F.col("v").desc_nulls_last(), "v", "rank").collect()}
    place = {7.0: 1, 2.5: 2, 2.0: 3, 1.0: 4, None: 5}
    assert ranks == {i: place[v] for i, v in values}
    assert ordered.dense_ranked(df.limit(0), F.col("v").desc(), "v", "rank").collect() == []


def test_similar_cases_with_cut_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_BLOCK", 3)
    new, known = cases(spark, 60, random.Random(1)), cases(spark, 150, random.Random(2))
    got = {
        (r.fingerprint, r.db_type, r["rank"], r.case_fingerprint, round(r.similarity, 9))
        for r in similarity.similar_cases(new, known, 4, 0.4).collect()
    }
    assert got == nearest(new.collect(), known.collect(), 4, 0.4)


def written_records(spark, job):
    """Rows that the shuffles of a job write."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    job()
    context.setJobGroup("others", "others")
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("counted")]
    stages = {s for j in jobs for s in j.stageIds}
    written = 0
    for stage in stages:
        try:
            written += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Py4JJavaError:  # one that was skipped wrote nothing
            pass
    return written


def fields(spark, n, rng, tail):
    """Patterns of few words in few places: no word is rare."""
    rows = {
        f"SELECT n{rng.randrange(8)} FROM b{rng.randrange(8)} JOIN t{rng.randrange(5)} ON id WHERE s{rng.randrange(8)} AND {tail}"
        for _ in range(n)
    }
    return spark.createDataFrame(
        [(f"c{i}", f, "mysql", None, "p", None, rng.randrange(100) / 100) for i, f in enumerate(sorted(rows))],
        cases(spark, 1, random.Random(0)).schema,
    )


def test_similar_cases_move_few_pairs(spark, monkeypatch):
    """1,000 patterns and cases, each word in an eighth of them: 125 cases share a word, five count."""
    new, known = fields(spark, 1200, random.Random(1), "x y z"), fields(spark, 1200, random.Random(2), "x")
    monkeypatch.setattr(similarity, "_FEW", 0, raising=False)
    found = []
    moved = written_records(spark, lambda: found.extend(similarity.similar_cases(new, known).collect()))
    sets = new.count() + known.count()
    got = {(r.fingerprint, r["rank"]): (r.case_fingerprint, round(r.similarity, 9)) for r in found}
    lowered = {f.lower(): f for f in (r.fingerprint for r in [*new.collect(), *known.collect()])}
    low = lambda df: df.withColumn("fingerprint", F.lower("fingerprint")).collect()
    want = {(lowered[n], rank): (lowered[c], sim) for n, _, rank, c, sim in nearest(low(new)[:60], low(known), 5, 0.5)}
    assert {k: got[k] for k in want} == want
    assert moved < 45 * sets


@pytest.mark.parametrize(
    ("gain", "block", "depth", "sizes", "few"), [(0.01, 2, 3, 100, 1e9), (0.01, 50, 8, 0, 0), (1e9, 5, 8, 100, 0)]
)
def test_similar_cases_by_short_and_long_keys(spark, monkeypatch, gain, block, depth, sizes, few):
    """Sets of 1 to 30 words, dense groups among them."""
    for name, value in (("_GAIN", gain), ("_BLOCK", block), ("_DEPTH", depth), ("_SIZES", sizes), ("_FEW", few)):
        monkeypatch.setattr(similarity, name, value)
    draw, made = random.Random(4), []
    words = [f"w{i}" for i in range(45)]
    base = draw.sample(words, 22)
    for n in (70, 130):
        texts = {" ".join(draw.sample(words, draw.randrange(1, 31))) for _ in range(n)}
        texts |= {" ".join([*draw.sample(base, draw.randrange(14, 23)), f"own{draw.randrange(9)}"]) for _ in range(n)}
        rows = [
            (f"c{i}", t, draw.choice(["mysql", "postgres"]), None, "p", None, draw.randrange(10) / 10)
            for i, t in enumerate(sorted(texts))
        ]
        made.append(spark.createDataFrame(rows, cases(spark, 1, random.Random(0)).schema))
    new, known = made
    got = {
        (r.fingerprint, r.db_type, r["rank"], r.case_fingerprint, round(r.similarity, 9))
        for r in similarity.similar_cases(new, known, 3, 0.4).collect()
    }
    assert got == nearest(new.collect(), known.collect(), 3, 0.4)


def test_similar_cases_of_nothing(spark):
    some = cases(spark, 5, random.Random(1))
    assert similarity.similar_cases(some.limit(0), some).collect() == []
    assert similarity.similar_cases(some, some.limit(0)).collect() == []
    other = some.withColumn("db_type", F.lit("other"))
    assert similarity.similar_cases(some, other).collect() == []
    with pytest.raises(ValueError):
        similarity.similar_cases(some, some, 5, 0.0)


@pytest.mark.parametrize("hubs", [1, 4])
def test_clusters_match_brute_force_without_all_pairs(spark, monkeypatch, hubs):
    """Dense groups, chains and single cases: links stay in proportion to the sets."""
    monkeypatch.setattr(similarity, "_HUBS", hubs)
    draw, texts = random.Random(8), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(12)]
        texts += [" ".join(base + [f"x{draw.randrange(10**6)}" for _ in range(draw.randrange(6))]) for _ in range(120)]
    texts += [" ".join(f"c{i + j}" for j in range(8)) for i in range(0, 60, 2)] + [f"alone{i}" for i in range(10)]
    texts = list(dict.fromkeys(texts))
    rows = [(f"c{i}", t, "mysql", None, "p", None, 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, cases(spark, 1, random.Random(0)).schema)
    counted, plain = [], similarity._spanning_links

    def spy(*args):
        links = plain(*args)
        counted.append(links.count())
        return links

    monkeypatch.setattr(similarity, "_spanning_links", spy)
    got = {r.id: r.cluster for r in similarity.case_clusters(df).collect()}
    sets, root = [set(t.split()) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(sets)):
        for j in range(i):
            if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j]):
                pairs += 1
                low, high = sorted((top(i), top(j)))
                root[high] = low
    least = {}
    for i, t in enumerate(texts):
        least[top(i)] = min(least.get(top(i), "~"), f"mysql|{t}")
    assert got == {f"c{i}": least[top(i)] for i in range(len(texts))}
    if hubs > 1:
        assert counted[0] < pairs


def test_global_stats_of_nothing(spark):
    q, a = queries(spark), spark.createDataFrame([], "improvement_level string")
    row = stats.global_stats(q, a, AS_OF).first()
    assert (row.total_slow_queries, row.databases_monitored, row.top_tables, row.recent_trend) == (0, 0, [], [])
    levels = spark.createDataFrame([("HIGH",), ("free text",), (None,), ("",)], "improvement_level string")
    found = stats.global_stats(q, levels, AS_OF).first().improvement_summary
    assert {r.improvement_level: r["count"] for r in found} == {"HIGH": 1, "OTHER": 1, "UNKNOWN": 2}
