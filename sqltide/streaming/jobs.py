"""Structured Streaming: ingest, de-duplicate, analyse, trend and run history.

One polling cycle of a collector becomes one micro-batch.  Use
``processing_time`` triggers in operation; without one a query takes all
files that are there and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from sqltide.operators.dedup import EXECUTION_KEY, dedup_executions, dedup_patterns, first_per_key
from sqltide.operators.stats import SOURCE
from sqltide.plans.analysis import analyze, analyze_answered
from sqltide.plans.replies import with_best_reply
from sqltide.schemas import MYSQL_SLOW_LOG, PG_STAT_STATEMENTS, SLOW_QUERY
from sqltide.sources.ingest import ingest_mysql_slow_log, ingest_pg_stat_statements
from sqltide.sources.store import durable, write_results

_CAPTURED = "captured_at"
_DAY = "captured_date"
_BUCKET = "bucket"
BUCKETS = 256  # of a store of patterns


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_ingest(
    spark: SparkSession,
    path: str,
    host: Column | str,
    default_db: str,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Slow-log extract files, as they arrive, to slow-query rows."""
    raw = read_files(spark, path, MYSQL_SLOW_LOG, fmt, max_files)
    return ingest_mysql_slow_log(raw, host, default_db)


def stream_snapshots(
    spark: SparkSession,
    path: str,
    host: Column | str,
    db: str,
    captured_at: Column | str | datetime | None = None,
    fmt: str = "parquet",
    max_files: int | None = None,
    min_duration_ms: float = 1000.0,
) -> DataFrame:
    """Snapshots of statement statistics, as they arrive, to slow-query rows.

    Each snapshot has its own time: that of its rows' ``captured_at``, and where
    an extract has none, the time its file was written.
    """
    schema = T.StructType([*PG_STAT_STATEMENTS.fields, T.StructField(_CAPTURED, T.TimestampNTZType())])
    raw = read_files(spark, path, schema, fmt, max_files)
    if captured_at is None:
        written = to_naive(F.col("_metadata.file_modification_time"))
        raw = raw.withColumn(_CAPTURED, F.coalesce(F.col(_CAPTURED), written))
        captured_at = F.col(_CAPTURED)
    return ingest_pg_stat_statements(raw, host, db, captured_at, min_duration_ms)


def _epoch() -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))


def to_instant(moment: Column) -> Column:
    """A naive UTC time as a point in time, whatever the session's time zone."""
    return F.timestamp_micros(F.lit(0)) + (moment - _epoch())


def to_naive(instant: Column) -> Column:
    """The inverse of ``to_instant``."""
    return _epoch() + (instant - F.timestamp_micros(F.lit(0)))


def _event_time(rows: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    if isinstance(rows.schema[_CAPTURED].dataType, T.TimestampNTZType):
        return rows.withColumn(_CAPTURED, to_instant(F.col(_CAPTURED)))
    return rows


def stream_dedup(rows: DataFrame, horizon: str = "1 day") -> DataFrame:
    """First arrival of each execution.

    ``horizon`` bounds the state: equal executions are found when their times
    lie within it, and rows older than it are dropped.  For no such bound use
    ``dedup_into_store``.
    """
    unique = (
        _event_time(rows)
        .withWatermark(_CAPTURED, horizon)
        .dropDuplicatesWithinWatermark(list(EXECUTION_KEY))
    )
    return unique.withColumn(_CAPTURED, to_naive(F.col(_CAPTURED)))


def _start(writer, checkpoint: str, processing_time: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    return writer.trigger(availableNow=True).start()


def each_batch(
    rows: DataFrame,
    action: Callable[[DataFrame, int], None],
    checkpoint: str,
    processing_time: str | None = None,
) -> StreamingQuery:
    return _start(rows.writeStream.foreachBatch(action), checkpoint, processing_time)


def to_files(
    rows: DataFrame, path: str, checkpoint: str, processing_time: str | None = None
) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, processing_time)


def replace_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    # A batch that runs again after a failure overwrites its own rows only.
    write_results(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), path)


def _others(
    spark: SparkSession, path: str, schema: T.StructType, batch_id: int, split: T.StructField
) -> DataFrame:
    """Stored rows of earlier batches, without those of this batch's failed attempt."""
    added = [split, T.StructField("batch_id", T.LongType())]
    try:
        stored = spark.read.schema(T.StructType([*schema.fields, *added])).parquet(path)
    except Exception as error:  # the first batch finds no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, split]))
    return stored.where(F.col("batch_id") != batch_id).drop("batch_id")


def _store_by_day(rows: DataFrame, batch_id: int, path: str) -> None:
    """A batch that runs again writes the same days and replaces its own rows."""
    (
        rows.withColumns({_DAY: F.to_date(_CAPTURED), "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_DAY, "batch_id")
        .parquet(path)
    )


def dedup_into_store(
    rows: DataFrame, path: str, checkpoint: str, processing_time: str | None = None
) -> StreamingQuery:
    """Stores executions the table does not hold yet, however old they are.

    Equal executions have equal times, so a batch is compared with the stored
    days of its own range only.
    """

    def action(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*SLOW_QUERY.names)
        first, last = batch.agg(
            F.min(F.to_date(_CAPTURED)), F.max(F.to_date(_CAPTURED))
        ).first()
        store = _others(batch.sparkSession, path, SLOW_QUERY, batch_id, T.StructField(_DAY, T.DateType()))
        if first is not None:
            # Rows without a time match each other as well.
            inside = F.col(_DAY).between(F.lit(first), F.lit(last)) | F.col(_DAY).isNull()
            store = store.where(inside)
        _store_by_day(dedup_executions(batch, store), batch_id, path)

    return each_batch(rows, action, checkpoint, processing_time)


def patterns_into_store(
    rows: DataFrame, path: str, checkpoint: str, processing_time: str | None = None
) -> StreamingQuery:
    """Stores patterns the table does not hold yet: one row per statement and source.

    The table is cut into buckets of statements; a batch reads the buckets of
    its own statements, and of these the columns that name a pattern.
    """
    place = F.pmod(F.xxhash64("sql_hash"), F.lit(BUCKETS)).cast("int")

    def action(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*SLOW_QUERY.names).withColumn(_BUCKET, place)
        # At most one row per bucket.
        own = [r[0] for r in batch.select(_BUCKET).distinct().collect()]
        store = _others(batch.sparkSession, path, SLOW_QUERY, batch_id, T.StructField(_BUCKET, T.IntegerType()))
        fresh = dedup_patterns(batch, store.where(F.col(_BUCKET).isin(own)))
        (
            fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_BUCKET, "batch_id")
            .parquet(path)
        )

    return each_batch(rows, action, checkpoint, processing_time)


def _batch_time() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def stream_analyze(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    as_of: Column | str | datetime | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Analysis results of every arriving query, each batch stored exactly once.

    They carry the time of their batch unless ``as_of`` says otherwise.
    """

    def action(batch: DataFrame, batch_id: int) -> None:
        replace_batch(analyze(batch, _batch_time() if as_of is None else as_of), batch_id, path)

    return each_batch(rows, action, checkpoint, processing_time)


_TOLD = T.StructType(
    [
        T.StructField("slow_query_id", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("arrived_at", T.TimestampNTZType()),
    ]
)


def _near(wait: str) -> Column:
    length = F.expr(f"interval {wait}")
    inside = F.col("arrived_at").between(F.col(_CAPTURED) - length, F.col(_CAPTURED) + length)
    return (F.col("id") == F.col("slow_query_id")) & inside


def with_replies(queries: DataFrame, told: DataFrame, wait: str, over: Column) -> DataFrame:
    """Each query with its ``reply`` that one batch adds, or with null when it is over without one.

    A reply belongs to a query when it arrived within ``wait`` of its capture
    time, before or after.  ``fresh`` marks the rows of the batch, on both
    sides; what earlier batches held met before, and ``met`` marks queries that
    had a reply then.  Of several replies each gives a row.
    """
    new = told.withColumn("_told", F.col("fresh")).drop("fresh")
    joined = queries.join(new, _near(wait), "left")
    added = F.col("_told") | (F.col("_told").isNotNull() & F.col("fresh"))
    alone = F.col("_told").isNull() & ~F.col("met") & over
    return joined.where(F.coalesce(added, F.lit(False)) | alone).drop(
        "slow_query_id", "arrived_at", "_told", "met", "fresh"
    )


def _before(time: Column, moment: str | None, length: str) -> Column:
    """Whether a time is more than a length before a moment; rows without a time never are."""
    if moment is None:
        return F.lit(False)
    return F.coalesce(time < F.lit(moment).cast("timestamp_ntz") - F.expr(f"interval {length}"), F.lit(False))


def stream_answered(
    rows: DataFrame,
    replies: DataFrame,
    path: str,
    checkpoint: str,
    wait: str = "1 hour",
    late_by: str = "10 minutes",
    as_of: Column | str | datetime | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Analysis results with the replies that arrive in time laid over them.

    ``replies`` has ``slow_query_id``, ``reply`` and ``arrived_at``.  A query
    without a reply gets its result once none can come any more: both sides have
    rows later than ``wait`` and ``late_by`` after it, and rows so late
    themselves are dropped.  What can still meet later rows is kept as a table
    beside the checkpoint, none of it in memory; a batch that runs again finds
    that of the batch before it.  Replies to one query that come in one batch
    are merged; later ones give a further result of the same id, of which
    ``latest_results`` takes the best.
    """
    naive = lambda df, c: F.col(c) if isinstance(df.schema[c].dataType, T.TimestampNTZType) else to_naive(F.col(c))
    queries = rows.withColumn(_CAPTURED, naive(rows, _CAPTURED))
    told = replies.withColumn("arrived_at", naive(replies, "arrived_at")).select(*_TOLD.names)
    query, answer = F.struct(*queries.columns), F.struct(*told.columns)
    both = queries.select(query.alias("query")).unionByName(told.select(answer.alias("told")), allowMissingColumns=True)
    flags = [T.StructField("fresh", T.BooleanType()), T.StructField("met", T.BooleanType())]
    held_schemas = {
        "queries": T.StructType([*queries.schema.fields, *flags]),
        "replies": T.StructType([*_TOLD.fields, flags[0]]),
        "times": T.StructType([T.StructField(c, T.StringType()) for c in (_CAPTURED, "arrived_at")]),
    }

    def held(batch_id: int, name: str) -> str:
        return f"{checkpoint}/held/{batch_id % 3}/{name}"

    def action(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {
            name: spark.read.schema(schema).parquet(held(batch_id - 1, name))
            if batch_id
            else spark.createDataFrame([], schema)
            for name, schema in held_schemas.items()
        }
        seen = before["times"].unionByName(
            batch.select(
                F.col(f"query.{_CAPTURED}").cast("string").alias(_CAPTURED),
                F.col("told.arrived_at").cast("string").alias("arrived_at"),
            )
        )
        latest = [F.max(F.col(c).cast("timestamp_ntz")) for c in (_CAPTURED, "arrived_at")]
        # Time moves on as the slower side does.
        slower = F.when(latest[0].isNotNull() & latest[1].isNotNull(), F.least(*latest)).cast("string")
        start = before["times"].agg(slower).first()[0]
        *times, now = seen.agg(*[c.cast("string") for c in latest], slower).first()
        late = {c: _before(F.col(c), start, late_by) for c in (_CAPTURED, "arrived_at")}
        own = batch.where("query IS NOT NULL").select("query.*").where(~late[_CAPTURED])
        asked = before["queries"].unionByName(own.withColumns({"fresh": F.lit(True), "met": F.lit(False)}))
        arrived = batch.where("told IS NOT NULL").select("told.*").where(~late["arrived_at"])
        answers = before["replies"].unionByName(arrived.withColumn("fresh", F.lit(True)))
        over = _before(F.col(_CAPTURED) + F.expr(f"interval {wait}"), now, late_by)
        answered = with_replies(asked, answers, wait, over)
        moment = _batch_time() if as_of is None else as_of
        replace_batch(analyze_answered(with_best_reply(answered), moment), batch_id, path)
        # A reply that a kept query has is at most twice the wait before now.
        length = F.expr(f"interval {wait}")
        kept = durable(asked.where(~over))
        recent = durable(answers.where(~_before(F.col("arrived_at") + length + length, now, late_by)))
        met = kept.join(recent.drop("fresh"), _near(wait), "left_semi").withColumn("met", F.lit(True))
        alone = kept.join(recent.drop("fresh"), _near(wait), "left_anti")
        left = recent.where(~_before(F.col("arrived_at") + length, now, late_by))
        for name, part in (("queries", met.unionByName(alone)), ("replies", left)):
            flagged = part.withColumn("fresh", F.lit(False))
            flagged.write.mode("overwrite").parquet(held(batch_id, name))
        spark.createDataFrame([times], held_schemas["times"]).write.mode("overwrite").parquet(
            held(batch_id, "times")
        )

    return each_batch(both, action, checkpoint, processing_time)


def latest_results(results: DataFrame) -> DataFrame:
    """One stored result per id: the one with the highest confidence, of equal ones the last."""
    best = [F.col("confidence_score").desc_nulls_last(), F.col("batch_id").desc()]
    return first_per_key(results, ["id"], best).drop("batch_id")


def trend_into_store(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    window: str = "1 day",
    slide: str | None = None,
    late_by: str = "1 day",
    by: Sequence[str] = (),
    processing_time: str | None = None,
) -> StreamingQuery:
    """Stores, for every batch, the windows that it changed; ``current_trend`` reads the newest state of each.

    Windows are there as soon as they have a row, so at the end of the input
    none is missing; ``late_by`` bounds what is held, as in ``stream_trend``.
    """
    trend = stream_trend(rows, window, slide, None, late_by, by)

    def action(batch: DataFrame, batch_id: int) -> None:
        replace_batch(batch, batch_id, path)

    return _start(trend.writeStream.outputMode("update").foreachBatch(action), checkpoint, processing_time)


def current_trend(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest state of every window."""
    return first_per_key(stored, [*by, "start", "end"], [F.col("batch_id").desc()]).drop("batch_id")


def stream_trend(
    rows: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    session_gap: str | None = None,
    late_by: str = "1 day",
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean and maximum duration per window of the capture time.

    Tumbling, sliding with ``slide``, or sessions with ``session_gap``, for
    all rows or per ``by``; sessions are per source unless ``by`` says
    otherwise.  In append mode a window comes out once no row ``late_by`` can
    change it.
    """
    if session_gap and not by:
        by = SOURCE
    timed = _event_time(rows).withWatermark(_CAPTURED, late_by)
    if session_gap:
        period = F.session_window(_CAPTURED, session_gap)
    else:
        period = F.window(_CAPTURED, window, slide)
    total = F.sum("duration_ms").cast("double")
    return (
        timed.groupBy(period.alias("period"), *by)
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            (total / F.count("duration_ms")).alias("avg_duration_ms"),
            F.max("duration_ms").cast("double").alias("max_duration_ms"),
        )
        .select(
            *by,
            to_naive(F.col("period.start")).alias("start"),
            to_naive(F.col("period.end")).alias("end"),
            "query_count", "avg_duration_ms", "max_duration_ms",
        )
    )


class RunHistory(StreamingQueryListener):
    """One record per micro-batch of every watched job, from the query's own progress.

    ``watched`` marks a job's raw and kept rows; their counts and newest time come
    back with the progress of the batch, so nothing is read or counted twice.
    Added to ``spark.streams`` before the queries start.
    """

    def __init__(self) -> None:
        self.runs: dict[tuple[str, int], tuple] = {}

    @staticmethod
    def watched(job: str, raw: DataFrame, keep: Callable[[DataFrame], DataFrame], time_column: str = _CAPTURED) -> DataFrame:
        """The rows that ``keep`` keeps of ``raw``, both counted."""
        kept = keep(raw.observe(f"{job}.read", F.count(F.lit(1)).alias("n")))
        newest = F.max(F.col(time_column).cast("timestamp_ntz")).cast("string").alias("newest")
        return kept.observe(f"{job}.kept", F.count(F.lit(1)).alias("n"), newest)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = dict(progress.observedMetrics)
        for name in [n for n in found if n.endswith(".read")]:
            job = name.removesuffix(".read")
            read, kept = found[name], found.get(f"{job}.kept")
            if read["n"]:
                self.runs[job, progress.batchId] = (
                    job, progress.batchId, read["n"], kept["n"] if kept else None, kept["newest"] if kept else None,
                    str(progress.timestamp), int(dict(progress.durationMs).get("triggerExecution", 0)),
                )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """The records: a row for each run, with when it began and how long it took."""
        rows = spark.createDataFrame(
            [self.runs[k] for k in sorted(self.runs)],
            "job string, batch_id bigint, rows_read bigint, rows_kept bigint, newest string, began string, run_ms bigint",
        )
        return rows.withColumns(
            {"newest": F.col("newest").cast("timestamp_ntz"), "began": F.to_timestamp("began")}
        )

    def store(self, spark: SparkSession, path: str) -> None:
        """Writes the records by job and batch; those that are there already are replaced."""
        self.table(spark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "job", "batch_id"
        ).parquet(path)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop for being past the watermark.

    Added to ``spark.streams`` before a query starts, it sees every update,
    however long the query runs.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        """Rows dropped by a query so far; call it after the query's updates have arrived."""
        return self.dropped.get(str(query.runId), 0)


RUN_HISTORY = (
    "source string, rows_read bigint, rows_kept bigint, newest timestamp_ntz, ran_at timestamp"
)


def run_history(
    raw: DataFrame,
    keep: Callable[[DataFrame], DataFrame],
    source: str,
    time_column: str,
    path: str,
    checkpoint: str,
    processing_time: str | None = None,
) -> StreamingQuery:
    """One stored row per micro-batch: rows read, rows kept, the newest time and the time of the run.

    ``keep`` turns a raw batch into the rows that are kept; the batch is read once.
    """

    def action(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        watched = batch.observe(
            seen,
            F.count(F.lit(1)).alias("rows_read"),
            F.max(F.col(time_column).cast("timestamp_ntz")).alias("newest"),
        )
        kept = keep(watched).count()
        read = seen.get
        row = [(source, read["rows_read"], kept, read["newest"])]
        counts = batch.sparkSession.createDataFrame(
            row, "source string, rows_read bigint, rows_kept bigint, newest timestamp_ntz"
        )
        replace_batch(counts.withColumn("ran_at", F.current_timestamp()), batch_id, path)

    return each_batch(raw, action, checkpoint, processing_time)
