"""The lab workload: plain queries over users, orders and the statement logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.operators.filters import exclude_internal


def like_filter_count(orders: DataFrame, pattern: str, status: str) -> DataFrame:
    return orders.where(F.col("product").like(pattern) & (F.col("status") == status)).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def _orders_of(users: DataFrame, orders: DataFrame, how: str = "inner") -> DataFrame:
    return users.withColumnRenamed("id", "user_id").join(
        orders.withColumnsRenamed({"id": "order_id"}), "user_id", how
    )


def join_filter_count(users: DataFrame, orders: DataFrame, country: str, status: str) -> DataFrame:
    return _orders_of(
        users.where(F.col("country") == country).select("id"),
        orders.where(F.col("status") == status).select("id", "user_id"),
    ).agg(F.count(F.lit(1)).alias("cnt"))


def group_count_ordered(users: DataFrame) -> DataFrame:
    return (
        users.groupBy("country")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.col("cnt").desc(), "country")
    )


def left_join_having_topk(
    users: DataFrame, orders: DataFrame, statuses: list[str], more_than: int = 10, limit: int = 10
) -> DataFrame:
    """Revenue per country; the status filter makes the outer join an inner one."""
    joined = _orders_of(users.select("id", "country"), orders, "left")
    return (
        joined.where(F.col("status").isin(statuses))
        .groupBy("country")
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total_revenue"),
        )
        .where(F.col("order_count") > more_than)
        .orderBy(F.col("total_revenue").desc(), "country")
        .limit(limit)
    )


def top_statements(statements: DataFrame, limit: int = 5) -> DataFrame:
    """Slowest statements by mean time, in seconds, with an 80-character preview."""
    return (
        exclude_internal(statements)
        .orderBy(F.col("mean_exec_time").desc(), "query")
        .limit(limit)
        .select(
            "calls",
            F.round(F.col("total_exec_time").cast("decimal(30,6)") / 1000, 2)
            .cast("double")
            .alias("total_time_sec"),
            F.round(F.col("mean_exec_time").cast("decimal(30,6)") / 1000, 2)
            .cast("double")
            .alias("avg_time_sec"),
            F.left("query", F.lit(80)).alias("query_preview"),
        )
    )


def latest_statements(log: DataFrame, limit: int = 5) -> DataFrame:
    return (
        log.orderBy(F.col("start_time").desc(), "sql_text")
        .limit(limit)
        .select("start_time", "query_time", F.left("sql_text", F.lit(80)).alias("query_preview"))
    )


def slowest_statements(log: DataFrame, limit: int = 10) -> DataFrame:
    return (
        log.orderBy(F.col("query_time").desc(), "start_time", "sql_text")
        .limit(limit)
        .select("start_time", "sql_text", "query_time")
    )


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table, stacked."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    stacked = counts[0]
    for count in counts[1:]:
        stacked = stacked.unionByName(count)
    return stacked


def join_projection(
    users: DataFrame, orders: DataFrame, country: str, status: str, min_price: float
) -> DataFrame:
    return _orders_of(
        users.where(F.col("country") == country).select("id", "name"),
        orders.where((F.col("status") == status) & (F.col("price") > min_price)),
    ).select("name", "product", "price")


def antipattern_rewrites(users: DataFrame, orders: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Catalogue cases as (as written, rewritten); both sides give the same rows."""
    spark = users.sparkSession
    price = F.col("price").cast("decimal(18,2)")
    sql = {
        # NOT EXISTS against an anti join.  NOT IN itself makes Spark broadcast
        # the whole subquery, which does not hold for large tables.
        "SUB-004": (
            "SELECT id FROM {users} u WHERE NOT EXISTS "
            "(SELECT 1 FROM {orders} o WHERE o.user_id = u.id)",
            users.join(orders, users["id"] == orders["user_id"], "left_anti").select("id"),
        ),
        # correlated subquery against a join with the aggregate
        "SUB-002": (
            "SELECT o.id FROM {orders} o WHERE CAST(o.price AS decimal(18,2)) > "
            "(SELECT avg(CAST(i.price AS decimal(18,2))) FROM {orders} i "
            "WHERE i.user_id = o.user_id)",
            orders.join(orders.groupBy("user_id").agg(F.avg(price).alias("mean")), "user_id")
            .where(price > F.col("mean"))
            .select("id"),
        ),
        # scalar subquery in SELECT against a join
        "SUB-001": (
            "SELECT u.id, (SELECT count(*) FROM {orders} o WHERE o.user_id = u.id) AS n "
            "FROM {users} u",
            users.select("id")
            .join(
                orders.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n")),
                "id", "left",
            )
            .select("id", F.coalesce("n", F.lit(0)).alias("n")),
        ),
        # OR on two columns against UNION
        "OR-002": (
            "SELECT id FROM {orders} WHERE status = 'PAID' OR product = '1-URGENT'",
            orders.where(F.col("status") == "PAID")
            .select("id")
            .union(orders.where(F.col("product") == "1-URGENT").select("id"))
            .distinct(),
        ),
        # OR on one column against IN
        "OR-003": (
            "SELECT id FROM {orders} WHERE status = 'PAID' OR status = 'SHIPPED'",
            orders.where(F.col("status").isin("PAID", "SHIPPED")).select("id"),
        ),
        # self join against a window-free group: users with two different statuses
        "JOIN-004": (
            "SELECT DISTINCT a.user_id AS id FROM (SELECT DISTINCT user_id, status FROM {orders}) a "
            "JOIN (SELECT DISTINCT user_id, status FROM {orders}) b "
            "ON a.user_id = b.user_id AND a.status <> b.status",
            orders.groupBy(F.col("user_id").alias("id"))
            .agg(F.min("status").alias("lo"), F.max("status").alias("hi"))
            .where(F.col("lo") != F.col("hi"))
            .select("id"),
        ),
        # HAVING on a group column against WHERE
        "AGG-003": (
            "SELECT status, count(*) AS n FROM {orders} GROUP BY status HAVING status <> 'OPEN'",
            orders.where(F.col("status") != "OPEN")
            .groupBy("status")
            .agg(F.count(F.lit(1)).alias("n")),
        ),
    }
    return {
        case: (spark.sql(query, users=users, orders=orders), rewritten)
        for case, (query, rewritten) in sql.items()
    }


def rewrites_agree(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Per catalogue case the rows of both sides and how many differ."""
    stacked = None
    for case, (written, rewritten) in antipattern_rewrites(users, orders).items():
        key = F.to_json(F.struct(*[F.col(c) for c in written.columns]))
        sides = written.select(key.alias("row"), F.lit(1).alias("side")).unionByName(
            rewritten.select(key.alias("row"), F.lit(-1).alias("side"))
        )
        per_row = sides.groupBy("row").agg(
            F.sum("side").alias("balance"), F.count_if(F.col("side") == 1).alias("n")
        )
        result = per_row.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_written"),
            F.coalesce(F.sum(F.abs("balance")), F.lit(0)).alias("rows_different"),
        ).select(F.lit(case).alias("case_id"), "rows_written", "rows_different")
        stacked = result if stacked is None else stacked.unionByName(result)
    return stacked
