"""CSV export, pages, parameters, views, plans and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import sinks, statistics
from rowsmith.plans.ingest import typed
from rowsmith.plans.render import sqlite_files
from rowsmith.plans.registry import Tables, query
from rowsmith.session import scratch_folder
from rowsmith.sources import sqlite_snapshot
from rowsmith.streaming.paging import page_frame


@query(
    "export_csv",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def export_csv(t: Tables) -> DataFrame:
    """Export, then read the files with Spark's own CSV reader."""
    folder = scratch_folder(t.spark, "events-export")
    sinks.write_csv(t.events, folder, delimiter=";")
    read = t.spark.read.csv(folder, sep=";", header=True, quote='"', escape='"', multiLine=True)
    return typed(read)


CSV_CELL = (
    "CASE WHEN {0} LIKE '%,%' OR {0} LIKE '%\"%' OR {0} LIKE '%' || chr(10) || '%' OR"
    " {0} LIKE '%' || chr(13) || '%' THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
)


@query("csv_escape", f"SELECT doc_id, {CSV_CELL.format('text')} AS cell FROM documents")
def csv_escape(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sinks.escape_cell(F.col("text")).alias("cell"))


@query(
    "csv_render",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS day,"
    " CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,"
    " base64(encode(o_orderpriority)) AS bytes, coalesce(nullif(o_orderstatus, 'O'), '') AS status"
    " FROM orders",
)
def csv_render(t: Tables) -> DataFrame:
    return sinks.rendered(
        t.orders.select(
            F.col("o_orderkey").alias("k"),
            F.col("o_orderdate").alias("day"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
            F.col("o_orderpriority").cast("binary").alias("bytes"),
            F.nullif("o_orderstatus", F.lit("O")).alias("status"),
        )
    )


@query(
    "page_keyset",
    "SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-05-28'"
    " OR (o_orderdate = TIMESTAMP '1997-05-28' AND o_orderkey > 3)"
    " ORDER BY o_orderdate, o_orderkey LIMIT 1000",
)
def page_keyset(t: Tables) -> DataFrame:
    import datetime as dt

    rows = t.orders.select("o_orderdate", "o_orderkey", "o_totalprice")
    after = (dt.datetime(1997, 5, 28), 3)
    rows = rows.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    page = page_frame(rows, ["o_orderdate", "o_orderkey"], after)
    return page.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "sql_params",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'",
)
def sql_params(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?",
        args=[300000, "F"],
    )


@query(
    "view_query",
    "SELECT c_nationkey, COUNT(*) AS rich FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey",
)
def view_query(t: Tables) -> DataFrame:
    t.customer.filter("c_acctbal > 5000").createOrReplaceTempView("rich_customers")
    return t.spark.sql("SELECT c_nationkey, COUNT(*) AS rich FROM rich_customers GROUP BY c_nationkey")


@query("explain_plan")
def explain_plan(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(
        "EXPLAIN FORMATTED SELECT o_orderpriority, COUNT(*) FROM orders"
        " WHERE o_totalprice > 100000 GROUP BY o_orderpriority"
    )


@query(
    "analyze_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,"
        f" CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def analyze_stats(t: Tables) -> DataFrame:
    stats = statistics.column_statistics(t.orders)
    return stats.select("column_name", "row_count", "null_count", "min_value", "max_value")


#: Largest share by which an estimate of distinct values may be off: three times its standard error.
DISTINCT_ERROR = 0.15


@query(
    "analyze_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, true AS estimate_fits FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def analyze_distinct(t: Tables) -> DataFrame:
    """The estimated number of distinct values, next to the exact one."""
    estimates = statistics.column_statistics(t.orders).select("column_name", "distinct_estimate")
    counts = t.orders.agg(*[F.count_distinct(c).alias(c) for c in t.orders.columns])
    exact = counts.unpivot([], t.orders.columns, "column_name", "distinct_values")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
    return estimates.join(exact, "column_name").select(
        "column_name", "distinct_values",
        (off <= F.greatest(F.lit(1), F.col("distinct_values") * DISTINCT_ERROR)).alias("estimate_fits"),
    )


@query(
    "sqlite_snapshot",
    "SELECT doc_id, lang, n_chars, text FROM documents",
)
def sqlite_snapshot_rows(t: Tables) -> DataFrame:
    """Documents packed into SQLite files in a column, which are then scanned."""
    columns = ["doc_id", "lang", "n_chars", "text"]
    files = sqlite_files(t.documents.select(*columns), "doc_id")
    schema = "doc_id bigint, lang string, n_chars bigint, text string"
    return sqlite_snapshot.rows_from_bytes(files, "docs", schema)
