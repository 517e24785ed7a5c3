"""Constraint checks and snapshot rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import coercion, dml, loads, quality
from rowsmith.operators.coercion import coerce_columns
from rowsmith.plans import render
from rowsmith.plans.registry import Tables, query
from rowsmith.session import checkpointed, scratch_folder
from rowsmith.sources.delimited import DelimitedOptions, read_delimited

# --- constraints ------------------------------------------------------------------------


@query(
    "check_not_null",
    "SELECT doc_id, v AS violated_column FROM documents LEFT JOIN labels USING (doc_id)"
    " CROSS JOIN (VALUES ('quality'), ('toxic')) n(v)"
    " WHERE CASE v WHEN 'quality' THEN quality ELSE toxic END IS NULL",
)
def check_not_null(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    broken = quality.null_violations(joined, ["doc_id", "quality", "toxic"])
    return broken.select("doc_id", "violated_column")


@query(
    "check_unique",
    "SELECT c_acctbal, COUNT(*) AS occurrences FROM customer WHERE c_acctbal IS NOT NULL"
    " GROUP BY c_acctbal HAVING COUNT(*) > 1",
)
def check_unique(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.customer, ["c_acctbal"])


@query(
    "check_primary_key",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences, 'duplicate key' AS reason FROM lineitem"
    " GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)
def check_primary_key(t: Tables) -> DataFrame:
    return quality.primary_key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "check_expression",
    "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)",
)
def check_expression(t: Tables) -> DataFrame:
    return quality.check_violations(t.customer, "c_acctbal >= 0").select("c_custkey", "c_acctbal")


@query(
    "check_foreign_key",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN"
    " (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
)
def check_foreign_key(t: Tables) -> DataFrame:
    parents = t.customer.filter("c_mktsegment <> 'BUILDING'")
    children = t.orders.select("o_orderkey", "o_custkey")
    return quality.orphans(children, "o_custkey", parents, "c_custkey")


@query(
    "cascade_delete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN"
    " (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_acctbal < 0").select("c_custkey")
    return quality.cascade_delete(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query(
    "cascade_update",
    "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
    " THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders",
)
def cascade_update(t: Tables) -> DataFrame:
    renamed = t.customer.filter("c_acctbal < 0").select(
        "c_custkey", (F.col("c_custkey") + 1000000).alias("new_key")
    )
    return quality.cascade_update(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", renamed)


@query(
    "cascade_chain",
    "WITH RECURSIVE gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < -900 UNION"
    " SELECT c.c_custkey FROM customer c JOIN gone g ON c.c_custkey // 4 = g.c_custkey AND c.c_custkey > 0),"
    " orders_left AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))"
    " SELECT 'customer' AS table_name, c_custkey AS key, CAST(NULL AS INTEGER) AS line FROM customer"
    " WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)"
    " UNION ALL SELECT 'orders', o_orderkey, NULL FROM orders_left"
    " UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN"
    " (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_left))",
)
def cascade_chain(t: Tables) -> DataFrame:
    """Customers were brought by others; with one go those, their orders, and the lines of those."""
    customers = t.customer.select("c_custkey", F.when(F.col("c_custkey") > 0, F.expr("c_custkey div 4")).alias("brought_by"))
    tables = {"customer": customers, "orders": t.orders.select("o_orderkey", "o_custkey"), "lineitem": t.lineitem.select("l_orderkey", "l_linenumber")}
    references = [
        quality.Reference("customer", "brought_by", "customer", "c_custkey"),
        quality.Reference("orders", "o_custkey", "customer", "c_custkey"),
        quality.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ]
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    first = {"customer": t.customer.filter("c_acctbal < -900").select("c_custkey")}
    left = quality.cascade_graph(tables, keys, references, first)
    none = F.lit(None).cast("int").alias("line")
    rows = [left[n].select(F.lit(n).alias("table_name"), F.col(keys[n][0]).alias("key"), none) for n in ("customer", "orders")]
    lines = left["lineitem"].select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))
    return rows[0].unionAll(rows[1]).unionAll(lines)


@query("apply_default", "SELECT o_orderkey, o_orderstatus, 'active' AS state, 0 AS retries FROM orders")
def apply_default(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    defaults = {"state": F.lit("active"), "retries": F.lit(0), "o_orderstatus": F.lit("unused")}
    return quality.apply_defaults(rows, defaults)


@query(
    "generated_column",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,"
    " CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)"
    " AS total FROM lineitem",
)
def generated_column(t: Tables) -> DataFrame:
    lines = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price"
    )
    total = "CAST(CAST(l_quantity AS DECIMAL(10,2)) * price AS DOUBLE)"
    return quality.generated_columns(lines, {"total": total})


CUSTOMERS_SQL = (
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
)


def _drafted(t: Tables) -> DataFrame:
    texts = render.text_columns(t.customer)
    draft = loads.draft_table(texts, "customer")
    loads.check_names([draft])
    return loads.apply_draft(texts, draft)


def _stored(t: Tables, *steps: tuple[str, DataFrame]) -> DataFrame:
    """What is in a new table after loading each (mode, rows); the table goes again."""
    table = f"customer_{uuid.uuid4().hex}"
    try:
        for mode, rows in steps:
            loads.load_tables(t.spark, {table: rows}, mode)
        return checkpointed(t.spark.table(table))
    finally:
        loads.drop_table(t.spark, table)


@query("load_table", CUSTOMERS_SQL)
def load_table(t: Tables) -> DataFrame:
    """Draft, type and store a table of text; what is read back is the stored copy."""
    return _stored(t, ("error", _drafted(t)))


@query("load_append", CUSTOMERS_SQL)
def load_append(t: Tables) -> DataFrame:
    """Customers in debt first, then the others into the same table."""
    rows = _drafted(t)
    in_debt = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    return _stored(t, ("error", rows.filter(in_debt)), ("append", rows.filter(~in_debt)))


@query("load_replace", CUSTOMERS_SQL)
def load_replace(t: Tables) -> DataFrame:
    """A table whose names were wrong is replaced by the right one."""
    rows = _drafted(t)
    return _stored(t, ("error", rows.withColumn("c_name", F.lower("c_name"))), ("replace", rows))


@query(
    "import_report",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS row_count,"
        f" {columns} AS column_count, (SELECT string_agg(column_name || ' ' || CASE column_type WHEN 'VARCHAR' THEN 'string'"
        " WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END, ', ')"
        f" FROM (DESCRIBE {name})) AS columns, '{warning}' AS warnings"
        for name, columns, warning in (("customer", 5, ""), ("orders", 6, ""), ("lineitem", 11, ""), ("documents", 5, ""))
    )
    + " UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 2, 'n_nationkey bigint, n_name string',"
    " '1 file(s) end inside a quoted field'",
)
def import_report(t: Tables) -> DataFrame:
    """Four tables as they are, and one from a file whose last quote stays open."""
    names = ("customer", "orders", "lineitem", "documents")
    quoted = F.when(F.col("n_nationkey") == 24, F.concat(F.lit('"'), "n_name")).otherwise(F.col("n_name"))
    lines = t.nation.orderBy("n_nationkey").select(F.concat_ws(",", "n_nationkey", quoted).alias("value"))
    folder = scratch_folder(t.spark, "nations")
    lines.coalesce(1).write.text(folder)
    read = read_delimited(t.spark, folder, DelimitedOptions(header=False))
    nations = coerce_columns(read.rows.toDF("n_nationkey", "n_name"), {"n_nationkey": "INTEGER"})
    tables = {name: getattr(t, name) for name in names} | {"nation": nations}
    report = loads.import_report(tables, {"nation": read.warnings})
    return report.withColumn("warnings", F.array_join("warnings", "; "))


@query(
    "reject_counts",
    "SELECT 'o_orderpriority' AS column_name, 'INTEGER' AS target_type, COUNT(o_orderpriority) AS present,"
    " COUNT(o_orderpriority) AS rejected FROM orders UNION ALL"
    " SELECT 'price', 'FLOAT64', COUNT(*), COUNT(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders",
)
def reject_counts(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    texts = t.orders.select("o_orderpriority", price.alias("price"))
    return coercion.reject_counts(texts, {"o_orderpriority": "INTEGER", "price": "FLOAT64"})


# --- rewrites ---------------------------------------------------------------------------


@query(
    "dml_insert",
    "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL"
    " SELECT s_suppkey + 10000000, s_name, NULL FROM supplier",
)
def dml_insert(t: Tables) -> DataFrame:
    rows = t.supplier.selectExpr("s_name AS c_name", "s_suppkey + 10000000 AS c_custkey")
    return dml.insert(t.customer.select("c_custkey", "c_name", "c_acctbal"), rows)


@query(
    "dml_update",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,"
    " CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
)
def dml_update(t: Tables) -> DataFrame:
    changes = {"o_orderstatus": F.lit("O"), "o_totalprice": F.col("o_totalprice") * 2}
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update(target, changes, F.col("o_orderstatus") == "P")


@query(
    "dml_delete",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)"
    " WHERE NOT coalesce(quality = 0, false)",
)
def dml_delete(t: Tables) -> DataFrame:
    target = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return dml.delete(target, F.col("quality") == 0)


@query(
    "dml_upsert",
    "SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v FROM"
    " (SELECT c_custkey AS k, c_acctbal AS v FROM customer) t FULL JOIN"
    " (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_totalprice > 450000"
    " GROUP BY o_custkey UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier) s ON t.k = s.k",
)
def dml_upsert(t: Tables) -> DataFrame:
    return dml.upsert(*upsert_sides(t), ["k"])


def upsert_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    target = t.customer.selectExpr("c_custkey AS k", "c_acctbal AS v")
    spent = t.orders.filter("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("k"))
    rows = spent.agg(F.max("o_totalprice").alias("v")).unionByName(
        t.supplier.selectExpr("-1 - s_suppkey AS k", "s_acctbal AS v")
    )
    return target, rows


@query(
    "dml_upsert_nothing",
    "SELECT c_custkey AS k, c_acctbal AS v FROM customer"
    " UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier",
)
def dml_upsert_nothing(t: Tables) -> DataFrame:
    return dml.upsert(*upsert_sides(t), ["k"], do="nothing")


@query(
    "dml_returning",
    "SELECT o_orderkey, 'closed' AS o_orderstatus FROM orders WHERE o_totalprice < 20000",
)
def dml_returning(t: Tables) -> DataFrame:
    return dml.update_returning(
        t.orders,
        {"o_orderstatus": F.lit("closed")},
        F.col("o_totalprice") < 20000,
        ["o_orderkey", "o_orderstatus"],
    )


@query(
    "alter_columns",
    "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, 'new' AS state FROM customer",
)
def alter_columns(t: Tables) -> DataFrame:
    return dml.alter(
        t.customer,
        rename={"c_name": "customer_name"},
        add={"state": F.lit("new")},
        drop=["c_mktsegment"],
    )
