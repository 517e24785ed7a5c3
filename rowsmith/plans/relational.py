"""Projection, filters, subqueries, joins, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import joins
from rowsmith.plans.registry import Tables, query


def money(column: str) -> F.Column:
    """Cents are exact as decimals, so sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def money_sum(column: str) -> F.Column:
    return F.sum(money(column)).cast("double")


# --- projection and filters -------------------------------------------------------------


@query("project", "SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders")
def project(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )


@query(
    "filter_bool",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
    " WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT o_orderpriority = '5-LOW'",
)
def filter_bool(t: Tables) -> DataFrame:
    wanted = (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 400000)
    return t.orders.filter(wanted & ~(F.col("o_orderpriority") == "5-LOW")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query(
    "filter_between",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem"
    " WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 10 AND 20",
)
def filter_between(t: Tables) -> DataFrame:
    return t.lineitem.filter(
        F.col("l_discount").between(0.05, 0.07) & F.col("l_quantity").between(10, 20)
    ).select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "filter_in",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def filter_in(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", "c_mktsegment"
    )


@query(
    "filter_like",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'"
    " OR p_brand LIKE 'Brand#_' OR p_name LIKE '%!_%' ESCAPE '!'",
)
def filter_like(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'"
        " OR p_brand LIKE 'Brand#_' OR p_name LIKE '%!_%' ESCAPE '!'"
    )


@query(
    "filter_null",
    "SELECT d.doc_id, l.quality IS NULL AS unlabeled FROM documents d"
    " LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.quality IS NOT NULL",
)
def filter_null(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.filter(F.col("toxic").isNull() | F.col("quality").isNotNull()).select(
        "doc_id", F.col("quality").isNull().alias("unlabeled")
    )


@query(
    "case_when",
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large'"
    " WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS size FROM orders",
)
def case_when(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    size = F.when(price >= 300000, "large").when(price >= 100000, "medium").otherwise("small")
    return t.orders.select("o_orderkey", size.alias("size"))


@query(
    "cast_types",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text,"
    " CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day,"
    " TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number FROM orders",
)
def cast_types(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").try_cast("int").alias("not_a_number"),
    )


@query(
    "collate_ci",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'",
)
def collate_ci(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT c_custkey, c_mktsegment FROM customer"
        " WHERE c_mktsegment COLLATE UTF8_LCASE = 'Building'"
    )


@query(
    "values_rows",
    "SELECT v.code, v.meaning, COUNT(o_orderkey) AS orders FROM"
    " (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial'), ('X', 'unknown'))"
    " AS v(code, meaning) LEFT JOIN orders ON o_orderstatus = v.code GROUP BY v.code, v.meaning",
)
def values_rows(t: Tables) -> DataFrame:
    return t.sql(
        "WITH counted AS (SELECT o_orderstatus AS code, COUNT(*) AS n FROM orders GROUP BY 1)"
        " SELECT v.code, v.meaning, COALESCE(n, 0) AS orders FROM"
        " VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial'), ('X', 'unknown')"
        " AS v(code, meaning) LEFT JOIN counted USING (code)"
    )


@query(
    "cte",
    "WITH spent AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
    " AS total FROM orders GROUP BY o_custkey)"
    " SELECT c_custkey, c_name, total FROM customer JOIN spent ON c_custkey = o_custkey"
    " WHERE total > 2000000",
)
def cte(t: Tables) -> DataFrame:
    return t.sql(
        "WITH spent AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
        " AS total FROM orders GROUP BY o_custkey)"
        " SELECT c_custkey, c_name, total FROM customer JOIN spent ON c_custkey = o_custkey"
        " WHERE total > 2000000"
    )


@query(
    "recursive_cte",
    "WITH RECURSIVE span AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),"
    " years(y, last_year) AS (SELECT CAST(year(lo) AS INTEGER), CAST(year(hi) AS INTEGER) FROM span"
    " UNION ALL SELECT y + 1, last_year FROM years WHERE y < last_year)"
    " SELECT y AS order_year, count(o_orderkey) AS orders FROM years"
    " LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y",
)
def recursive_cte(t: Tables) -> DataFrame:
    return t.sql(
        "WITH RECURSIVE years(y, last_year) AS ("
        " SELECT year(min(o_orderdate)), year(max(o_orderdate)) FROM orders"
        " UNION ALL SELECT y + 1, last_year FROM years WHERE y < last_year),"
        " counted AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)"
        " SELECT y AS order_year, coalesce(n, 0) AS orders FROM years LEFT JOIN counted USING (y)"
    )


@query(
    "scalar_subquery",
    "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders"
    " FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
)
def scalar_subquery(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders"
        " FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)"
    )


@query(
    "current_ts",
    "SELECT event_type, count(*) AS events, max(ts) < CAST(now() AS TIMESTAMP) AS is_past"
    " FROM events GROUP BY event_type",
)
def current_ts(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT event_type, count(*) AS events,"
        " max(ts) < CURRENT_TIMESTAMP AS is_past FROM events GROUP BY event_type"
    )


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


# --- joins ------------------------------------------------------------------------------


@query(
    "join_inner",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", "c_mktsegment"
    )


@query(
    "join_left",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN"
    " (SELECT * FROM orders WHERE o_totalprice > 450000) big ON c_custkey = o_custkey",
)
def join_left(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 450000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey"
    )


@query(
    "join_right",
    "SELECT d.doc_id, d.quality, documents.doc_id AS document FROM"
    " (SELECT * FROM labels WHERE toxic = 0) d RIGHT JOIN documents ON d.doc_id = documents.doc_id",
)
def join_right(t: Tables) -> DataFrame:
    clean = t.labels.filter("toxic = 0")
    documents = t.documents.select(F.col("doc_id").alias("document"))
    return clean.join(documents, clean["doc_id"] == documents["document"], "right").select(
        "doc_id", "quality", "document"
    )


@query(
    "join_full",
    "SELECT c.nation AS nation, c.customers, s.suppliers FROM"
    " (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000"
    "  GROUP BY 1) c FULL JOIN"
    " (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s"
    " ON c.nation = s.nation",
)
def join_full(t: Tables) -> DataFrame:
    customers = (
        t.customer.filter("c_acctbal > 9000")
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.count("*").alias("customers"))
    )
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("other")).agg(
        F.count("*").alias("suppliers")
    )
    return customers.join(suppliers, F.col("nation") == F.col("other"), "full").select(
        "nation", "customers", "suppliers"
    )


@query(
    "join_cross",
    "SELECT o_orderkey, o_totalprice / total AS share FROM orders CROSS JOIN"
    " (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders)",
)
def join_cross(t: Tables) -> DataFrame:
    # One side is one aggregated row, so the result is as long as the other side.
    total = t.orders.agg(money_sum("o_totalprice").alias("total"))
    return t.orders.crossJoin(total).select(
        "o_orderkey", (F.col("o_totalprice") / F.col("total")).alias("share")
    )


@query(
    "join_natural",
    "SELECT c_custkey, n_nationkey, n_name FROM nation NATURAL JOIN"
    " (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) c",
)
def join_natural(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT c_custkey, n_nationkey, n_name FROM nation NATURAL JOIN"
        " (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) c"
    )


@query(
    "join_using",
    "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def join_using(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, ["doc_id"]).select("doc_id", "lang", "quality", "toxic")


@query(
    "join_theta",
    "SELECT o_orderpriority, count(*) AS late_lines FROM orders JOIN lineitem"
    " ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice < o_totalprice"
    " GROUP BY o_orderpriority",
)
def join_theta(t: Tables) -> DataFrame:
    condition = (
        (F.col("o_orderkey") == F.col("l_orderkey"))
        & (F.col("l_shipdate") > F.col("o_orderdate"))
        & (F.col("l_extendedprice") < F.col("o_totalprice"))
    )
    return (
        t.orders.join(t.lineitem, condition)
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("late_lines"))
    )


@query(
    "join_theta_bands",
    "SELECT band, count(*) AS customers FROM customer JOIN"
    " (VALUES ('debt', -1e9, 0.0), ('low', 0.0, 5000.0), ('high', 5000.0, 1e9)) b(band, lo, hi)"
    " ON c_acctbal >= lo AND c_acctbal < hi GROUP BY band",
)
def join_theta_bands(t: Tables) -> DataFrame:
    # No equality at all: the bands are three literal rows, which Spark broadcasts.
    return t.sql(
        "SELECT band, count(*) AS customers FROM customer JOIN"
        " VALUES ('debt', -1e9D, 0.0D), ('low', 0.0D, 5000.0D), ('high', 5000.0D, 1e9D)"
        " b(band, lo, hi) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY band"
    )


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS"
    " (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
)
def join_semi(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 480000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        "c_custkey", "c_name"
    )


@query(
    "join_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS"
    " (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
)
def join_anti(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 450000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(
        "c_custkey", "c_name"
    )


@query(
    "join_not_in",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN"
    " (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)",
)
def join_not_in(t: Tables) -> DataFrame:
    poor = t.customer.filter("c_acctbal < 5000").select("c_custkey")
    return joins.not_in(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", poor)


# --- aggregates -------------------------------------------------------------------------


@query(
    "group_by",
    "SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"
    " AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,"
    " CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)))"
    " AS DOUBLE) AS sum_disc, COUNT(*) AS lines FROM lineitem"
    " WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus",
)
def group_by(t: Tables) -> DataFrame:
    discounted = money("l_extendedprice") * (1 - F.col("l_discount")).cast("decimal(4,2)")
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money_sum("l_quantity").alias("sum_qty"),
            money_sum("l_extendedprice").alias("sum_base"),
            F.sum(discounted).cast("double").alias("sum_disc"),
            F.count("*").alias("lines"),
        )
    )


@query(
    "having",
    "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
)
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")).filter("orders >= 15")


@query(
    "agg_count",
    "SELECT lang, COUNT(*) AS documents, COUNT(quality) AS labeled FROM documents"
    " LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def agg_count(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count("quality").alias("labeled")
    )


@query(
    "agg_count_distinct",
    "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers"
    " FROM lineitem GROUP BY l_returnflag",
)
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query(
    "agg_sum",
    "SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,"
    " CAST(SUM(l_linenumber) AS BIGINT) AS line_numbers FROM lineitem GROUP BY l_suppkey",
)
def agg_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        money_sum("l_extendedprice").alias("revenue"), F.sum("l_linenumber").alias("line_numbers")
    )


@query(
    "agg_avg",
    "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)"
    " AS avg_qty, AVG(l_linenumber) AS avg_line FROM lineitem GROUP BY l_returnflag",
)
def agg_avg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        (money_sum("l_quantity") / F.count("*")).alias("avg_qty"),
        F.avg("l_linenumber").alias("avg_line"),
    )


@query(
    "agg_min_max",
    "SELECT event_type, MIN(value) AS low, MAX(value) AS high, MIN(ts) AS first_ts,"
    " MAX(ts) AS last_ts FROM events GROUP BY event_type",
)
def agg_min_max(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@query(
    "agg_filter",
    "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished,"
    " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 100000) AS DOUBLE)"
    " AS large_total FROM orders GROUP BY o_orderpriority",
)
def agg_filter(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished,"
        " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 100000)"
        " AS DOUBLE) AS large_total FROM orders GROUP BY o_orderpriority"
    )


# --- sorting and set operations ---------------------------------------------------------


@query(
    "order_by",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders"
    " ORDER BY o_orderdate ASC, o_totalprice DESC, o_orderkey",
)
def order_by(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(
        F.asc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"
    )


@query(
    "order_nulls",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)"
    " ORDER BY quality DESC NULLS LAST, doc_id ASC NULLS FIRST",
)
def order_nulls(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", "quality").orderBy(
        F.desc_nulls_last("quality"), F.asc_nulls_first("doc_id")
    )


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_k(t: Tables) -> DataFrame:
    return (
        t.orders.select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(25)
    )


@query(
    "limit_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100",
)
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(20)


@query(
    "union_distinct",
    "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
)
def union_distinct(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nation"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nation"))
    return customers.union(suppliers).distinct()


@query(
    "union_all",
    "SELECT c_name AS name, c_acctbal AS balance FROM customer"
    " UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def union_all(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return customers.unionAll(suppliers)


@query(
    "intersect",
    "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F'"
    " INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def intersect(t: Tables) -> DataFrame:
    key = F.col("o_custkey").alias("custkey")
    finished = t.orders.filter("o_orderstatus = 'F'").select(key)
    return finished.intersect(t.orders.filter("o_orderstatus = 'P'").select(key))


@query(
    "except",
    "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders"
    " WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
)
def except_(t: Tables) -> DataFrame:
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return t.customer.select(F.col("c_custkey").alias("custkey")).subtract(
        recent.select(F.col("o_custkey").alias("custkey"))
    )


@query(
    "except_all",
    "SELECT o_custkey AS custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
)
def except_all(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("custkey")).exceptAll(
        t.customer.select(F.col("c_custkey").alias("custkey"))
    )
