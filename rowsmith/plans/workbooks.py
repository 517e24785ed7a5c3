"""Workbooks rendered and scanned cell by cell, and spreadsheet formulas over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import workbook_formulas as X
from rowsmith.operators import reshape
from rowsmith.operators.coercion import coerce_columns
from rowsmith.plans import render
from rowsmith.plans.registry import Tables, query
from rowsmith.plans.relational import money
from rowsmith.sources import workbook


BOOK_ROWS = 1000


def order_books(t: Tables) -> DataFrame:
    """Workbooks of a thousand orders each; the order key is unique, so none is larger.

    Data: order, price, day, done, half (a formula), priority. Summary: a label and an
    aggregate per order; every fourth book also holds a formula that is not an aggregate. Every
    third book has price before order.
    """
    swapped = F.col("book") % 3 == 1
    titles = ("day", "done", "half", "half")
    header = F.when(
        swapped, render.sheet_row(*[render.text_cell(F.lit(c)) for c in ("price", "order", *titles)])
    ).otherwise(render.sheet_row(*[render.text_cell(F.lit(c)) for c in ("order", "price", *titles)]))
    day = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    data_row = render.sheet_row(
        F.when(swapped, render.number_cell(F.col("o_totalprice"))).otherwise(render.number_cell(F.col("o_orderkey"))),
        F.when(swapped, render.number_cell(F.col("o_orderkey"))).otherwise(render.number_cell(F.col("o_totalprice"))),
        render.number_cell(day, style=1),
        render.bool_cell(F.col("o_orderstatus") == "F"),
        render.formula_cell(F.concat(F.lit("B"), F.col("o_orderkey").cast("string"), F.lit("/2"))),
        render.text_cell(F.col("o_orderpriority")),
    )
    aggregate = F.when(F.col("book") % 4 == 0, F.lit("B2+B3")).otherwise(
        F.lit("COUNTIF(Data!D2:D3,TRUE)")
    )
    summary_head = render.sheet_row(render.text_cell(F.lit("label")), render.text_cell(F.lit("n")))
    summary_row = render.sheet_row(
        render.text_cell(F.col("o_orderpriority")), render.formula_cell(aggregate)
    )
    rows = t.orders.withColumn("book", F.floor(F.col("o_orderkey") / BOOK_ROWS)).select(
        "book", "o_orderkey", data_row.alias("data"), summary_row.alias("summary")
    )
    books = rows.groupBy("book").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "data", "summary"))).alias("rows")
    )
    return books.select(
        F.concat(F.lit("book_"), F.col("book").cast("string")).alias("path"),
        render.workbook_bytes(
            F.concat(header, F.array_join("rows.data", "")),
            F.concat(summary_head, F.array_join("rows.summary", "")),
        ).alias("content"),
    )


@query(
    "workbook_sheets",
    'SELECT o_orderkey AS "order", o_totalprice AS price, o_orderdate AS day,'
    " o_orderstatus = 'F' AS done, '=B' || o_orderkey || '/2' AS half, o_orderpriority AS half_2"
    " FROM orders",
)
def workbook_sheets(t: Tables) -> DataFrame:
    """The data sheets of all books; names and types follow from the files, a layout at a time."""
    scanned = workbook.workbook_rows(order_books(t))
    frames = [
        coerce_columns(layout.rows.drop("book", "row_no"), layout.types, "workbook")
        for layout in workbook.sheet_layouts(scanned)
        if layout.sheet == "Data"
    ]
    typed = reshape.drift_union(frames)
    return typed.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "workbook_formula_text",
    "SELECT 'book_' || (o_orderkey // 1000) AS book, '=B' || o_orderkey || '/2' AS text FROM orders",
)
def workbook_formula_text(t: Tables) -> DataFrame:
    cells = workbook.workbook_cells(workbook.workbook_rows(order_books(t)))
    text = workbook.cell_text(F.col("kind"), F.col("value"), F.col("formula"))
    formulas = cells.filter("sheet = 'Data' AND kind = 'formula'")
    return formulas.select("book", text.alias("text"))


@query(
    "workbook_types",
    "SELECT 'book_' || b AS book, sheet, CASE WHEN b % 3 = 1 AND sheet = 'Data' AND col_no < 3 THEN 3 - col_no"
    " ELSE col_no END AS col_no, kind AS target_type FROM (SELECT DISTINCT o_orderkey // 1000 AS b"
    " FROM orders) b CROSS JOIN (VALUES ('Data', 1, 'INTEGER'),"
    " ('Data', 2, 'FLOAT64'), ('Data', 3, 'TIMESTAMP'), ('Data', 4, 'BOOLEAN'), ('Data', 5, 'TEXT'),"
    " ('Data', 6, 'TEXT'), ('Summary', 1, 'TEXT'), ('Summary', 2, 'TEXT')) v(sheet, col_no, kind)",
)
def workbook_types(t: Tables) -> DataFrame:
    return workbook.sheet_types(workbook.workbook_rows(order_books(t)))


@query(
    "wb_summary_candidates",
    "SELECT DISTINCT 'book_' || (o_orderkey // 1000) AS book, 'Data' AS sheet, false AS is_summary"
    " FROM orders UNION ALL SELECT DISTINCT 'book_' || (o_orderkey // 1000), 'Summary',"
    " (o_orderkey // 1000) % 4 <> 0 FROM orders",
)
def wb_summary_candidates(t: Tables) -> DataFrame:
    return X.summary_candidates(workbook.workbook_rows(order_books(t)))


# --- formulas over tables ---------------------------------------------------------------


@query(
    "wb_summary_view",
    "SELECT s.segment, (SELECT COUNT(*) FROM customer WHERE c_mktsegment = s.segment) AS customers,"
    " COALESCE((SELECT CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer"
    " WHERE c_mktsegment = s.segment), 0) AS balance FROM"
    " (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION ALL SELECT 'NOWHERE') s",
)
def wb_summary_view(t: Tables) -> DataFrame:
    segments = t.customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    criteria = segments.unionAll(t.spark.sql("SELECT 'NOWHERE' AS segment"))
    measures = {"customers": F.count("*"), "balance": F.sum(money("c_acctbal")).cast("double")}
    return X.summary_view(criteria, "segment", t.customer, "c_mktsegment", measures)


@query(
    "wb_countif",
    "SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished,"
    " COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders",
)
def wb_countif(t: Tables) -> DataFrame:
    return t.orders.agg(
        X.countif(F.col("o_orderstatus"), F.lit("F")).alias("finished"),
        X.countif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("urgent"),
    )


@query("wb_counta", "SELECT COUNT(quality) AS filled FROM documents LEFT JOIN labels USING (doc_id)")
def wb_counta(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.agg(X.counta(F.col("quality")).alias("filled"))


@query(
    "wb_sum",
    "SELECT CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total,"
    " CAST(COALESCE(SUM(CASE WHEN o_totalprice < 0 THEN 1 END), 0) AS BIGINT) AS nothing FROM orders",
)
def wb_sum(t: Tables) -> DataFrame:
    negative = F.when(F.col("o_totalprice") < 0, F.lit(1))
    return t.orders.agg(
        X.sum_range(money("o_totalprice")).cast("double").alias("total"),
        X.sum_range(negative).alias("nothing"),
    )


@query(
    "wb_sumif",
    "SELECT CAST(COALESCE(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_acctbal AS"
    " DECIMAL(18,2)) END), 0) AS DOUBLE) AS building FROM customer",
)
def wb_sumif(t: Tables) -> DataFrame:
    total = X.sumif(F.col("c_mktsegment"), F.lit("BUILDING"), money("c_acctbal"))
    return t.customer.agg(total.cast("double").alias("building"))


@query(
    "wb_sumproduct",
    "SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE)"
    " AS discounted FROM lineitem",
)
def wb_sumproduct(t: Tables) -> DataFrame:
    product = X.sumproduct(
        F.col("l_quantity").cast("decimal(10,2)"), F.col("l_discount").cast("decimal(4,2)")
    )
    return t.lineitem.agg(product.cast("double").alias("discounted"))


@query(
    "wb_vlookup",
    "SELECT c_custkey, o_orderpriority AS first_priority FROM customer LEFT JOIN"
    " (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders"
    " GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def wb_vlookup(t: Tables) -> DataFrame:
    found = X.vlookup(
        t.customer, "c_custkey", t.orders, "o_custkey", "o_orderpriority", "o_orderkey",
        "first_priority",
    )
    return found.select("c_custkey", "first_priority")


@query(
    "wb_if",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE o_orderstatus END AS v FROM orders",
)
def wb_if(t: Tables) -> DataFrame:
    value = X.iff(F.col("o_totalprice") > 250000, F.lit("high"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", value.alias("v"))


@query(
    "wb_arith",
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 1 AS v, 0 - l_linenumber AS negative,"
    " l_quantity / 4 AS quarter, l_quantity >= 25 AND l_discount <> 0 AS large FROM lineitem",
)
def wb_arith(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (quantity * 2 - 1).alias("v"),
        X.negate(F.col("l_linenumber")).alias("negative"),
        (quantity / 4).alias("quarter"),
        ((quantity >= 25) & (F.col("l_discount") != 0)).alias("large"),
    )


@query(
    "wb_cellref",
    "SELECT o_orderkey, o_totalprice - (SELECT min(o_totalprice) FROM orders WHERE o_orderkey = 0)"
    " AS above_first FROM orders",
)
def wb_cellref(t: Tables) -> DataFrame:
    """Each row's price less one fixed cell, the price of order 0."""
    row = (F.col("o_orderkey") + 1).cast("int")
    cells = t.orders.select(
        F.lit("b").alias("book"), F.lit("s").alias("sheet"), row.alias("row_no"),
        F.lit(1).alias("col_no"), F.lit("double").alias("kind"),
        F.col("o_totalprice").cast("string").alias("value"), F.lit(None).cast("string").alias("formula"),
    )
    constant = X.cell_reference(cells, "b", "s", 1, 1)
    # One row, so the cross join keeps the length of the table.
    return t.orders.crossJoin(constant).select(
        "o_orderkey", (F.col("o_totalprice") - F.col("value").cast("double")).alias("above_first")
    )


@query(
    "wb_cell_chain",
    "WITH spots AS (SELECT o_orderkey, o_orderkey + 1 AS r, (o_orderkey + 10) // 10 * 10 AS e FROM orders),"
    " b AS (SELECT a.o_orderkey, a.r, p.o_totalprice AS price FROM spots a LEFT JOIN orders p ON p.o_orderkey = a.e - 1"
    " AND (SELECT count(*) FROM spots x WHERE x.r BETWEEN a.r AND a.e) = a.e - a.r + 1)"
    " SELECT o_orderkey, 2 AS col_no, price, CASE WHEN price IS NULL THEN 'empty' ELSE 'value' END AS state FROM b"
    " UNION ALL SELECT o_orderkey, 3, CASE WHEN r % 25 <> 0 THEN price END, CASE WHEN r % 25 = 0 THEN 'cycle'"
    " WHEN price IS NULL THEN 'empty' ELSE 'value' END FROM b",
)
def wb_cell_chain(t: Tables) -> DataFrame:
    """Column B refers to the cell below it up to each tenth row, which has the price; every 25th cell of C to itself."""
    row = (F.col("o_orderkey") + 1).cast("int")
    number = row.cast("string")
    none = F.lit(None).cast("string")
    below = F.when(row % 10 == 0, F.concat(F.lit("=A"), number)).otherwise(F.concat(F.lit("='s'!$B$"), (row + 1).cast("string")))
    beside = F.when(row % 25 == 0, F.concat(F.lit("=C"), number)).otherwise(F.concat(F.lit("= b"), number))
    columns = [
        F.struct(F.lit(1).alias("col_no"), F.lit("double").alias("kind"), F.col("o_totalprice").cast("string").alias("value"), none.alias("formula")),
        *[F.struct(F.lit(i).alias("col_no"), F.lit("formula").alias("kind"), none.alias("value"), f.alias("formula")) for i, f in ((2, below), (3, beside))],
    ]
    cells = t.orders.select(F.lit("b").alias("book"), F.lit("s").alias("sheet"), row.alias("row_no"), F.inline(F.array(*columns)))
    found = X.resolve_references(cells)
    return found.select((F.col("row_no") - 1).cast("long").alias("o_orderkey"), "col_no", F.col("value").cast("double").alias("price"), "state")


@query(
    "wb_formula_column",
    "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS"
    " DECIMAL(4,2)) * CAST(1 + l_tax AS DECIMAL(4,2))) AS DOUBLE) AS charge FROM lineitem"
    " GROUP BY l_returnflag",
)
def wb_formula_column(t: Tables) -> DataFrame:
    formulas = {
        "net": money("l_extendedprice") * (1 - F.col("l_discount")).cast("decimal(4,2)"),
        "gross": F.col("net") * (1 + F.col("l_tax")).cast("decimal(4,2)"),
    }
    lines = X.formula_columns(t.lineitem, formulas)
    return lines.groupBy("l_returnflag").agg(F.sum("gross").cast("double").alias("charge"))
