"""Sources: tables are rendered to raw files or text, read back, and must be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.names import distinct_names, header_names
from rowsmith.operators.coercion import coerce_columns
from rowsmith.operators import reshape
from rowsmith.operators.inference import infer_types
from rowsmith.operators.loads import preview
from rowsmith.operators.sinks import write_csv
from rowsmith.plans import render
from rowsmith.plans.registry import Tables, query
from rowsmith.session import scratch_folder
from rowsmith.sources import archives, delimited, documents, formats, html_tables, sql_dump, text
from rowsmith.sources.delimited import DelimitedOptions

ORDERS_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
    " FROM orders"
)
ORDER_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
]


def typed(df: DataFrame) -> DataFrame:
    """Infer and coerce all columns; instants come back without a zone, as in the tables."""
    coerced = coerce_columns(df, infer_types(df))
    return coerced.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in coerced.schema
        ]
    )


def parse_lines(df: DataFrame, names: list[str], options: DelimitedOptions) -> DataFrame:
    return delimited.fields_to_columns(
        delimited.record_rows(df, options), names, options.malformed
    )


def written_and_read(t: Tables, df: DataFrame, kind: str) -> DataFrame:
    """A table as files of a format, read back as text columns."""
    options = delimited.FORMAT_OPTIONS[kind]
    folder = scratch_folder(t.spark, kind)
    write_csv(df, folder, options.delimiter)
    return delimited.read_delimited(t.spark, folder, options).rows


# --- delimited text ---------------------------------------------------------------------


@query("scan_csv", ORDERS_SQL)
def scan_csv(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "orders-csv")
    write_csv(t.orders, folder)
    return typed(delimited.read_delimited(t.spark, folder).rows)


@query(
    "scan_tsv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"
)
def scan_tsv(t: Tables) -> DataFrame:
    return typed(written_and_read(t, t.part, "tsv"))


@query(
    "scan_psv",
    "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
)
def scan_psv(t: Tables) -> DataFrame:
    return typed(written_and_read(t, t.supplier, "psv"))


@query(
    "sniff_delimiter",
    "WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,"
    " generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),"
    " head AS (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id"
    " ORDER BY n) AS rn FROM raw WHERE trim(line) <> '') WHERE rn <= 10),"
    " counted AS (SELECT doc_id, d.pref, d.delim, len(line) - len(replace(line, d.delim, ''))"
    " AS cuts FROM head CROSS JOIN (VALUES (0, ','), (1, chr(9)), (2, ';'), (3, '|')) d(pref, delim)),"
    " scored AS (SELECT doc_id, pref, delim, CASE WHEN sum(cuts) > 0 THEN sum(cuts) +"
    " CASE WHEN min(cuts) = max(cuts) THEN 100 ELSE 0 END ELSE -1 END AS score"
    " FROM counted GROUP BY doc_id, pref, delim)"
    " SELECT doc_id, CASE WHEN score < 0 THEN ',' ELSE delim END AS delimiter,"
    " CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id"
    " ORDER BY score DESC, pref) AS best FROM scored) WHERE best = 1",
)
def sniff_delimiter(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(render.text_lines()).alias("n", "line"))
    return delimited.sniff_delimiter(lines, "doc_id", "n", "line")


@query("csv_quotes", "SELECT doc_id, text, lang FROM documents")
def csv_quotes(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "documents-csv")
    write_csv(t.documents.select("doc_id", "text", "lang"), folder)
    read = delimited.read_delimited(t.spark, folder, DelimitedOptions(encoding="utf8"))
    return coerce_columns(read.rows, {"doc_id": "INTEGER"})


@query(
    "csv_escape_char",
    "SELECT doc_id, text FROM documents",
)
def csv_escape_char(t: Tables) -> DataFrame:
    body = F.replace("text", F.lit('"'), F.lit('\\"'))
    line = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), body, F.lit('"'))
    options = DelimitedOptions(escape="\\", header=False)
    rows = parse_lines(t.documents.select(line.alias("line")), ["doc_id", "text"], options)
    return coerce_columns(rows, {"doc_id": "INTEGER"})


@query(
    "csv_headerless",
    "SELECT CAST(c_custkey AS VARCHAR) AS column_1, c_name AS column_2,"
    " c_mktsegment AS column_3 FROM customer",
)
def csv_headerless(t: Tables) -> DataFrame:
    lines = render.lines_of(t.customer.select("c_custkey", "c_name", "c_mktsegment"))
    fields = delimited.record_rows(lines)
    names = distinct_names(header_names([], delimited.table_width(fields)))
    return delimited.fields_to_columns(fields, names)


def ragged_lines(t: Tables) -> DataFrame:
    """Orders as lines; every third line stops after two fields."""
    full = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    short = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, short).otherwise(full).alias("line"))


@query(
    "csv_pad_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status,"
    " CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders",
)
def csv_pad_rows(t: Tables) -> DataFrame:
    return parse_lines(ragged_lines(t), ["k", "status", "priority"], DelimitedOptions())


@query(
    "csv_skip_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status, o_orderpriority AS priority"
    " FROM orders WHERE o_orderkey % 3 <> 0",
)
def csv_skip_rows(t: Tables) -> DataFrame:
    options = DelimitedOptions(malformed="skip")
    return parse_lines(ragged_lines(t), ["k", "status", "priority"], options)


@query(
    "csv_blank_null",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, nullif(o_orderstatus, 'O') AS status FROM orders"
    " WHERE o_orderkey % 5 <> 0",
)
def csv_blank_null(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", F.lit("  ")).otherwise(F.col("o_orderstatus"))
    filled = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" , "), status)
    line = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" , \t")).otherwise(filled)
    return parse_lines(t.orders.select(line.alias("line")), ["k", "status"], DelimitedOptions())


@query(
    "decode_auto",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text"
    " ELSE regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') END AS text FROM documents",
)
def decode_auto(t: Tables) -> DataFrame:
    latin1 = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin1)
    return t.documents.select("doc_id", text.decode_bytes(content).alias("text"))


# --- JSON and XML -----------------------------------------------------------------------


@query("scan_json", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_json(t: Tables) -> DataFrame:
    """Files that each hold a list of some hundred customers."""
    record = F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    some = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    folder = scratch_folder(t.spark, "customers-json")
    some.repartition("part").write.partitionBy("part").text(folder)
    return documents.record_rows(documents.read_json(t.spark, folder), "document").select("record.*")


@query("scan_ndjson", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_ndjson(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "events-ndjson")
    columns = ["event_id", "user_id", "event_type", "value", "props"]
    t.events.select(F.to_json(F.struct(*columns))).write.text(folder)
    docs = documents.read_ndjson(t.spark, folder)
    return docs.select(*[F.col(f"document.{c}") for c in columns])


XML_FILES = {"attributePrefix": "attr_", "valueTag": "text", "declaration": ""}


@query(
    "scan_xml",
    "SELECT o_orderkey AS attr_key, o_orderstatus AS status, o_totalprice AS price FROM orders",
)
def scan_xml(t: Tables) -> DataFrame:
    """Files of orders; their row element, columns and types follow from the files."""
    folder = scratch_folder(t.spark, "orders-xml")
    rows = t.orders.selectExpr("o_orderkey AS attr_key", "o_orderstatus AS status", "o_totalprice AS price")
    rows.write.options(**XML_FILES, rootTag="orders", rowTag="order").xml(folder)
    return typed(reshape.flatten(documents.read_xml(t.spark, folder).tables["orders"], "record"))


@query(
    "xml_root_rows",
    "SELECT doc_id, trim(line) AS value FROM (SELECT doc_id,"
    " unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''",
)
def xml_root_rows(t: Tables) -> DataFrame:
    """A root that holds nothing but repeated lines is the list of lines."""
    kept = F.filter(render.text_lines(), lambda line: F.trim(line) != "")
    lines = t.documents.select(F.col("doc_id").alias("attr_doc"), F.explode(kept).alias("text"))
    folder = scratch_folder(t.spark, "lines-xml")
    lines.write.options(**XML_FILES, rootTag="lines", rowTag="line").xml(folder)
    rows = reshape.flatten(documents.read_xml(t.spark, folder).tables["lines"], "record")
    return rows.select(F.col("attr_doc").cast("long").alias("doc_id"), F.trim("text").alias("value"))


# --- HTML -------------------------------------------------------------------------------


def pages_with_tables(t: Tables) -> DataFrame:
    """Each page, with two tables of its own facts put before the end of its body.

    Every third page has the columns of the first one in another order, and one more.
    """
    other = F.col("page_id") % 3 == 0
    url, size = render.xml_text(F.col("url")), F.length("html").cast("string")
    captioned = F.concat(
        F.lit("<table id=facts><caption>Page "), F.col("page_id").cast("string"),
        F.when(other, F.lit("</caption><tr><th>content</th><th>name</th><th>unit</th></tr><tr><td>"))
        .otherwise(F.lit("</caption><tr><th>name</th><th>content</th></tr><tr><td>url<td>")),
        url, F.when(other, F.lit("<td>url")).otherwise(F.lit("")),
        F.when(other, F.concat(F.lit("<tr><td>"), size, F.lit("</td><td>size<td>letters</table>")))
        .otherwise(F.concat(F.lit("<tr><td>size</td><td>"), size, F.lit("</td></table>"))),
    )
    bare = F.concat(
        F.lit("<table><tr><td>page</td><td>twice</td></tr><tr><td>"),
        F.col("page_id").cast("string"), F.lit("</td><td>"),
        (F.col("page_id") * 2).cast("string"), F.lit("</td></tr></table>"),
    )
    return t.pages.select("page_id", F.concat("html", captioned, bare).alias("html"))


@query(
    "html_tables",
    "SELECT page_id, 1 AS table_no, v.name, v.value FROM pages, LATERAL (VALUES ('name', 'url'),"
    " ('content', nullif(trim(url), '')), ('name', 'size'), ('content', CAST(length(html) AS VARCHAR)),"
    " ('unit', CASE WHEN page_id % 3 = 0 THEN 'letters' END)) v(name, value) WHERE v.value IS NOT NULL"
    " UNION ALL SELECT page_id, 2, 'page', CAST(page_id AS VARCHAR) FROM pages"
    " UNION ALL SELECT page_id, 2, 'twice', CAST(2 * page_id AS VARCHAR) FROM pages",
)
def html_table_rows(t: Tables) -> DataFrame:
    """All tables of all pages, each layout in a frame of its own, then cell by cell to compare them."""
    rows = html_tables.extract_tables(pages_with_tables(t), "page_id")
    frames = []
    for layout in html_tables.layouts(rows, "page_id", ("page_id", "table_no")):
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in layout.names]))
        frames.append(layout.rows.select("page_id", "table_no", cells.alias("cell")).select("page_id", "table_no", "cell.*"))
    return reshape.drift_union(frames).filter("value IS NOT NULL")


@query(
    "html_table_names",
    "SELECT page_id, 1 AS table_no, 'Page ' || page_id AS table_name FROM pages"
    " UNION ALL SELECT page_id, 2, 'page_' || page_id || '_table_2' FROM pages",
)
def html_table_names(t: Tables) -> DataFrame:
    rows = html_tables.extract_tables(pages_with_tables(t), "page_id")
    source = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    name = html_tables.table_name(F.col("caption"), F.col("table_id"), source, F.col("table_no"))
    return rows.select("page_id", "table_no", name.alias("table_name")).distinct()


# --- SQL dumps --------------------------------------------------------------------------


def document_inserts(t: Tables) -> DataFrame:
    """One INSERT with two rows per document, its columns listed in another order."""
    key = F.col("doc_id").cast("string")
    rows = F.concat(
        render.sql_tuple(render.sql_text(F.col("text")), key, F.lit("TRUE")),
        F.lit(", "),
        render.sql_tuple(render.sql_text(F.col("lang")), (-F.col("doc_id") - 1).cast("string"), F.lit("NULL")),
    )
    statement = F.concat(F.lit("INSERT INTO `shop`.`docs` (`body`, `id`, `kept`) VALUES "), rows)
    return t.documents.select(F.col("doc_id").alias("ordinal"), statement.alias("statement"))


DOCS_SQL = (
    "SELECT CAST(doc_id AS VARCHAR) AS id, 'true' AS kept, text AS body, CAST(NULL AS VARCHAR) AS note"
    " FROM documents UNION ALL"
    " SELECT CAST(-doc_id - 1 AS VARCHAR), NULL, lang, NULL FROM documents"
)


@query("dump_column_remap", DOCS_SQL)
def dump_column_remap(t: Tables) -> DataFrame:
    rows = sql_dump.insert_rows(document_inserts(t))
    return sql_dump.dump_rows(rows, "docs", ["id", "kept", "body", "note"])


def order_statements(t: Tables) -> DataFrame:
    """Orders as a dump: one chunk per order with comments, an INSERT and other statements."""
    values = render.sql_tuple(
        F.col("o_orderkey").cast("string"),
        F.col("o_custkey").cast("string"),
        render.sql_text(F.col("o_orderstatus")),
        F.col("o_totalprice").cast("string"),
        render.sql_text(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")),
        render.sql_text(F.col("o_orderpriority")),
    )
    chunk = F.concat(
        F.lit("-- row; of 'orders'\nSET time_zone = '+00:00';\n/* it's ; here */\n"),
        F.lit("INSERT INTO orders VALUES "), values, F.lit(";\n# done;\nLOCK TABLES `orders` WRITE;\n"),
    )
    return sql_dump.statement_rows(t.orders.select("o_orderkey", chunk.alias("chunk")), F.col("chunk"), "o_orderkey")


@query("dump_rows", ORDERS_SQL)
def dump_rows(t: Tables) -> DataFrame:
    rows = sql_dump.insert_rows(order_statements(t))
    texts = sql_dump.dump_rows(rows, "orders", ORDER_COLUMNS)
    declared = {
        "o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_totalprice": "FLOAT64", "o_orderdate": "TIMESTAMP",
    }
    loaded = coerce_columns(texts, declared, "dump")
    return loaded.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "dump_statements",
    "SELECT o_orderkey, CAST(3 AS BIGINT) AS statements, CAST(length(CAST(o_orderkey AS VARCHAR)) > 0"
    " AS BOOLEAN) AS has_insert FROM orders",
)
def dump_statements(t: Tables) -> DataFrame:
    statements = order_statements(t)
    return statements.groupBy("o_orderkey").agg(
        F.count("*").alias("statements"),
        F.bool_or(F.col("statement").startswith("INSERT INTO orders VALUES")).alias("has_insert"),
    )


@query(
    "dump_skipped",
    "SELECT k.kind, 'Skipping unsupported ' || k.kind || ' statement.' AS reason, k.snippet,"
    " COUNT(*) AS statements FROM orders CROSS JOIN (VALUES ('SET', 'SET time_zone = ''+00:00'''),"
    " ('LOCK TABLES', 'LOCK TABLES `orders` WRITE')) k(kind, snippet) GROUP BY ALL",
)
def dump_skipped(t: Tables) -> DataFrame:
    skipped = sql_dump.skipped_statements(order_statements(t))
    return skipped.groupBy("kind", "reason", "snippet").agg(F.count("*").alias("statements"))


ORDER_TYPES = (
    ("o_orderkey", "bigint(20) NOT NULL"), ("o_custkey", "bigint(20)"), ("o_orderstatus", "varchar(1) DEFAULT 'O'"),
    ("o_totalprice", "double"), ("o_orderdate", "datetime"), ("o_orderpriority", "varchar(15) NOT NULL"),
)


def written_dump(t: Tables) -> sql_dump.DumpTables:
    """Orders as dump files in a folder, some hundred to an INSERT, next to statements that are left out."""
    declared = ", ".join(f"`{name}` {kind}" for name, kind in ORDER_TYPES) + ", PRIMARY KEY (`o_orderkey`)"
    values = render.sql_tuple(
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), render.sql_text(F.col("o_orderstatus")),
        F.col("o_totalprice").cast("string"), render.sql_text(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")),
        render.sql_text(F.col("o_orderpriority")),
    )
    some = t.orders.groupBy(F.floor(F.col("o_orderkey") / 400).alias("part")).agg(F.array_join(F.collect_list(values), ",\n").alias("rows"))
    chunk = F.concat(
        F.lit(f"CREATE TABLE IF NOT EXISTS `orders` ({declared});\nINSERT INTO `orders` VALUES "), "rows",
        F.lit(";\nINSERT INTO `lost` VALUES (1);\nINSERT INTO `orders` (`o_orderkey`) VALUES (1, 2);\nUNLOCK  TABLES;"),
    )
    folder = scratch_folder(t.spark, "dump")
    some.select(chunk.alias("value")).write.text(folder)
    return sql_dump.dump_tables(sql_dump.read_statements(t.spark, folder))


@query("dump_tables", ORDERS_SQL)
def dump_tables(t: Tables) -> DataFrame:
    orders = written_dump(t).tables["orders"]
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "dump_constraints",
    "SELECT * FROM (VALUES ('o_orderkey', 'INTEGER', true, true), ('o_custkey', 'INTEGER', false, false),"
    " ('o_orderstatus', 'TEXT', false, false), ('o_totalprice', 'FLOAT64', false, false),"
    " ('o_orderdate', 'TIMESTAMP', false, false), ('o_orderpriority', 'TEXT', true, false))"
    " v(column_name, target_type, not_null, primary_key) WHERE EXISTS (SELECT 1 FROM orders)",
)
def dump_constraints(t: Tables) -> DataFrame:
    return written_dump(t).columns.select("column_name", "target_type", "not_null", "primary_key")


@query(
    "dump_skip_reasons",
    "SELECT r.kind, r.reason, count(DISTINCT o_orderkey // 400) AS statements FROM orders CROSS JOIN (VALUES"
    " ('INSERT', 'Skipping INSERT for lost because no supported CREATE TABLE was parsed first.'),"
    " ('INSERT', 'Skipping INSERT for orders because the explicit column list does not match row width.'),"
    " ('UNLOCK TABLES', 'Skipping unsupported UNLOCK TABLES statement.')) r(kind, reason) GROUP BY ALL",
)
def dump_skip_reasons(t: Tables) -> DataFrame:
    return written_dump(t).skipped.groupBy("kind", "reason").agg(F.count("*").alias("statements"))


@query(
    "dump_literals",
    "SELECT o_orderkey, 'it''s' || chr(10) || o_orderstatus AS escaped, hex(o_orderpriority) AS bytes,"
    " o_orderkey % 8 AS bits, o_totalprice AS price, o_orderstatus = 'F' AS done,"
    " CAST(NULL AS VARCHAR) AS nothing, 'now()' AS raw FROM orders",
)
def dump_literals(t: Tables) -> DataFrame:
    literals = [
        F.concat(F.lit("'it''s\\n"), "o_orderstatus", F.lit("'")),
        F.concat(F.lit("x'"), F.hex("o_orderpriority"), F.lit("'")),
        F.concat(F.lit("b'"), F.bin(F.col("o_orderkey") % 8), F.lit("'")),
        F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderstatus") == "F", F.lit("TRUE")).otherwise(F.lit("false")),
        F.lit("NULL"),
        F.lit("now()"),
    ]
    decoded = t.orders.select(
        "o_orderkey", *[sql_dump.literal_text(v).alias(f"v{i}") for i, v in enumerate(literals)]
    )
    return decoded.select(
        "o_orderkey",
        F.col("v0").alias("escaped"),
        F.col("v1").alias("bytes"),
        F.col("v2").cast("bigint").alias("bits"),
        F.col("v3").cast("double").alias("price"),
        F.col("v4").cast("boolean").alias("done"),
        F.col("v5").alias("nothing"),
        F.col("v6").alias("raw"),
    )


# --- wrappers, detection and preview ----------------------------------------------------


@query("scan_gzip", ORDERS_SQL)
def scan_gzip(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "orders-gzip")
    render.lines_of(t.orders).write.option("compression", "gzip").text(folder)
    lines = t.spark.read.text(folder).select(F.col("value").alias("line"))
    return typed(parse_lines(lines, ORDER_COLUMNS, DelimitedOptions()))


@query(
    "gzip_columns",
    "SELECT doc_id, 'doc_' || doc_id || '.txt' AS member, 'genericDelimited' AS format_key, text"
    " FROM documents",
)
def gzip_columns(t: Tables) -> DataFrame:
    packed = t.documents.select(
        "doc_id",
        F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), F.lit(".txt.gz")).alias("path"),
        render.gzip_bytes(F.col("text")).alias("content"),
    )
    return archives.gzip_candidates(packed).select(
        "doc_id",
        "member",
        "format.format_key",
        text.decode_bytes(archives.gunzip(F.col("content"))).alias("text"),
    )


@query(
    "zip_members",
    "SELECT 'archive_' || doc_id AS path, 'in/' || doc_id || '.csv' AS member, 'csv' AS format_key,"
    " text FROM documents",
)
def zip_members(t: Tables) -> DataFrame:
    key = F.col("doc_id").cast("string")
    packed = t.documents.select(
        F.concat(F.lit("archive_"), key).alias("path"),
        render.zip_bytes(F.concat(F.lit("in/"), key, F.lit(".csv")), F.col("text")).alias("content"),
    )
    return archives.zip_members(packed).select(
        "path", "member", "format.format_key", text.decode_bytes(F.col("content")).alias("text")
    )


@query(
    "detect_formats",
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'sqlite' WHEN regexp_matches(lower(url), '[^/]\\.html?$')"
    " THEN 'htmlTable' ELSE 'unknown' END AS format_key, CASE WHEN page_id % 7 = 0 OR"
    " regexp_matches(lower(url), '[^/]\\.html?$') THEN 'complete' ELSE 'notStarted' END AS support_state FROM pages",
)
def detect_formats(t: Tables) -> DataFrame:
    """By name, but every seventh page begins as a database file does."""
    content = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(formats.SQLITE_SIGNATURE), "html")).otherwise(F.col("html"))
    found = t.pages.select("page_id", formats.detect_format(F.col("url"), content.cast("binary")).alias("f"))
    return found.select("page_id", "f.format_key", "f.support_state")


@query("format_registry")
def format_registry(t: Tables) -> DataFrame:
    seen = t.pages.groupBy(formats.detect_format(F.col("url"))["format_key"].alias("format_key")).agg(
        F.count("*").alias("pages")
    )
    registry = formats.format_registry(t.spark)
    return registry.join(seen, "format_key", "left").fillna(0, ["pages"])


@query("preview_rows", f"{ORDERS_SQL} ORDER BY o_orderkey LIMIT 8")
def preview_rows(t: Tables) -> DataFrame:
    return preview(t.orders.orderBy("o_orderkey"))
