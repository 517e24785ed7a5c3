"""Type inference, coercion and naming over tables seen as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import declared, names
from rowsmith.functions import tokens as K
from rowsmith.operators import coercion, inference, naming
from rowsmith.plans import render
from rowsmith.plans.registry import Tables, query


def _expected(*columns: tuple[str, str]) -> str:
    """Oracle rows: the column name and a SQL expression for its type."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {sql}" for name, sql in columns
    )


INTEGER_SQL = "CASE WHEN count(*) = count(TRY_CAST(CAST({0} AS VARCHAR) AS BIGINT)) THEN 'INTEGER' END"
DOUBLE_SQL = "CASE WHEN count(*) = count(TRY_CAST(CAST({0} AS VARCHAR) AS DOUBLE)) THEN 'FLOAT64' END"
TIME_SQL = "CASE WHEN count(*) = count(TRY_CAST(CAST({0} AS VARCHAR) AS TIMESTAMP)) THEN 'TIMESTAMP' END"
TEXT_SQL = "CASE WHEN count(TRY_CAST({0} AS DOUBLE)) < count({0}) THEN 'TEXT' END"


@query(
    "infer_types",
    _expected(
        *[
            (c, sql.format(c) + " AS target_type, count(*) > count(" + c + ") AS contains_nulls FROM lineitem")
            for c, sql in (
                ("l_orderkey", INTEGER_SQL),
                ("l_partkey", INTEGER_SQL),
                ("l_suppkey", INTEGER_SQL),
                ("l_linenumber", INTEGER_SQL),
                ("l_quantity", DOUBLE_SQL),
                ("l_extendedprice", DOUBLE_SQL),
                ("l_discount", DOUBLE_SQL),
                ("l_tax", DOUBLE_SQL),
                ("l_returnflag", TEXT_SQL),
                ("l_linestatus", TEXT_SQL),
                ("l_shipdate", TIME_SQL),
            )
        ]
    ),
)
def infer_types(t: Tables) -> DataFrame:
    return inference.type_frame(render.text_columns(t.lineitem))


def types_of(df: DataFrame) -> DataFrame:
    return inference.type_frame(df).select("column_name", "target_type")


SWITCH_SQL = (
    "CASE WHEN bool_and({0} IN (0, 1)) AND count(DISTINCT {0}) = 2 THEN 'BOOLEAN' ELSE 'INTEGER' END"
)
WORD_SQL = (
    "CASE WHEN bool_and(lower(trim({0})) IN ('yes', 'no', 'true', 'false', 'enabled', 'disabled')) THEN 'BOOLEAN' ELSE 'TEXT' END"
)


@query(
    "infer_boolean",
    _expected(
        ("quality", SWITCH_SQL.format("quality") + " AS target_type FROM labels"),
        ("toxic", SWITCH_SQL.format("toxic") + " AS target_type FROM labels"),
        ("zeros", SWITCH_SQL.format("quality * 0") + " AS target_type FROM labels"),
        ("is_zero", "CASE WHEN bool_and(quality * 0 IN (0, 1)) THEN 'BOOLEAN' ELSE 'INTEGER' END AS target_type FROM labels"),
        ("words", WORD_SQL.format("CASE WHEN toxic = 1 THEN 'Enabled' ELSE ' no ' END") + " AS target_type FROM labels"),
    ),
)
def infer_boolean(t: Tables) -> DataFrame:
    zero = (F.col("quality") * 0).cast("string")
    words = F.when(F.col("toxic") == 1, F.lit("Enabled")).otherwise(F.lit(" no "))
    return types_of(
        t.labels.select(
            F.col("quality").cast("string").alias("quality"),
            F.col("toxic").cast("string").alias("toxic"),
            zero.alias("zeros"),
            zero.alias("is_zero"),
            words.alias("words"),
        )
    )


def uuid_text(key: Column) -> Column:
    return F.regexp_replace(
        F.md5(key.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


DASHED_SQL = (
    "regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
)
UUID_SQL = (
    "CASE WHEN bool_and(regexp_full_match({0}, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')) THEN 'UUID' ELSE 'TEXT' END"
)


@query(
    "infer_uuid",
    _expected(
        ("any_uuid", UUID_SQL.format(DASHED_SQL) + " AS target_type FROM orders"),
        ("shorter", UUID_SQL.format(f"substr({DASHED_SQL}, 2)") + " AS target_type FROM orders"),
    ),
)
def infer_uuid(t: Tables) -> DataFrame:
    text = uuid_text(F.col("o_orderkey"))
    return types_of(t.orders.select(text.alias("any_uuid"), F.substring(text, 2, 36).alias("shorter")))


MOMENT_SQL = "CASE WHEN count(*) = count(try_strptime({0}, '{1}')) THEN 'TIMESTAMP' ELSE 'TEXT' END"
SECONDS_SQL = "CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)"


@query(
    "infer_timestamp",
    _expected(
        *[
            (name, MOMENT_SQL.format(f"strftime(ts, '{form}')", form) + " AS target_type FROM events")
            for name, form in (
                ("iso", "%Y-%m-%dT%H:%M:%S.%f"), ("us_day", "%-m/%-d/%Y"), ("eu_day", "%d.%m.%Y %H:%M"), ("clock", "%-H:%M:%S"),
            )
        ],
        ("epoch", "CASE WHEN bool_and(length(" + SECONDS_SQL + ") = 10) THEN 'TIMESTAMP' ELSE 'INTEGER' END AS target_type FROM events"),
        ("seconds", "CASE WHEN bool_and(regexp_full_match(" + SECONDS_SQL + ", '[1-9][0-9]*')) THEN 'INTEGER' ELSE 'TEXT' END"
         " AS target_type FROM events"),
        ("mixed", MOMENT_SQL.format("CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE event_type END",
         "%Y-%m-%dT%H:%M:%S.%f") + " AS target_type FROM events"),
    ),
)
def infer_timestamp(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return types_of(
        t.events.select(
            iso.alias("iso"),
            F.date_format("ts", "M/d/yyyy").alias("us_day"),
            F.date_format("ts", "dd.MM.yyyy HH:mm").alias("eu_day"),
            F.date_format("ts", "H:mm:ss").alias("clock"),
            seconds.alias("epoch"),
            seconds.alias("seconds"),
            F.when(F.col("event_id") % 2 == 0, iso).otherwise(F.col("event_type")).alias("mixed"),
        )
    )


@query(
    "parse_timestamp",
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN ts"
    " WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts)"
    " WHEN 3 THEN TIMESTAMP '1970-01-01' + (date_trunc('second', ts) - date_trunc('day', ts))"
    " WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('day', ts)"
    " ELSE date_trunc('second', ts) - INTERVAL 90 MINUTE END AS at FROM events",
)
def parse_timestamp(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, F.date_format("ts", "M/d/yyyy H:mm:ss"))
        .when(kind == 2, F.date_format("ts", "d.M.yyyy'T'HH:mm"))
        .when(kind == 3, F.date_format("ts", "H:mm:ss"))
        .when(kind == 4, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
        .when(kind == 5, F.date_format("ts", "yyyyMMdd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+01:30'"))
    )
    texts = t.events.select("event_id", text.alias("text"))
    return texts.select(
        "event_id", K.parse_timestamp(F.col("text")).cast("timestamp_ntz").alias("at")
    )


@query(
    "infer_integer",
    _expected(
        ("plain", INTEGER_SQL.format("o_custkey") + " AS target_type FROM orders"),
        ("padded", "CASE WHEN count(*) > 0 THEN 'TEXT' END AS target_type FROM orders"),
        ("huge", "CASE WHEN count(*) > 0 THEN 'FLOAT64' END AS target_type FROM orders"),
    ),
)
def infer_integer(t: Tables) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    return types_of(
        t.orders.select(
            key.alias("plain"),
            F.lpad(key, 12, "0").alias("padded"),
            F.concat(F.lit("9"), F.lpad(key, 20, "0")).alias("huge"),
        )
    )


@query(
    "infer_decimal",
    _expected(
        ("numeric_price", "CASE WHEN count(*) > 0 THEN 'DECIMAL(18,6)' END AS target_type FROM orders"),
        ("price", DOUBLE_SQL.format("o_totalprice") + " AS target_type FROM orders"),
        ("decimal_key", INTEGER_SQL.format("o_orderkey") + " AS target_type FROM orders"),
    ),
)
def infer_decimal(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return types_of(
        t.orders.select(
            price.alias("numeric_price"),
            price.alias("price"),
            F.col("o_orderkey").cast("string").alias("decimal_key"),
        )
    )


@query(
    "infer_double",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN value"
    " WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DOUBLE) ELSE NULL END AS v, 'FLOAT64' AS target_type FROM events",
)
def infer_double(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.lit("+Infinity"))
        .when(kind == 1, F.col("value").cast("string"))
        .when(kind == 2, F.concat(F.col("value").cast("string"), F.lit("e3")))
        .otherwise(F.lit("12d"))
    )
    texts = t.events.select("event_id", text.alias("text"))
    numbers = texts.filter("text <> '12d'").select("text")
    kinds = types_of(numbers).select("target_type")
    # One row: the type of the column without its broken values.
    return texts.crossJoin(kinds).select(
        "event_id", K.parse_double(F.col("text")).alias("v"), "target_type"
    )


@query(
    "contains_nulls",
    "SELECT 'doc_id' AS column_name, count(*) > count(doc_id) AS contains_nulls FROM documents"
    " UNION ALL SELECT 'quality', count(*) > count(quality) FROM documents"
    " LEFT JOIN labels USING (doc_id)",
)
def contains_nulls(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return inference.type_frame(joined).select("column_name", "contains_nulls")


@query(
    "coerce_columns",
    "SELECT o_orderkey, o_orderkey % 2 = 0 AS even, o_totalprice AS price,"
    " CAST(o_totalprice AS DECIMAL(18,6)) AS exact, o_orderdate AS day,"
    " encode(o_orderpriority) AS bytes FROM orders",
)
def coerce_columns(t: Tables) -> DataFrame:
    even = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("inactive"))
    texts = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        even.alias("even"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_totalprice").cast("string").alias("exact"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.col("o_orderpriority").alias("bytes"),
    )
    targets = {
        "o_orderkey": "INTEGER", "even": "BOOLEAN", "price": "FLOAT64", "exact": "DECIMAL(18,6)",
        "day": "TIMESTAMP", "bytes": "BLOB",
    }
    return coercion.coerce_columns(texts, targets).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "coerce_profiles",
    "SELECT o_orderkey, true AS generic, NULL::BOOLEAN AS dump, o_orderkey % 2 = 0 AS sqlite,"
    " CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS workbook_day FROM orders",
)
def coerce_profiles(t: Tables) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    us = F.date_format("o_orderdate", "M/d/yyyy")
    even = F.col("o_orderkey") % 2 == 0
    texts = t.orders.select(
        "o_orderkey",
        F.lit("on").alias("generic"),
        F.lit("active").alias("dump"),
        F.when(even, F.lit("y")).otherwise(F.lit("N")).alias("sqlite"),
        F.when(even, iso).otherwise(us).alias("workbook_day"),
    )
    df = coercion.coerce_columns(texts, {"generic": "BOOLEAN"})
    df = coercion.coerce_columns(df, {"dump": "BOOLEAN"}, "dump")
    df = coercion.coerce_columns(df, {"sqlite": "BOOLEAN"}, "sqlite")
    df = coercion.coerce_columns(df, {"workbook_day": "TIMESTAMP"}, "workbook")
    return df.withColumn("workbook_day", F.col("workbook_day").cast("timestamp_ntz"))


SAMPLE_SQL = " AS target_type FROM (SELECT * FROM labels LIMIT 64)"


@query(
    "infer_from_sample",
    _expected(
        ("doc_id", INTEGER_SQL.format("doc_id") + SAMPLE_SQL),
        ("is_toxic", "CASE WHEN bool_and(toxic IN (0, 1)) THEN 'BOOLEAN' ELSE 'INTEGER' END" + SAMPLE_SQL),
        ("flag_text", WORD_SQL.format("CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END") + SAMPLE_SQL),
        ("created_at", "CASE WHEN bool_and(length(CAST(1700000000 + doc_id AS VARCHAR)) = 10) THEN 'TIMESTAMP' ELSE 'INTEGER' END"
         + SAMPLE_SQL),
        ("note", "CASE WHEN " + " + ".join(f"count(TRY_CAST('note ' || doc_id AS {kind}))" for kind in ("TIMESTAMP", "BOOLEAN", "UUID"))
         + " = 0 THEN 'TEXT' END" + SAMPLE_SQL),
    ),
)
def infer_from_sample(t: Tables) -> DataFrame:
    rows = t.labels.select(
        "doc_id",
        F.col("toxic").alias("is_toxic"),
        F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no")).alias("flag_text"),
        (F.lit(1700000000) + F.col("doc_id")).alias("created_at"),
        F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("note"),
    )
    declared_types = {
        "doc_id": "INTEGER", "is_toxic": "INTEGER", "flag_text": "TEXT", "created_at": "INTEGER",
        "note": "TEXT",
    }
    return inference.refined_frame(rows, declared_types)


CLEAN_SQL = "trim(regexp_replace(trim({0}), '[^A-Za-z0-9]+', '_', 'g'), '_')"
NAMED_SQL = (
    "CASE WHEN {0} = '' THEN 'column_1' WHEN regexp_matches({0}, '^[0-9]') THEN 'column_' || {0} ELSE {0} END"
)


@query(
    "sanitize_names",
    f"SELECT o_orderkey, {NAMED_SQL.format('c')} AS name FROM"
    f" (SELECT o_orderkey, {CLEAN_SQL.format('o_orderpriority')} AS c FROM orders)"
    f" UNION ALL SELECT -1 - doc_id, {NAMED_SQL.format('c')} FROM"
    f" (SELECT doc_id, {CLEAN_SQL.format('text')} AS c FROM documents)",
)
def sanitize_names(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", names.sanitize_column(F.col("o_orderpriority")).alias("name"))
    texts = t.documents.select(
        (F.lit(-1) - F.col("doc_id")).alias("o_orderkey"), names.sanitize_column(F.col("text")).alias("name")
    )
    return orders.unionAll(texts)


RAW_NAMES = (
    "CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' ' || (p_partkey % 7) WHEN 2 THEN p_name"
    " WHEN 3 THEN p_brand || '_2' ELSE 'Brand' END"
)


@query(
    "distinct_names",
    # One row after the other, with the list of all names given so far.
    "WITH RECURSIVE raw AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i,"
    f" {NAMED_SQL.format('c')} AS base FROM (SELECT p_partkey, {CLEAN_SQL.format(RAW_NAMES)} AS c FROM part)),"
    " tried AS (SELECT r.*, row_number() OVER (PARTITION BY base ORDER BY i) + (SELECT count(DISTINCT o.base) FROM raw o"
    " WHERE o.base LIKE r.base || '\\_%' ESCAPE '\\') + 2 AS bound FROM raw r),"
    " named AS (SELECT 0::BIGINT AS i, 0::BIGINT AS p_partkey, '' AS name, ['']::VARCHAR[] AS taken UNION ALL"
    " SELECT i, p_partkey, name, list_append(taken, name) FROM (SELECT t.i, t.p_partkey, n.taken, CASE WHEN"
    " NOT list_contains(n.taken, t.base) THEN t.base ELSE t.base || '_' || list_filter(range(2, t.bound + 1),"
    " lambda x: NOT list_contains(n.taken, t.base || '_' || x))[1] END AS name FROM named n JOIN tried t ON t.i = n.i + 1))"
    " SELECT p_partkey, name FROM named WHERE i > 0",
)
def distinct_names(t: Tables) -> DataFrame:
    """Names that repeat, and names that look like numbered repeats of others."""
    return naming.distinct_names(t.part, F.expr(RAW_NAMES), "p_partkey").select("p_partkey", "name")


# Declared types and their targets, (declared, MySQL target, SQLite target).
DECLARED_TYPES = (
    ("tinyint(1)", "BOOLEAN", "INTEGER"),
    ("bit(1)", "BOOLEAN", "TEXT"),
    ("boolean", "BOOLEAN", "BOOLEAN"),
    ("char(36)", "UUID", "UUID"),
    ("bigint unsigned", "INTEGER", "INTEGER"),
    ("unsigned int", "INTEGER", "INTEGER"),
    ("year", "INTEGER", "TEXT"),
    ("decimal(12,2)", "DECIMAL(12,2)", "DECIMAL(12,2)"),
    ("numeric(9,3)", "DECIMAL(9,3)", "DECIMAL(9,3)"),
    ("numeric", "DECIMAL(18,6)", "DECIMAL(18,6)"),
    ("double precision", "FLOAT64", "FLOAT64"),
    ("varbinary(16)", "BLOB", "TEXT"),
    ("longblob", "BLOB", "BLOB"),
    ("datetime", "TIMESTAMP", "TIMESTAMP"),
    ("time", "TEXT", "TIMESTAMP"),
    ("json", "TEXT", "TEXT"),
    ("", "TEXT", "TEXT"),
)


def declared_columns(t: Tables) -> DataFrame:
    """One declared column per part; its type goes around the list, with a size of its own."""
    kinds = F.array(*[F.lit(d[0]) for d in DECLARED_TYPES])
    size = (F.col("p_partkey") % len(DECLARED_TYPES)).cast("int")
    varchar = F.concat(F.lit("VARCHAR("), F.col("p_size").cast("string"), F.lit(")"))
    declared_type = F.when(F.col("p_size") == 36, varchar).otherwise(F.get(kinds, size))
    return t.part.select("p_partkey", declared_type.alias("declared_type"))


def _declared_sql(target: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{d[target]}'" for i, d in enumerate(DECLARED_TYPES))
    # VARCHAR(36) reads like CHAR(36).
    return (
        f"SELECT p_partkey, CASE WHEN p_size = 36 THEN 'UUID' ELSE CASE p_partkey %"
        f" {len(DECLARED_TYPES)} {cases} END END AS target_type FROM part"
    )


@query("map_mysql_types", _declared_sql(1))
def map_mysql_types(t: Tables) -> DataFrame:
    kind = declared.mysql_target_type(F.col("declared_type"))
    return declared_columns(t).select("p_partkey", kind.alias("target_type"))


@query("map_sqlite_types", _declared_sql(2))
def map_sqlite_types(t: Tables) -> DataFrame:
    kind = declared.sqlite_target_type(F.col("declared_type"))
    return declared_columns(t).select("p_partkey", kind.alias("target_type"))


@query(
    "select_rename_override",
    "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS price,"
    " o_orderpriority AS priority FROM orders",
)
def select_rename_override(t: Tables) -> DataFrame:
    from rowsmith.operators.loads import apply_draft, check_names, draft_table

    texts = render.text_columns(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    draft = draft_table(texts, "orders")
    draft = draft.with_column("o_orderkey", target="id").with_column("o_custkey", selected=False)
    draft = draft.with_column("o_totalprice", target="price", type="DECIMAL(12,2)")
    draft = draft.with_column("o_orderpriority", target="priority")
    check_names([draft])
    return apply_draft(texts, draft)
