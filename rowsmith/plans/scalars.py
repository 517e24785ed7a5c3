"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.plans.registry import Tables, query


@query("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS v FROM customer")
def fn_abs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("v"))


@query(
    "fn_ceil",
    "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS v, CAST(ceiling(c_acctbal / 10) AS BIGINT)"
    " AS w FROM customer",
)
def fn_ceil(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.ceil("c_acctbal").alias("v"), F.ceiling(F.col("c_acctbal") / 10).alias("w")
    )


@query("fn_floor", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer")
def fn_floor(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.floor("c_acctbal").alias("v"))


@query(
    "fn_mod",
    "SELECT c_custkey, mod(CAST(floor(c_acctbal) AS BIGINT), 7) AS v, c_custkey % 5 AS w FROM customer",
)
def fn_mod(t: Tables) -> DataFrame:
    return t.sql(
        "SELECT c_custkey, mod(floor(c_acctbal), 7L) AS v, c_custkey % 5 AS w FROM customer"
    )


@query("fn_power", "SELECT p_partkey, power(p_size, 3) AS v, pow(p_size, 2) AS w FROM part")
def fn_power(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.power("p_size", F.lit(3)).alias("v"), F.pow("p_size", F.lit(2)).alias("w")
    )


@query(
    "fn_round",
    "SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS v,"
    " CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS DOUBLE) AS w FROM customer",
)
def fn_round(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    return t.customer.select(
        "c_custkey",
        F.round(balance, 1).cast("double").alias("v"),
        F.round(balance, 0).cast("double").alias("w"),
    )


@query("fn_sqrt", "SELECT p_partkey, sqrt(p_size) AS v FROM part")
def fn_sqrt(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.sqrt("p_size").alias("v"))


@query("fn_chr", "SELECT p_partkey, chr(64 + p_size % 26) AS v FROM part")
def fn_chr(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.chr((F.lit(64) + F.col("p_size") % 26)).alias("v"))


@query("fn_hex", "SELECT c_custkey, to_hex(c_custkey) AS v, hex(c_mktsegment) AS w FROM customer")
def fn_hex(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.hex("c_custkey").alias("v"), F.hex("c_mktsegment").alias("w")
    )


@query(
    "fn_instr",
    "SELECT doc_id, CAST(instr(text, 'the') AS INTEGER) AS v, CAST(instr(source, 'c') AS INTEGER)"
    " AS w FROM documents",
)
def fn_instr(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.instr("text", "the").alias("v"), F.instr("source", "c").alias("w")
    )


@query("fn_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS v FROM documents")
def fn_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").alias("v"))


@query(
    "fn_like_escape",
    "SELECT p_partkey, p_brand LIKE 'Brand#1%' ESCAPE '!' AS v, p_brand LIKE '%!#2_' ESCAPE '!'"
    " AS w FROM part",
)
def fn_like_escape(t: Tables) -> DataFrame:
    brand = F.col("p_brand")
    # ``!#`` is a plain ``#``: Spark only lets wildcards be escaped, so it is written bare.
    return t.part.select(
        "p_partkey",
        F.like(brand, F.lit("Brand#1%"), F.lit("!")).alias("v"),
        F.like(brand, F.lit("%#2_"), F.lit("!")).alias("w"),
    )


@query("fn_case", "SELECT doc_id, lower(text) AS v, upper(lang) AS w FROM documents")
def fn_case(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lower("text").alias("v"), F.upper("lang").alias("w"))


@query("fn_replace", "SELECT doc_id, replace(text, 'e', '3') AS v FROM documents")
def fn_replace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.replace("text", F.lit("e"), F.lit("3")).alias("v"))


@query(
    "fn_substr",
    "SELECT doc_id, substr(text, 5, 20) AS v, substring(text, 3) AS w FROM documents",
)
def fn_substr(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        F.substr("text", F.lit(5), F.lit(20)).alias("v"),
        F.substr("text", F.lit(3)).alias("w"),
    )


@query("fn_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS v FROM part")
def fn_trim(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("v")
    )


@query(
    "fn_coalesce",
    "SELECT doc_id, coalesce(quality, toxic, -1) AS v FROM documents LEFT JOIN labels USING (doc_id)",
)
def fn_coalesce(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("v"))


@query("fn_nullif", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS v FROM orders")
def fn_nullif(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("v"))


@query(
    "fn_json_extract",
    "SELECT event_id, json_extract_string(props, '$.k') AS v,"
    " json_extract_string(props, '$.absent') AS w FROM events",
)
def fn_json_extract(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("v"),
        F.get_json_object("props", "$.absent").alias("w"),
    )


@query(
    "fn_json_array",
    "SELECT event_id, CAST(json_array(event_id, user_id) AS VARCHAR) AS v,"
    " CAST(json_array(event_type, event_type) AS VARCHAR) AS w FROM events",
)
def fn_json_array(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.to_json(F.array("event_id", "user_id")).alias("v"),
        F.to_json(F.array("event_type", "event_type")).alias("w"),
    )


@query(
    "fn_json_object",
    "SELECT event_id, CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS v"
    " FROM events",
)
def fn_json_object(t: Tables) -> DataFrame:
    pair = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return t.events.select("event_id", F.to_json(pair).alias("v"))
