"""Thin queries over the operators, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import alignment, decontamination, exact_dedup, language, mixing, neighbours, personal_data, prefix_trie, pseudo_likelihood, simhash, token_counts, token_files, toxicity
from rowsmith.llm.common import saved, table, word_count
from rowsmith.llm.queries import query
from rowsmith.session import scratch_folder

#: Second version of the word tokenizer: runs of ASCII letters, single digits, any other single character.
WORDS_2 = r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]"

COUNTS_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, COALESCE(length(text), 0) AS chars,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words_1,
    COALESCE(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]')), 0) AS words_2,
    min(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS first_id FROM documents)
SELECT source, lang, tokenizer, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens
FROM (
  SELECT source, lang, 'chars-1' AS tokenizer, chars AS tokens FROM counted WHERE doc_id = first_id
  UNION ALL SELECT source, lang, 'words-1', words_1 FROM counted WHERE doc_id = first_id
  UNION ALL SELECT source, lang, 'words-2', words_2 FROM counted WHERE doc_id = first_id)
GROUP BY source, lang, tokenizer
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    sum(source_size) OVER ()::BIGINT AS budget FROM sums),
dry AS (SELECT *, (3 * source_size)::DOUBLE / weight AS dry_at FROM weighed),
levels AS (
  SELECT *, (budget - COALESCE(sum(3 * source_size) OVER (
      ORDER BY dry_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY dry_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM dry),
targets AS (
  SELECT *, least((3 * source_size)::DOUBLE,
    (max(CASE WHEN own <= dry_at THEN own END) OVER ()) * weight) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.source, d.size, t.weight, t.budget, turn, md5(concat(d.doc_id, ':', turn)) AS key
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  CROSS JOIN (VALUES (0), (1), (2)) AS turns(turn) WHERE d.size > 0),
timed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY turn, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / weight AS finish FROM queued),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM timed),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM summed WHERE running <= budget GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, COALESCE(k.taken, 0)::BIGINT AS taken, d.source, t.weight
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.doc_id = d.doc_id
"""


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), path, end_id=0)


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.personal_data(table(spark, sf_dir, "documents")))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_counts", COUNTS_SQL)
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus arrives with declared lengths, those are recounted, a second word tokenizer comes, copies are withdrawn.

    Every batch is delivered twice, as a retried job would.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    words_2 = F.coalesce(F.regexp_count("text", F.lit(WORDS_2)), F.lit(0)).cast("long")
    counted = docs.select(
        "doc_id", "source", "lang", "n_chars", F.char_length(text).cast("long").alias("chars"),
        word_count(F.col("text")).alias("words_1"), words_2.alias("words_2"), F.md5(text).alias("content"),
    )
    counted = saved(counted, "counted")
    first = counted.groupBy(F.col("content").alias("f_content")).agg(F.min("doc_id").alias("first_id"))
    copies = counted.join(first, F.col("content") == F.col("f_content")).filter("doc_id != first_id")

    def under(rows: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_chars", F.col(tokens).alias("tokens"))

    declared, words = under(counted, "chars-1", "n_chars"), under(counted, "words-1", "words_1")
    gone = [under(copies, t, c) for t, c in (("chars-1", "chars"), ("words-1", "words_1"), ("words-2", "words_2"))]
    batches = {
        "1-arrival": token_counts.all_of(token_counts.inserted(declared), token_counts.inserted(words)),
        "2-recount": token_counts.revised(under(counted, "chars-1", "chars"), "n_chars", "tokens"),
        "3-second-tokenizer": token_counts.inserted(under(counted, "words-2", "words_2")),
        "4-copies-withdrawn": token_counts.all_of(*map(token_counts.deleted, gone)),
    }
    totals = token_counts.TokenCounts(spark, scratch_folder(spark, "token-counts"))
    for _ in range(2):
        for batch_id, changes in batches.items():
            totals.apply(batch_id, changes)
    totals.compact()
    return totals.totals()


@query("op8_pseudo_likelihood")
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))
"""


@query("op13_exact_dedup", COPIES_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), *paths)


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS num, digest, bytes
  FROM (SELECT conv_id, turn, strlen(COALESCE(text, '')) AS bytes,
          md5(concat(length(COALESCE(role, '')), ':', COALESCE(role, ''), COALESCE(text, ''))) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv, conv - conv % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM turns GROUP BY conv),
kept AS (
  SELECT c.conv, 0 AS part, t.num, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv = c.base AND t.num <= c.h
  UNION ALL SELECT c.conv, 1, t.num, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv = c.conv AND t.num > c.h),
placed AS (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY part, num) AS depth, digest, bytes FROM kept),
paths AS (
  SELECT conv, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv, 0, 0, '' FROM convs),
occurrences AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM paths),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
    sha256(COALESCE(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
  FROM occurrences GROUP BY path),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth::BIGINT - 1))),
children AS (
  SELECT left(path, 32 * (depth::BIGINT - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT f.*, COALESCE(n_children, 0) AS n_children FROM family f LEFT JOIN children c ON c.path = f.path),
totals AS (
  SELECT o.path, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum(c.own) AS saved_tokens
  FROM counted c JOIN occurrences o ON o.conv = c.conv_id AND o.depth <= c.depth GROUP BY o.path)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN totals USING (path)
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
