"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat_format, conversation_repair, decontaminate, language_id, ngram_join, pii, quality, token_counts, token_store, url_filter, warc
from .shared import tables

Query = Callable[[SparkSession, str], DataFrame]

#: Texts of more tokens are over the limit.
TOKEN_LIMIT = 1024
END_ID = 2
#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 0
#: A conversation that is all control strings: it must come back as it went in.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
URL_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return out.drop("hits", "items")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(tables(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tables(spark, sf_dir, "pages"), LEAST_PAYLOAD).drop("target")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(tables(spark, sf_dir, "pages"), [url_filter.parse_rule(r) for r in URL_RULES])


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(tables(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(tables(spark, sf_dir, "conversations"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat_format.ASSISTANT).alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.read_back(chat_format.render(chat_format.log(rows.union(own))), arranged=True)


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
  own AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k, w FROM b WHERE len(w) > 0),
  wins AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM own), lens AS (SELECT DISTINCT n FROM wins),
  places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n),
  hits AS (SELECT r, k, p.n, item FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM places) p JOIN wins USING (n, s)),
  items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS i FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
  hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (r) LEFT JOIN hit_words USING (r)"""


def _chat_sql() -> str:
    """Lengths as escaping makes them: an escape character more for each one and for each control string (none overlaps)."""
    t = chat_format.Template()
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    held = lambda x, c: f"(length({x}) - length(replace({x}, {quoted(c)}, ''))) // {len(c)}"
    size = lambda x: f"length({x}) + " + " + ".join(held(x, c) for c in (t.escape, *t.controls))
    frame = len(t.start + t.middle + t.end)
    loss = f"coalesce(string_agg(CASE WHEN role = '{chat_format.ASSISTANT}' THEN text ELSE '' END, '' ORDER BY turn), '')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {quoted(CONTROL_TEXT)}), (-1, 1, '{chat_format.ASSISTANT}', {quoted(CONTROL_TEXT)})))
  SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(length({loss}) AS BIGINT) AS loss_chars, sha256({loss}) AS loss_sha256,
    CAST(sum({frame} + {size("role")} + {size("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


CHAT_SQL = _chat_sql()


def oracle_sql() -> dict[str, str]:
    """SQL for what it can say on whole tables; tests hold the others against brute force."""
    return {"op1_decontaminate": DECONTAMINATE_SQL, "op13_chat_format": CHAT_SQL}
