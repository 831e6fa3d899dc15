"""The registered queries of the llm operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import bpe, chat, decontam, linededup, media, neardup, pii, quality, sharding, urlfilter
from lanewright.llm.common import table, text_or_empty

CONFLICT = "\\### Assistant: </turn> ok"
VOCABULARY = "word_bpe_49k.json"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = chat.digest_conversations(chat.format_conversations(rows))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return neardup.near_duplicates(documents, neardup.NearDup(words=3, percent=85))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(documents)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = quality.with_quality(documents, quality_model(spark, sf_dir, F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, sf_dir: str, learn: F.Column | None = None) -> quality.CompressionModel:
    """Fitted on the labelled documents for which ``learn`` holds."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where("label IS NOT NULL")
    labels = labels if learn is None else labels.where(learn)
    return quality.fit(table(spark, sf_dir, "documents"), labels)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    size = F.octet_length(text).cast("long") + 1
    records = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign_shards(sharding.external_shuffle(records, size), 16)
    return placed.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, url_labels(spark, sf_dir))


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled urls: the pages' texts, judged by a model of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return urlfilter.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), labels)


def vocabulary_text() -> str:
    return Path(public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_text()).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_pii, op3_near_dedup, op4_decontamination, op5_line_dedup, op6_quality, op7_sharding, op8_media, op9_url_filter, op10_bpe)
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(15 + length(role) + length(text)
                        + (length(text) - length(replace(text, '\', '')))
                        + (length(text) - length(replace(text, '### ', ''))) // 4 + CAST(suffix(text, '###') AS INT)
                        + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id
    """,
    "op4_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents
        ), items AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark
        ), doc_words AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
        ), item_words AS (
            SELECT item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM items
        ), equal AS (
            SELECT DISTINCT doc_id, item_id, n, d.pos - i.pos AS shift, i.pos AS pos FROM doc_words d JOIN item_words i USING (word)
        ), likely AS (
            SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS matched FROM equal
            QUALIFY matched * 100 >= least(13, n) * 80
        ), spread AS (
            SELECT doc_id, item_id, n, shift, matched, pos - o AS start FROM likely, range(0, 13) t(o)
        ), windows AS (
            SELECT doc_id, item_id, n, shift, matched, start FROM spread
            WHERE start >= 1 AND start + least(13, n) - 1 <= n
            GROUP BY ALL HAVING count(*) * 100 >= least(13, n) * 80
        )
        SELECT w.doc_id, w.item_id, max(w.n) AS item_words, max(w.matched) AS matched, count(*) AS windows
        FROM windows w JOIN docs d ON d.doc_id = w.doc_id
        WHERE w.start + w.shift >= 1 AND w.start + w.shift + least(13, w.n) - 1 <= len(d.words)
        GROUP BY w.doc_id, w.item_id
    """,
    "op5_line_dedup": """
        WITH pages AS (
            SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
        ), counted AS (
            SELECT DISTINCT page, source, trim(line) AS line FROM (SELECT page, source, unnest(lines) AS line FROM pages) WHERE trim(line) <> ''
        ), totals AS (
            SELECT source, count(*) AS total FROM pages GROUP BY source
        ), bad AS (
            SELECT c.source, c.line FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
            GROUP BY c.source, c.line, t.total HAVING count(*) - 1 > t.total * CAST(0.05 AS DOUBLE)
        ), of_host AS (
            SELECT source, list(line) AS lines FROM bad GROUP BY source
        ), kept AS (
            SELECT p.doc_id, p.source, p.text, p.lines,
                   CASE WHEN h.lines IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(h.lines, trim(x))) END AS kept
            FROM pages p LEFT JOIN of_host h ON p.source IS NOT DISTINCT FROM h.source
        )
        SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
               CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
        FROM kept
    """,
}
