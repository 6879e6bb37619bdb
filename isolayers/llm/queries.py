"""One query per operator over its whole table, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, embedding_dedup, html_text, language_id, merkle_manifest, mixing, mpeg_audio, packing, quality_classifier, simhash_dedup, substring_dedup, url_filter, warc_archive,
)
from .common import table
from .oracle_sql import MANIFEST, REPAIR

#: Target weights of the mixture; sources not named share the rest.
TARGETS = {"src0": 0.12, "src1": 0.08, "src2": 0.08, "src3": 0.06}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, interleaved by source to the target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, TARGETS).select("doc_id", "source", "block", "place", "slot", "first_out")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at cosine 0.95 and grouped by links."""
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls, judged by rules and, where none fits, by the classifier."""
    return url_filter.judged_urls(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words that occur more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records over payloads stored once, and read back."""
    return warc_archive.archived_pages(spark, table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages; the text model comes from all documents."""
    return language_id.fused(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt into length buckets and token-budget batches."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored for quality; the labels are learned from rows that are not held out."""
    found = quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as MPEG audio streams, with what reading these back gives."""
    facts = mpeg_audio.media_facts(mpeg_audio.media_column(table(spark, sf_dir, "documents")))
    return facts.select(F.col("id").alias("doc_id"), *facts.columns[1:])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with fingerprints and the components of those within 3 bits."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired by the cheapest edits."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a Merkle tree by source, each with its proof, and a check after tampering."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_embedding_dedup, op3_url_filter, op4_substring_dedup, op5_warc_archive, op6_language_id, op7_packing, op8_quality, op9_mpeg_audio, op10_simhash,
    op11_conversation_repair, op12_merkle_manifest, op13_html_extraction,
)}

ORACLE = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) l FROM v),
        link AS (SELECT a.vec_id a, b.vec_id b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.95),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        comp AS (SELECT a vec_id, min(b) component_id FROM reach GROUP BY a),
        deg AS (SELECT a vec_id, count(*) n FROM link GROUP BY a)
        SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) n_links, c.component_id, c.vec_id = c.component_id kept
        FROM comp c LEFT JOIN deg d USING (vec_id)""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) p FROM d WHERE len(w) >= 35),
        g AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 34], ' ')) h FROM i),
        r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
        x AS (SELECT DISTINCT doc_id, p + o p FROM g SEMI JOIN r USING (h), range(35) t(o)),
        gone AS (SELECT doc_id, count(*) n FROM x GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t FROM words ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(gone.n, 0) AS BIGINT) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n, max(page_id) OVER (PARTITION BY coalesce(html, '')) top FROM pages)
        SELECT page_id, CAST(n AS BIGINT) payload_bytes, sha1(h) payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END refers_to FROM p""",
    "op11_conversation_repair": REPAIR,
    "op12_merkle_manifest": MANIFEST,
}
