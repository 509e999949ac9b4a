"""Citation payloads: every passage with what is needed to trace it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.text import half_even

RETRIEVAL_ID = "deterministic_lexical_v2"
LEGACY_KIND = "main_legacy_inferred"

# The curated catalog, one record for each work.
CATALOG_SCHEMA = "work_uri string, title_ar string, title_latin string, source_name string, source_url string, source_record_id string, verified_on string, notes string"
CATALOG = (
    (
        "0595IbnRushdHafid.BidayatMujtahid",
        "بداية المجتهد ونهاية المقتصد",
        "Bidāyat al-mujtahid wa-nihāyat al-muqtaṣid",
        "BnF Catalogue général",
        "https://catalogue.bnf.fr/ark:/12148/cb32268155q",
        "cb32268155q",
        "2026-08-22",
        "The BnF record verifies the work title/identity. It is not used to claim edition or pagination identity with the OpenITI version.",
    ),
)

# Provenance texts.
SOURCE_NOTE = "The display title comes from ingested OpenITI work metadata after placeholder filtering. No independent catalogue verification is registered for this work URI."
NO_TITLE_NOTE = "No reliable display title is registered for this work URI."


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def structure(content_kind: Column, section_path: Column) -> tuple[Column, Column]:
    """Provenance and status of a chunk's place in the text."""
    legacy, explicit = content_kind == LEGACY_KIND, F.size(section_path) > 0
    return (
        F.when(legacy, "legacy_pipe_inferred").when(explicit, "openiti_explicit").otherwise("none"),
        F.when(legacy, "INFERRED").when(explicit, "SOURCE_EXPLICIT").otherwise("NONE"),
    )


def with_bibliography(results: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the display title and ``bibliographic_provenance``: catalog, else source metadata, else none.
    The catalog is a handful of curated rows, kept in code, and goes to the results."""
    r = F.broadcast(records.select(F.col("work_uri"), F.struct("title_ar", "title_latin", "source_name", "source_url", "source_record_id", "verified_on", "notes").alias("__record")))
    joined = results.join(r, "work_uri", "left")
    x, title = F.col("__record"), F.col("work_title")

    def told(status, scope, name, url, record, verified, notes):
        parts = {"verification_status": status, "scope": scope, "source_name": name, "source_url": url, "source_record_id": record, "verified_on": verified, "notes": notes}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in parts.items()])

    provenance = (
        F.when(x.isNotNull(), told("VERIFIED_EXTERNAL_CATALOG", "work_title_identity", x["source_name"], x["source_url"], x["source_record_id"], x["verified_on"], x["notes"]))
        .when(F.length(title) > 0, told("SOURCE_METADATA", "ingested_openiti_work_metadata", "OpenITI work metadata", None, F.col("work_uri"), None, SOURCE_NOTE))
        .otherwise(told("UNVERIFIED", "none", None, None, None, None, NO_TITLE_NOTE))
    )
    return joined.withColumns(
        {"work_display": F.when(x.isNotNull(), x["title_ar"]).otherwise(title), "work_title_ar": x["title_ar"], "work_title_latin": x["title_latin"], "bibliographic_provenance": provenance}
    ).drop("__record")


CITATION = (
    "author_name", "author_uri", "work_display", "work_uri", "work_title", "work_title_ar", "work_title_latin", "bibliographic_provenance", "version_uri", "volume", "page", "page_side", "section_path", "section_title",
    "structure_provenance", "structure_status", "content_kind", "chunk_id", "text_hash", "source_start", "source_end", "source_text_sha256", "source_metadata_sha256", "quality_status", "quality_issues", "provider", "source_url", "release",
)
_RENAMED = {"author_name": "author", "work_display": "work", "work_title": "work_title_source_metadata"}


def payload(results: DataFrame, records: DataFrame, preview_chars: int | None = None) -> DataFrame:
    """(query_id, rank, score, ..., citation, passage_original, passage_normalized), one row a result."""
    if preview_chars is not None and not 100 <= preview_chars <= 5000:
        raise ValueError("preview_chars must be between 100 and 5000")
    full = with_bibliography(results, records)
    provenance, status = structure(F.col("content_kind"), F.col("section_path"))
    full = full.withColumns({"structure_provenance": provenance, "structure_status": status})
    rights = F.struct(*[F.col(c) for c in ("license", "copyright_status", "commercial_use_allowed", "attribution_required") if c in full.columns])
    citation = F.struct(*[F.col(c).alias(_RENAMED.get(c, c)) for c in CITATION if c in full.columns], rights.alias("rights"))
    original = F.col("text_original") if preview_chars is None else F.substring("text_original", 1, preview_chars)
    return full.select(
        "query_id", "rank", half_even(F.col("score")).alias("score"), half_even(F.col("coverage")).alias("coverage"), "matched_terms", "total_terms", "phrase_hits", "term_hits", "section_hits",
        citation.alias("citation"), original.alias("passage_original"), F.col("text_normalized").alias("passage_normalized"),
    )


#: The fields of an answer, in their order.
ANSWER = ("query", "normalized_query", "terms", "count", "retrieval", "generated_answer", "results")


def response(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query, as the JSON answer has it, without results where there are none; no answer is ever generated."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in results.columns if c not in ("query_id", "rank")]))).alias("results"))
    held = queries.join(rows, "query_id", "left")
    told = F.coalesce("results", F.array().cast(rows.schema["results"].dataType))
    return held.select("query_id", "query", F.col("normalized").alias("normalized_query"), "terms", F.size(told).alias("count"), F.lit(RETRIEVAL_ID).alias("retrieval"), F.lit(None).cast("string").alias("generated_answer"), told.alias("results"))
