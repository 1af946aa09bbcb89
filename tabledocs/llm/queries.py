"""The registered queries of the operators, over whole tables, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledocs.llm import substring_dedup
from tabledocs.llm.ann import nearest_neighbours
from tabledocs.llm.collocations import collocations
from tabledocs.llm.common import fold
from tabledocs.llm.decontam import contaminations
from tabledocs.llm.html_pages import extract_pages
from tabledocs.llm.langid import identify_languages
from tabledocs.llm.licenses import scan_licenses
from tabledocs.llm.line_dedup import line_dedup
from tabledocs.llm.packing import pack_documents
from tabledocs.llm.quality import score_quality
from tabledocs.llm.simhash import near_dedup
from tabledocs.llm.url_filter import judge_urls
from tabledocs.llm.variants import variant_groups
from tabledocs.session import read_table


def tokenizer_path() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3).select("doc_id", "fingerprint", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), min_words=0)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_units(substring_dedup.keyed(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "kind", "start", "end", "first_doc_id", "first_start")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(read_table(spark, sf_dir, "documents"), learn=fold("doc_id", 5) != 0)
    return out.select("row.doc_id", F.coalesce(fold("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return scan_licenses(docs, path, keep=("doc_id",))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048, end_id=0)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), max_words=4, min_count=30, contained=80, top=2000)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(read_table(spark, sf_dir, "documents"), noise=199, min_chars=6, min_count=5, ratio=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_decontamination, op4_substring, op5_language, op6_neighbours, op7_licenses, op8_packing, op9_urls, op10_lines,
                                    op11_html, op12_collocations, op13_variants)}


_LINES = """
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)
), repeated AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id IS DISTINCT FROM r.last AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": substring_dedup.ORACLE_SQL, "op10_lines": _LINES}
