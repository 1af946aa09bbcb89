"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All stages but the last
return the columns of ``docs``.

Defined results, beside those of the operators: a stage that gets no rows
returns none. Null texts: language ID rejects them. Repeated rows: the SimHash
stage keeps one row of each group; rows alike in id and text are one document,
whatever their other columns. Columns of any name and type pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledocs.llm.common import fold, row_of, text_key, written
from tabledocs.llm.decontam import decontaminate
from tabledocs.llm.langid import identify_languages
from tabledocs.llm.line_dedup import line_dedup
from tabledocs.llm.packing import pack_documents
from tabledocs.llm.queries import tokenizer_path
from tabledocs.llm.simhash import near_dedup
from tabledocs.session import configure, read_table


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from (row, text)."""
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    configure(spark)
    out = identify_languages(docs, learn=fold("doc_id", 5) != 0)
    return _columns(out.where(~F.col("rejected")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` follows the text."""
    configure(spark)
    out = _columns(line_dedup(docs, min_chars=20, min_docs=3), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    configure(spark)
    # rows alike in id and text are one document, of which one row stays
    keyed = docs.select(F.col("doc_id"), F.col("text"), *text_key("doc_id", "text"), row_of(docs))
    found = near_dedup(keyed, shingle=3, max_bits=3, carry=("k1", "k2"))
    stays = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row"))
             .select("row.k1", "row.k2"))
    one = keyed.select("k1", "k2", "row").join(stays, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    configure(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), min_words=0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece."""
    configure(spark)
    return pack_documents(docs, tokenizer_path(), limit=2048, end_id=0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language models, fingerprints and tokens are beyond SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
