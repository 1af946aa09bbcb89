"""Document-corpus source: a folder of markdown files as ``(name, text)``.

Files are read whole and in parallel; ``name`` is the file name without
``.md``. The index file is skipped. Any ``(id, text)`` table serves the
same operators through ``search.as_corpus``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import INDEX_FILE
from .textfiles import read_files


def read_markdown_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = read_files(spark, folder, suffix=".md")
    if files is None:
        files = (spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
                 .select(F.col("_metadata.file_name").alias("shown"), F.col("value").alias("text")))
    return (files.where(F.col("shown") != INDEX_FILE)
            .select(F.regexp_replace("shown", r"\.md$", "").alias("name"), "text"))
