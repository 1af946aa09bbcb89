"""License scans: TF-IDF cosine of headers and license texts to templates, and
inheritance along directories.

A file is compared in two ways, each with term weights (term count and inverse
document frequency) of its own kind: its lines that speak of a license, with
short notices; and, where a phrase of license texts stands in it
(``PHRASE``), its legal paragraphs without comment marks, with the full texts of
licenses. The better cosine counts.

A file whose license part makes at least ``file_share`` of its characters, or
whose name says so (``LICENSE``, ``COPYING`` ...), is a license file: its license
holds for its directory and all below it. A file without a license of its own
takes that of the nearest directory upwards that has one.

How it runs
  License parts are cut out by column expressions, so that texts are read once
  and only those parts are shuffled. Document frequencies are counted over all
  parts (partial counts first). The templates are a short list and joined as
  a literal table. Inheritance joins the distinct directories' ancestors with
  the directories that have a license, then files with their directory; no
  grouping stands above that join, so a large directory can be split.

Defined results
  null or empty text: no header, so an inherited license or none. null path:
  the file lies in no directory and inherits nothing. A path on several rows:
  each row is a file. Several license files in a directory: the greatest
  score, then the first license by name. Ties between templates: the first
  license by name; between the two ways: the notice. Empty table: empty
  result. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import quoted, written
from tabledocs.llm.license_texts import FULL, NOTICES

TEMPLATES = NOTICES
CUE = r"(?i)licen[cs]e|licensed|spdx-license|public domain"
#: A word that each phrase holds; phrases of license texts; the words of their paragraphs; marks of comments; names of license files.
WORD = r"(?i)permission|redistribution|software|except|terms"
PHRASE = (r"(?i)permission\s+is\s+hereby\s+granted|redistribution\s+and\s+use\s+in\s+source|permission\s+to\s+use,\s+copy|free\s+software|may\s+not\s+use\s+this\s+file\s+except"
          r"|terms\s+and\s+conditions\s+for\s+use|unencumbered\s+software|subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla")
LEGAL = r"(?i)licen[cs]|copyright|redistribut|permi(?:t|ssion)|warrant|as is|liab|conditions|derivative|contribut|public domain|free software"
COMMENT = r"(?m)^[ \t]*+(?:/\*++|\*++/|\*++|//++|#++|--++|;++|%++|<!--++)?+[ \t\r]*+|(?<![-*])(?:\*++/|--++>)[ \t\r]*+$"
LICENSE_NAME = r"(?i)(?:^|/)(?:licen[cs]es?|copying|unlicen[cs]e|copyright)(?:[.\-_][^/]*)?$"


def _terms(text: Column) -> Column:
    """Letters and digits in runs; ``.`` and ``-`` join digits and letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), 0)


def header(text: Column) -> Column:
    """The lines that speak of a license; null if there are none."""
    return F.when(text.rlike(CUE), F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), "\n"))


def legal_text(text: Column) -> Column:
    """The legal paragraphs of a file in which license texts stand, without
    comment marks (which may stand inside a phrase); null if none do."""
    clean = F.regexp_replace(text, COMMENT, "")
    paragraphs = F.array_join(F.filter(F.split(clean, r"\n\n+"), lambda x: x.rlike(LEGAL)), "\n\n")
    return F.when(text.rlike(WORD), F.when(clean.rlike(PHRASE), paragraphs))


def match_templates(found: DataFrame, templates=TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """``found`` (header): each distinct header's license and score, where the
    best template's cosine is at least ``threshold``."""
    spark = found.sparkSession
    count = found.groupBy("header").agg(F.count("*").alias("n"))
    terms = count.select("header", "n", F.explode(_terms(F.col("header"))).alias("term")).groupBy("header", "n", "term").agg(F.count("*").alias("tf"))
    total = count.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the templates count as documents too, so that each of their terms has a weight
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, text string")
    template_terms = rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    df = (terms.select("term", "n").union(template_terms.select("term", F.lit(1).cast("bigint")))
          .groupBy("term").agg(F.sum("n").alias("df"))
          .select("term", (F.log((1 + total + len(templates)) / (1 + F.col("df"))) + 1).alias("idf")))
    weigh = lambda x, *key: x.join(df, "term").select(*key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    mine, theirs = weigh(terms, "header"), weigh(template_terms, "template", "license")
    norm = lambda x, key: x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    theirs = theirs.join(norm(theirs, "template"), "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("v"))
    dots = mine.join(F.broadcast(theirs), "term").groupBy("header", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm(mine, "header"), "header").select("header", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"))
    return best.select("header", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score")).where(F.col("score") >= threshold)


def directory(path: Column) -> Column:
    """The directory of a path; '' for the top one, null for a null path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).when(path.isNotNull(), "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, as (directory, depth); '' has depth 0."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"), k.alias("depth")))


def scan_licenses(docs: DataFrame, path: Column, text_col: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES, full_texts=FULL, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, path, license, score, origin
    (``own``, ``inherited`` or ``none``) and directory (inherited from)."""
    text = F.col(quoted(text_col))
    parts = written(docs.select(path.alias("path"), header(text).alias("notice"), legal_text(text).alias("legal"), F.length(text).alias("size"))
                    .where(F.col("notice").isNotNull() | F.col("legal").isNotNull()), "license-parts")
    kinds = (("notice", templates, 1), ("legal", full_texts, 0))
    known = {k: written(match_templates(parts.where(F.col(k).isNotNull()).select(F.col(k).alias("header")), t, threshold), "licenses") for k, t, _ in kinds}

    def judged(df: DataFrame) -> DataFrame:
        """``best`` (score, kind, license) of rows with their parts."""
        for k, _, first in kinds:
            # files without the part: a key that no part has, of their own, so that they spread out
            df = df.withColumn(f"__{k}", F.coalesce(F.col(k), F.concat(F.lit("\n\n\n"), F.coalesce("path", F.lit("")))))
            at = F.struct(F.col("score").alias("s"), F.lit(first).alias("first"), F.col("license").alias("l")).alias(f"of_{k}")
            df = df.join(known[k].select(F.col("header").alias(f"__{k}"), at), f"__{k}", "left").drop(f"__{k}")
        return df.withColumn("best", F.greatest(*[F.col(f"of_{k}") for k, _, _ in kinds])).drop(*[f"of_{k}" for k, _, _ in kinds])

    named = judged(parts).where(F.col("best").isNotNull() & F.col("path").isNotNull())
    share = F.length(F.when(F.col("best.first") == 1, F.col("notice")).otherwise(F.col("legal"))) / F.col("size")
    folders = (named.where((share >= file_share) | F.col("path").rlike(LICENSE_NAME)).withColumn("up", F.array_join(F.filter(F.split(directory(F.col("path")), "/"), lambda x: x != ""), "/"))
               .groupBy("up").agg(F.min(F.struct((-F.col("best.s")).alias("s"), F.col("best.l").alias("l"))).alias("b")))
    base = judged(docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep if c not in ("path", "license", "score", "origin", "directory")], F.lit(0).alias("__")).alias("kept"),
                              path.alias("path"), header(text).alias("notice"), legal_text(text).alias("legal")))
    base = base.select("kept", "path", "best", directory(F.col("path")).alias("__dir"))
    tree = base.select("__dir").where(F.col("__dir").isNotNull()).distinct().select("__dir", F.explode(ancestors(F.col("__dir"))).alias("a")).select("__dir", "a.up", "a.depth")
    given = (tree.join(folders, "up").groupBy("__dir").agg(F.max_by(F.struct("up", F.col("b.l").alias("l"), (-F.col("b.s")).alias("s")), "depth").alias("g")))
    out = base.join(given, "__dir", "left")
    mine = F.col("best").isNotNull()
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep if c not in ("path", "license", "score", "origin", "directory")], "path", F.coalesce("best.l", "g.l").alias("license"),
                      F.when(mine, F.col("best.s")).otherwise(F.col("g.s")).alias("score"),
                      F.when(mine, "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("g.up")).alias("directory"))
