"""URL filter: rules, and gradient-boosted trees on lexical features for the
URLs that no rule fits.

A rule (host, path) fits its host and all subdomains if the URL's path starts
with the rule's; the longest fitting rule wins. The trees are trained on
labelled URLs: those a rule fits, with its verdict. Features are lengths,
depth, digit and symbol ratios, character entropy, parameter counts, and
statistics of the host's suffixes (smoothed block rates, learned from the
labelled URLs; in training without the URL itself).

How it runs
  Features and rules are column expressions: no Python per row. Suffix
  statistics are a partial count before the shuffle, joined by suffix. The
  trees learn from at most about ``fit_rows`` labelled URLs chosen by a hash
  (a classifier's bounded sample) and score all URLs.

Defined results
  null URL or one without ``://``: empty host and path, no rule, judged by the
  trees like any other. No labelled URL: the verdict is ``allow``; labels of
  one kind only: that kind. Repeated rows: judged alike. null id: kept.
  Empty table: empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import unit_hash, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("size", "host_size", "path_size", "depth", "labels", "longest_label", "digits", "marks", "entropy", "host_entropy", "parameters", "has_query", "has_fragment", "secure",
            "rate_1", "rate_2", "seen_1", "seen_2")
_PRIOR = 10.0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the last one tested wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(c: Column) -> Column:
    n = F.length(c)
    kinds = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))

    def part(total, x):
        p = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return total - p * F.log(p)
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), part)).otherwise(0.0)


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def _lexical(url: Column, host: Column, path: Column) -> list[Column]:
    size = F.greatest(F.length(url), F.lit(1))
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return [c.cast("double").alias(n) for n, c in (
        ("size", F.length(url)), ("host_size", F.length(host)), ("path_size", F.length(path)), ("depth", _count(path, "/")), ("labels", F.size(labels)),
        ("longest_label", F.array_max(F.transform(labels, F.length))), ("digits", _count(url, "[0-9]") / size), ("marks", _count(url, "[^A-Za-z0-9./:]") / size),
        ("entropy", _entropy(url)), ("host_entropy", _entropy(host)), ("parameters", F.when(query != "", _count(query, "&") + 1).otherwise(0)),
        ("has_query", F.instr(url, "?") > 0), ("has_fragment", F.instr(url, "#") > 0), ("secure", F.lower(url).startswith("https:")))]


def _suffix(host: Column, k: int) -> Column:
    return F.substring_index(host, ".", -k)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, fit_rows: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """Per row of ``pages``: the id column, host, path, rule, verdict, and
    p_block, the trees' probability of ``block``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, given = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "given": given})
    urls = written(urls.select("id", "host", "path", "rule", "given", _suffix(F.col("host"), 1).alias("suffix_1"), _suffix(F.col("host"), 2).alias("suffix_2"),
                               *_lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")), unit_hash(F.lit("url"), F.col("url")).alias("u")), "urls")
    label = (F.col("given") == "block").cast("double")
    marked = urls.where(F.col("given").isNotNull())
    n, blocked = marked.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0.0))).first()
    overall = blocked / n if n else 0.0
    out, own = urls, F.col("given").isNotNull().cast("double")
    for k in (1, 2):
        stats = marked.groupBy(f"suffix_{k}").agg(F.count("*").cast("double").alias("n"), F.sum(label).alias("b"))
        out = out.join(stats, f"suffix_{k}", "left").fillna({"n": 0.0, "b": 0.0})
        # a labelled URL's own label is left out of its statistics
        rate = (F.col("b") - F.coalesce(label, F.lit(0.0)) + _PRIOR * overall) / (F.col("n") - own + _PRIOR)
        out = out.withColumns({f"rate_{k}": rate, f"seen_{k}": F.log1p(F.col("n") - own)}).drop("n", "b")
    if n == 0 or blocked in (0, n):
        kind = "block" if n and blocked == n else "allow"
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.lit(kind)).alias("verdict"), F.lit(float(kind == "block")).alias("p_block"))
    out = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out)
    sample = written(out.where(F.col("given").isNotNull() & (F.coalesce("u", F.lit(0.0)) < fit_rows / n)).select("features", label.alias("label")), "url-sample")
    if sample.select("label").distinct().count() < 2:
        sample = written(out.where(F.col("given").isNotNull()).select("features", label.alias("label")), "url-sample")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, maxBins=32).fit(sample)
    p = vector_to_array("probability")[1]
    return (model.transform(out).withColumn("p_block", p)
            .select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block"))
