"""Build every entity document from a catalog, reusing valid cached samples.

The flow: dedupe entities → fingerprints → cache validity → refresh plan →
head samples for the entities that need them (one union job) → outcome per
entity → sample lines (new or cached) → documents with notes merged → index,
plus the new sample-cache table. The caller writes the outputs
(``docs.write_docs`` / ``export_text``, ``caches.save_sample_cache``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SAMPLE_SIZE
from ..functions.rules import DEFAULT_RULES, ScrubRule, rules_hash
from ..operators import docs as D
from ..operators import samples as SM
from ..operators.catalog import Catalog, dedupe_by_slug
from ..operators.protect import meta_pii_flag


@dataclass
class Generated:
    docs: DataFrame        # project, slug, body
    index: DataFrame       # project, slug (_index), body
    cache: DataFrame       # new sample-cache table (CACHE_SCHEMA)
    actions: DataFrame     # project, slug, action (none / reuse / reuse_warn / use_new)


def _given(spark: SparkSession, tables: dict, plan: DataFrame) -> dict:
    """``{(project, slug): key of tables}`` for the entities to fetch that a
    given table stands for. What reaches the driver is bounded by the tables
    that the caller holds there."""
    keys = [(*k, i) if isinstance(k, tuple) else (None, k, i) for i, k in enumerate(tables)]
    named = spark.createDataFrame(keys, "_project string, _slug string, _i int")
    due = plan.where(F.col("action") == "fetch").select("project", "slug")
    hit = due.join(F.broadcast(named), (F.col("slug") == F.col("_slug")) & F.coalesce(F.col("_project") == F.col("project"), F.lit(True)))
    names = list(tables)
    # a pair is more precise than a slug
    found = sorted(hit.select("project", "slug", "_i").collect(), key=lambda r: isinstance(names[r._i], tuple))
    return {(r.project, r.slug): names[r._i] for r in found}


def _pii_meta(spark: SparkSession, columns: DataFrame, entities: DataFrame, keys: list) -> dict:
    """``{(project, slug): {column: {"pii": True}}}`` for flagged documented
    columns of the entities being sampled (metadata, a handful of rows each)."""
    due = spark.createDataFrame(keys, "project string, slug string")
    flagged = (columns.where(meta_pii_flag(F.col("meta")))
               .join(entities.select("project", "node_id", "slug"), ["project", "node_id"])
               .join(F.broadcast(due), SM.KEY, "left_semi").select("project", "slug", "name").collect())
    out: dict = {}
    for r in flagged:
        out.setdefault((r.project, r.slug), {})[r.name] = {"pii": True}
    return out


def generate(spark: SparkSession, catalog: Catalog, tables: dict | None,
             sections: DataFrame | None = None, existing: DataFrame | None = None,
             cache: DataFrame | None = None, sample_size: int = SAMPLE_SIZE,
             refresh_all: bool = False, refresh: list | None = None,
             rules: tuple[ScrubRule, ...] = DEFAULT_RULES) -> Generated:
    """``tables`` maps slugs, or ``(project, slug)`` pairs, to DataFrames that
    can be sampled (``None``: no warehouse, only cached samples are used); a
    slug alone stands for that relation in every project. A table that can't
    be read leaves its own entity without new samples. ``cache`` is the
    current sample-cache table (empty when absent)."""
    ents = dedupe_by_slug(catalog.entities)
    fps = SM.entity_fingerprints(catalog.columns)
    obf = rules_hash(rules)
    cache = cache if cache is not None else spark.createDataFrame([], SM.CACHE_SCHEMA)
    validity = SM.cache_validity(ents, fps, cache, obf)
    plan = SM.refresh_plan(validity, sample_size, refresh_all, refresh, can_fetch=tables is not None)

    given = _given(spark, tables, plan) if tables else {}
    fresh = (SM.samples_long({k: (tables[t], None) for k, t in given.items()}, sample_size,
                             _pii_meta(spark, catalog.columns, ents, list(given)), rules) if given else None)
    if fresh is None:
        fresh = spark.createDataFrame([], SM.LONG_SCHEMA)
    actions = SM.after_fetch(plan, fresh).select(*SM.KEY, "action")

    use_new = actions.where(F.col("action") == "use_new").select(*SM.KEY)
    reuse = actions.where(F.col("action").isin("reuse", "reuse_warn")).select(*SM.KEY)
    cached_long = SM.long_from_cache(cache.join(reuse, SM.KEY, "left_semi"))
    new_long = fresh.join(use_new, SM.KEY, "left_semi")
    lines = SM.transposed_lines(new_long.unionByName(cached_long))

    docs, index = D.build_docs(ents, catalog.columns, catalog.lineage, sections, lines, existing)
    new_rows = SM.cache_rows(new_long, ents, fps, catalog.columns, obf)
    kept = cache.join(use_new, SM.KEY, "left_anti")
    return Generated(docs, index, kept.unionByName(new_rows), actions)
