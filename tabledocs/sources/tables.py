"""Warehouse sources: a folder of parquet tables, or a database over JDBC.

Tables become temp views so guarded SQL and every job read them by name.
JDBC reads are split by a numeric column into parallel range queries; the
driver jars must be on the cluster's classpath.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import list_folder, register_tables

DEFAULT_PORTS = {"postgres": 5432, "redshift": 5439}
REQUIRED = {"postgres": ("host", "database", "user"),
            "redshift": ("host", "database", "user", "password")}


def register_folder(spark: SparkSession, folder: str, names=None) -> list[str]:
    """Every ``<name>.parquet`` in a folder as a view; a missing folder is a
    clear error naming it."""
    found = list_folder(spark, folder)
    if found is None:
        raise FileNotFoundError(f"table folder not found: {folder}")
    if names is None:
        names = [f.removesuffix(".parquet") for f in found if f.endswith(".parquet")]
    return register_tables(spark, folder, names)


def jdbc_url(kind: str, host: str | None, database: str | None, port: int | None = None) -> str:
    """``jdbc:postgresql://host:port/db`` (Redshift speaks the same protocol).
    A port written into ``host`` is ignored in favour of ``port``."""
    h = str(host).split(":")[0]
    return f"jdbc:postgresql://{h}:{port or DEFAULT_PORTS[kind]}/{database}"


def check_settings(kind: str, settings: dict) -> None:
    if kind not in REQUIRED:
        raise ValueError(f"unknown database kind {kind!r}")
    for k in REQUIRED[kind]:
        if not settings.get(k):
            raise ValueError(f"a {kind} connection needs the setting executor.{k}")


def jdbc_options(kind: str, settings: dict, table: str, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None) -> dict:
    check_settings(kind, settings)
    opts = {"url": jdbc_url(kind, settings["host"], settings["database"], settings.get("port")),
            "dbtable": table, "user": settings["user"], "driver": "org.postgresql.Driver",
            "fetchsize": "10000"}
    if settings.get("password"):
        opts["password"] = settings["password"]
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("a partitioned read needs lower, upper and num_partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(num_partitions)})
    return opts


def read_jdbc(spark: SparkSession, kind: str, settings: dict, table: str, **split) -> DataFrame:
    """A database table as a DataFrame; filters and limits are pushed into
    the database query by Spark's JDBC source."""
    return spark.read.format("jdbc").options(**jdbc_options(kind, settings, table, **split)).load()
