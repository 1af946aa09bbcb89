"""Run declared column tests on the data.

Semantics follow the public meaning of the four generic tests: ``unique``
(values seen more than once), ``not_null``, ``accepted_values`` and
``relationships`` (child values missing from the parent). Nulls pass every
test except ``not_null``.

Scale: a report (:func:`run_tests`) scans each table once, however many tests
are declared on it. A row gives one short entry (test, key) for each key test
and one for each row test it fails; entries are counted per test and key in
each task before one shuffle, so a key holding a third of the rows costs one
row per task. Nothing runs while a report is planned.

Keys: integers, dates and times are compared by value, all other keys by a
128-bit hash (two 64-bit hashes with seeds of their own) in the report; the
functions that list failing keys compare the values themselves. Maps compare
by their sorted entries, variants by their JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.testtext import declared_text, kwargs_json


def _cols(column) -> list[str]:
    return [column] if isinstance(column, str) else list(column)


_WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _holds(kind: T.DataType, what: type) -> bool:
    """Whether a type is, or holds, another."""
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, what)
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, what) for f in kind.fields)
    return isinstance(kind, what) or isinstance(kind, T.MapType) and (_holds(kind.keyType, what) or _holds(kind.valueType, what))


def _comparable(c: Column, kind: T.DataType) -> Column:
    """The value in a form that groups and hashes as it compares."""
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if _holds(kind, T.VariantType) or _holds(kind, T.MapType):
        if isinstance(kind, T.MapType) and not _holds(kind.keyType, T.MapType) and not _holds(kind.valueType, T.MapType) and not _holds(kind.valueType, T.VariantType):
            # a null map stays null, so it is no key
            return F.array_sort(F.map_entries(c))
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c


def failing_unique(df: DataFrame, column) -> DataFrame:
    """Key values that occur more than once, with their row count.

    Fixed-width keys are counted directly (partial counts per task before
    the shuffle). Wide keys (long texts) are first counted by a 128-bit hash
    so only hashes are shuffled; the rows of candidate hashes are then
    grouped by their real value, which keeps the answer exact. The candidates
    are joined as their size allows (adaptive execution broadcasts few).
    """
    cols = _cols(column)
    kinds = [df.schema[c].dataType for c in cols]
    keyed = df.select(*[_col(c) for c in cols])
    for c in cols:
        keyed = keyed.where(_col(c).isNotNull())
    if not any(isinstance(k, _WIDE) for k in kinds):
        return (keyed.groupBy(*[_col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n_records"))
                .where(F.col("n_records") > 1))
    keys = [_comparable(_col(c), k) for c, k in zip(cols, kinds)]
    hashed = keyed.select(F.struct(*[_col(c) for c in cols]).alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), *_hash_pair(keys))
    cand = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h1", "h2")
    rows = hashed.join(cand, ["h1", "h2"], "left_semi")
    return (rows.groupBy("key").agg(F.any_value("row").alias("row"), F.count(F.lit(1)).alias("n_records"))
            .where(F.col("n_records") > 1).select("row.*", "n_records"))


def _hash_pair(keys: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *keys).alias(f"h{seed}") for seed in (1, 2)]


def failing_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(_col(column).isNull())


def _unaccepted(df: DataFrame, column: str, values: list, quote: bool):
    """Condition: a value outside the list. Quoted values are texts, which
    Spark reads as the column's type (``True`` and ``true`` as a boolean); a
    text that is no value of that type is equal to none."""
    c, kind = _col(column), df.schema[column].dataType
    if _holds(kind, T.MapType) or _holds(kind, T.VariantType):
        raise ValueError(f"accepted values need a column of plain values: {column!r} is {kind.simpleString()}")
    listed = [F.lit(str(v)).try_cast(kind) if quote else F.lit(v) for v in values]
    return c.isNotNull() & ~F.coalesce(c.isin(*listed), F.lit(False))


def failing_accepted_values(df: DataFrame, column: str, values: list, quote: bool = True
                            ) -> DataFrame:
    """Distinct values outside the accepted list, with their row count. The
    list is a literal set (a declared list is small by nature)."""
    return (df.where(_unaccepted(df, column, values, quote))
            .groupBy(_col(column)).agg(F.count(F.lit(1)).alias("n_records")))


def failing_relationships(child: DataFrame, column: str, parent: DataFrame, field: str
                          ) -> DataFrame:
    """Child values with no parent row, with their row count.

    The child side is reduced to distinct keys with counts first (partial
    aggregation before the exchange), then outer-joined with the parent's
    distinct keys and kept where no parent matched. (An anti join would be
    pushed below the aggregate by the optimizer and shuffle raw child rows
    by a possibly hot key; the outer join keeps both sides at one row per
    key.) Catalyst picks broadcast or sort-merge by size.
    """
    kind = child.schema[column].dataType
    keys = (child.where(_col(column).isNotNull()).select(_col(column).alias("value"), _comparable(_col(column), kind).alias("key")).groupBy("key")
            .agg(F.any_value("value").alias("value"), F.count(F.lit(1)).alias("n_records")))
    parents = (parent.select(_comparable(_col(field), parent.schema[field].dataType).alias("of")).where(F.col("of").isNotNull()).distinct())
    return (keys.join(parents, F.col("key") == F.col("of"), "left").where(F.col("of").isNull())
            .select(F.col("value").alias(column), "n_records"))


@dataclass
class DeclaredTest:
    table: str
    column: str | list[str]
    test: str                      # unique | not_null | accepted_values | relationships
    kwargs: dict = field(default_factory=dict)


def failures(test: DeclaredTest, tables: dict[str, DataFrame]) -> DataFrame:
    """Failing rows/keys of one declared test (shape depends on the test)."""
    df = tables[test.table]
    if test.test == "unique":
        return failing_unique(df, test.column)
    if test.test == "not_null":
        return failing_not_null(df, test.column)
    if test.test == "accepted_values":
        return failing_accepted_values(df, test.column, test.kwargs["values"],
                                       test.kwargs.get("quote", True))
    if test.test == "relationships":
        return failing_relationships(df, test.column, tables[test.kwargs["to"]],
                                     test.kwargs["field"])
    raise ValueError(f"unknown test {test.test!r}")


RESULT_SCHEMA = ("test_pos int, table_name string, column_name string, test_name string, "
                 "test_text string, failures bigint, status string")


def _key(columns: list[tuple[Column, T.DataType]]) -> list[Column]:
    """(k1, k2) of a key: one whole number as it is, else a 128-bit hash."""
    c, kind = columns[0]
    if len(columns) == 1 and isinstance(kind, _WHOLE):
        if isinstance(kind, T.DateType):
            whole = F.unix_date(c)
        elif isinstance(kind, T.TimestampNTZType):
            whole = F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.lit("UTC")))
        else:
            whole = F.unix_micros(c) if isinstance(kind, T.TimestampType) else c
        return [whole.cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2")]
    # zero has one sign
    keys = [c + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else _comparable(c, kind) for c, kind in columns]
    return [h.alias(f"k{i}") for i, h in enumerate(_hash_pair(keys), 1)]


def _common(child: DataFrame, column: str, parent: DataFrame, field: str) -> T.DataType:
    """The type in which Spark compares a child's values with a parent's."""
    kinds = child.schema[column].dataType, parent.schema[field].dataType
    if kinds[0] == kinds[1] or any(_holds(k, w) for k in kinds for w in (T.MapType, T.VariantType)):
        return kinds[0]
    both = F.coalesce(F.lit(None).cast(kinds[0]), F.lit(None).cast(kinds[1]))
    return child.sparkSession.range(0).select(both.alias("c")).schema["c"].dataType


#: What an entry counts for: a row of the tested table, or a key of its parent.
_CHILD, _PARENT = 1, 0


def _entries(tests: list[DeclaredTest], tables: dict[str, DataFrame]) -> dict[str, list[Column]]:
    """Per table the entries (test, k1, k2, side) a row of it gives; null for none."""
    out: dict[str, list[Column]] = {}

    def add(table: str, i: int, given: Column, key: list[Column], side: int) -> None:
        out.setdefault(table, []).append(F.when(given, F.struct(F.lit(i).alias("test"), *key, F.lit(side).alias("side"))))

    none = [F.lit(None).cast("bigint").alias(k) for k in ("k1", "k2")]
    for i, t in enumerate(tests):
        df, cols = tables[t.table], _cols(t.column)
        if t.test == "not_null":
            add(t.table, i, _col(cols[0]).isNull(), none, _CHILD)
        elif t.test == "accepted_values":
            add(t.table, i, _unaccepted(df, cols[0], t.kwargs["values"], t.kwargs.get("quote", True)), none, _CHILD)
        elif t.test == "unique":
            given = F.lit(True)
            for c in cols:
                given = given & _col(c).isNotNull()
            add(t.table, i, given, _key([(_col(c), df.schema[c].dataType) for c in cols]), _CHILD)
        elif t.test == "relationships":
            to, field = t.kwargs["to"], t.kwargs["field"]
            kind = _common(df, cols[0], tables[to], field)
            for table, name, side in ((t.table, cols[0], _CHILD), (to, field, _PARENT)):
                plain = tables[table].schema[name].dataType == kind
                add(table, i, _col(name).isNotNull(), _key([(_col(name) if plain else _col(name).cast(kind), kind)]), side)
        else:
            raise ValueError(f"unknown test {t.test!r}")
    return out


def run_tests(tests: list[DeclaredTest], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per declared test: table, column, test text, failing rows and
    status. Each table is scanned once; the test list is metadata (driver
    side)."""
    if not tables:
        raise ValueError("no tables to test")
    spark = next(iter(tables.values())).sparkSession
    if not tests:
        return spark.createDataFrame([], RESULT_SCHEMA)
    given = None
    for table, entries in _entries(tests, tables).items():
        one = tables[table].select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        given = one if given is None else given.unionByName(one)
    keys = given.groupBy("test", "k1", "k2").agg(F.sum("side").alias("n"), F.min("side").alias("low"))
    # one row per test and kind, from which each takes what it counts
    bad = keys.groupBy("test").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("repeated"),
                                   F.sum(F.when(F.col("low") == _CHILD, F.col("n"))).alias("orphans"))
    rows = [(i, t.table, ",".join(_cols(t.column)), t.test, kwargs_json(t.kwargs)) for i, t in enumerate(tests)]
    declared = (spark.createDataFrame(rows, "test_pos int, table_name string, column_name string, test_name string, kwargs string")
                .withColumn("test_text", declared_text(F.col("test_name"), F.col("kwargs"))))
    failures = F.when(F.col("test_name") == "unique", F.col("repeated")).when(F.col("test_name") == "relationships", F.col("orphans")).otherwise(F.col("rows"))
    return (declared.join(bad, F.col("test_pos") == F.col("test"), "left")
            .select("test_pos", "table_name", "column_name", "test_name", "test_text", F.coalesce(failures, F.lit(0)).cast("long").alias("failures"))
            .withColumn("status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.lit("fail"))))
