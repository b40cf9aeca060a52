"""Table sources: Parquet, JDBC, or any function that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.types import is_key

#: Keys that a read is told by name.
FEW = 200
ORDINALS = (T.LongType, T.TimestampNTZType, T.TimestampType)


class Source:
    """keys: names of the key columns. read: all rows. listing: keys and `_ordinal` without values. values: the rows of some
    keys. fetched: whether values come one by one at a price, so that they are kept rather than read again."""

    keys: list[str]
    fetched = False

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def schema(self) -> T.StructType:
        return self._schema

    @cached_property
    def _schema(self) -> T.StructType:
        return self.read(SparkSession.active()).schema

    def ordinal(self) -> str | None:
        return None

    def listing(self, spark: SparkSession) -> DataFrame:
        """Catalyst prunes the scan to the columns asked for here."""
        name = self.ordinal()
        rows = self.read(spark)
        return rows.select(*self.keys, ordinal_of(name, rows.schema).alias("_ordinal"))

    def values(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        return self.read(spark).join(keys, self.keys, "left_semi")

    def told(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """Values of keys that were told to have changed, which are few as a rule."""
        return self.values(spark, keys)


def ordinal_of(name: str | None, schema: T.StructType):
    """An integer as it is, a time in µs; null without an ordinal."""
    if not name:
        return F.lit(None).cast("bigint")
    return F.col(name) if isinstance(schema[name].dataType, T.LongType) else F.unix_micros(F.col(name).cast("timestamp"))


class Table(Source):
    """Rows of a DataFrame with a key. included: columns to read; filter: a SQL predicate, pushed to the scan; ordinal:
    a column of an integer or a time, not part of the key, that grows with each version of a row."""

    def __init__(self, open_: Callable[[SparkSession], DataFrame], keys: list[str], included_columns: list[str] | None = None, ordinal_column: str | None = None, filter: str | None = None):
        if not keys:
            raise ValueError("a table source needs a primary key")
        if ordinal_column in keys:
            raise ValueError("the ordinal column can't be part of the key")
        self.open, self.keys, self.included, self.ordinal_column, self.filter = open_, list(keys), included_columns, ordinal_column, filter

    def ordinal(self) -> str | None:
        return self.ordinal_column

    def read(self, spark: SparkSession) -> DataFrame:
        df = self.open(spark)
        for k in self.keys:
            if not is_key(widened(df.schema[k])):
                raise ValueError(f"{k}: {df.schema[k].dataType.simpleString()} can't be a key")
        if self.ordinal_column and not isinstance(widened(df.schema[self.ordinal_column]).dataType, ORDINALS):
            raise ValueError(f"{self.ordinal_column} can't be an ordinal")
        df = df.where(self.filter) if self.filter else df
        wanted = df.columns if self.included is None else [c for c in df.columns if c in {*self.keys, *self.included}]
        return df.select(*[F.col(f"`{c}`").cast(widened(df.schema[c]).dataType).alias(c, metadata=df.schema[c].metadata) for c in wanted])

    def told(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """Few keys are named in a filter, which reaches a database or a file's statistics."""
        some = keys.select(*self.keys).limit(FEW + 1).collect()
        if len(some) > FEW:
            return self.values(spark, keys)
        one = lambda r: reduce(and_, [F.col(k).eqNullSafe(F.lit(r[k])) if r[k] is None else F.col(k) == F.lit(r[k]) for k in self.keys])
        found = list(map(one, some)) or [F.lit(False)]
        while len(found) > 1:  # in pairs, so that the expression isn't deep
            found = [a | b for a, b in zip(found[::2], found[1::2])] + found[len(found) // 2 * 2 :]
        return self.read(spark).where(found[0])


def widened(f: T.StructField) -> T.StructField:
    """The only integer is 64 bits wide."""
    return T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType, f.nullable, f.metadata)


def parquet_table(path: str, keys: list[str], **options) -> Table:
    return Table(lambda spark: spark.read.parquet(path), keys, **options)


def jdbc_table(url: str, table: str, keys: list[str], properties: dict | None = None, **options) -> Table:
    """Column choice and filter reach the database; partitioned reads come from `partitionColumn` and its bounds."""
    return Table(lambda spark: spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {})).load(), keys, **options)


@dataclass
class CustomSource(Source):
    """A connector: list_rows and get_value make DataFrames; get_value joins values to keys that are asked for."""

    keys: list[str]
    list_rows: Callable[[SparkSession], DataFrame]
    get_value: Callable[[SparkSession, DataFrame], DataFrame]
    fetched = True

    def read(self, spark: SparkSession) -> DataFrame:
        return self.get_value(spark, self.list_rows(spark)).drop("_ordinal")

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = self.list_rows(spark)
        return rows if "_ordinal" in rows.columns else rows.withColumn("_ordinal", F.lit(None).cast("bigint"))

    def values(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        return self.get_value(spark, keys).drop("_ordinal")


def source_connector(keys: list[str]):
    """A class with `list_rows(spark)` and `get_value(spark, keys)` becomes a source when it is called."""

    def wrap(cls):
        def make(*args, **kwargs):
            made = cls(*args, **kwargs)
            return CustomSource(keys, made.list_rows, made.get_value)

        return make

    return wrap
