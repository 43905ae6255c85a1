"""Projection, filter and reshaping operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number of salt buckets a group is spread over before its final top-n.
TOPN_SALT = 64


def with_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Row map adding or replacing a column with a native expression."""
    return df.withColumn(name, expr)


def batch_map(df: DataFrame, fn: Callable, schema, ) -> DataFrame:
    """B2: a user batch function over pandas frames (Arrow batches).

    ``fn(pandas.DataFrame) -> pandas.DataFrame``; use only when no native
    expression exists.
    """
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def drop_rename(df: DataFrame, drop: Sequence[str] = (), rename: dict | None = None) -> DataFrame:
    """Drop columns and rename others."""
    out = df.drop(*drop)
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def explode_nonnull(df: DataFrame, col: str, keep: Sequence[str] = (), alias: str | None = None) -> DataFrame:
    """One row per list element; null/empty lists and null elements dropped."""
    name = alias or col
    return (df.select(*keep, F.explode_outer(col).alias(name))
              .where(F.col(name).isNotNull()))


def as_list(df: DataFrame, col: str) -> Column:
    """The column as a list, decided from the schema (not from row 0)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType):
        return F.col(col)
    return F.when(F.col(col).isNull(), F.lit(None)).otherwise(F.array(F.col(col)))


def distinct_elements(df: DataFrame, col: str, alias: str = "element") -> DataFrame:
    """Distinct non-null elements of a list column (no order promised)."""
    return explode_nonnull(df, col, alias=alias).select(alias).distinct()


def row_mean(cols: Sequence[str]) -> Column:
    """Mean across columns, nulls skipped; all-null -> NULL."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) == 0, F.lit(None).cast("double")).otherwise(total / F.size(arr))


def concat_rows(*dfs: DataFrame) -> DataFrame:
    """Vertical concatenation by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def exclude(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``chosen`` (anti join)."""
    return df.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def max_length(df: DataFrame, col: str, model_max: int | None = None) -> DataFrame:
    """Longest list in ``col``, capped at the model maximum if given."""
    m = F.max(F.size(col))
    if model_max is not None:
        m = F.least(m, F.lit(model_max))
    return df.agg(m.cast("long").alias("max_length"))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """B14 (global): first ``n`` rows by ``order``; a distributed top-k."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    n: int, rank_col: str = "rank", salt: Column | None = None,
                    salt_buckets: int = TOPN_SALT) -> DataFrame:
    """B14 (per group): first ``n`` rows of every group by ``order``.

    Two stages so that a hot group is never ranked by one task: rows are
    first ranked within ``(group, salt)`` and cut at ``n``, then the
    survivors (at most ``n * salt_buckets`` per group) are ranked within the
    group. ``order`` must be a total order for deterministic output.
    """
    g = list(group_cols)
    if salt is None:
        salt = F.xxhash64(*[F.col(c) for c in df.columns])
    staged = df.withColumn("_salt", F.pmod(salt, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order)
    first = staged.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*g).orderBy(*order)
    return (first.drop("_r", "_salt")
            .withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= n))


def at_least(col, threshold: float) -> Column:
    """Inclusive threshold predicate."""
    c = F.col(col) if isinstance(col, str) else col
    return c >= F.lit(threshold)
