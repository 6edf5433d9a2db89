"""Checks of schemas, and of rows as they pass.

Wrong types and depths raise ``TypeError`` or ``ValueError`` when the plan is made. What
only the rows can tell (ploidy, lengths) is an expression: the query fails at the first
row that breaks it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def check_type(df: DataFrame, column: str, expected: type | Sequence[type]) -> None:
    """The column's type is one of the given ones."""
    kinds = tuple(expected) if isinstance(expected, Sequence) else (expected,)
    if not isinstance(_type(df, column), kinds):
        raise TypeError(f"{column}: expected {' or '.join(k.__name__ for k in kinds)}, found {_type(df, column).simpleString()}")


def ndim(df: DataFrame, column: str) -> int:
    """Dimensions with the rows as the first one."""
    n, t = 1, _type(df, column)
    while isinstance(t, T.ArrayType):
        n, t = n + 1, t.elementType
    return n


def _element(df: DataFrame, column: str) -> T.DataType:
    t = _type(df, column)
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t


def check_ndim(df: DataFrame, column: str, *allowed: int) -> None:
    """Genotypes have 3 dimensions, haplotypes and allele counts 2, positions 1."""
    if ndim(df, column) not in allowed:
        raise TypeError(f"{column}: expected {' or '.join(map(str, allowed))} dimensions, found {ndim(df, column)}")


def check_same_ndim(df: DataFrame, a: str, b: str) -> None:
    if ndim(df, a) != ndim(df, b):
        raise ValueError(f"{a} and {b} have {ndim(df, a)} and {ndim(df, b)} dimensions")


def check_dtype(df: DataFrame, column: str, *allowed: str) -> None:
    """The innermost type, by its simple name."""
    if _element(df, column).simpleString() not in allowed:
        raise TypeError(f"{column}: expected {' or '.join(allowed)}, found {_element(df, column).simpleString()}")


def check_integer_dtype(df: DataFrame, column: str) -> None:
    if not isinstance(_element(df, column), T.IntegralType):
        raise TypeError(f"{column}: expected integers, found {_element(df, column).simpleString()}")


def check_dtype_kind(df: DataFrame, column: str, kind: type) -> None:
    """The innermost type is of a kind, such as ``NumericType``."""
    if not isinstance(_element(df, column), kind):
        raise TypeError(f"{column}: expected {kind.__name__}, found {_element(df, column).simpleString()}")


def _required(column: Column | str, holds: Column, message: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.coalesce(holds, F.lit(True)), c).otherwise(F.raise_error(F.lit(message)))


def require_ploidy(column: Column | str, ploidy: int) -> Column:
    """The calls, each with ``ploidy`` alleles."""
    c = F.col(column) if isinstance(column, str) else column
    return _required(c, F.forall(c, lambda g: F.size(g) == ploidy), f"calls that are not of ploidy {ploidy}")


def require_samples(column: Column | str, least: int) -> Column:
    """The array, with ``least`` elements at least."""
    c = F.col(column) if isinstance(column, str) else column
    return _required(c, F.size(c) >= least, f"fewer than {least} samples")


def require_length(column: Column | str, n: int) -> Column:
    """The array, of ``n`` elements."""
    c = F.col(column) if isinstance(column, str) else column
    return _required(c, F.size(c) == n, f"arrays that do not have {n} elements")


def require_aligned(column: Column | str, *others: Column | str) -> Column:
    """The array, as long as the others of its row: their second dimensions are aligned."""
    c = F.col(column) if isinstance(column, str) else column
    same = F.lit(True)
    for o in others:
        o = F.col(o) if isinstance(o, str) else o
        same = same & (F.size(c) == F.size(o))
    return _required(c, same, "arrays of a row differ in length")


def check_rows_aligned(a: DataFrame, b: DataFrame, key: str = "vidx") -> None:
    """Both tables have the same keys: their first dimensions are aligned. One pass, with map-side combine."""
    marked = a.select(key, F.lit(1).alias("n")).unionByName(b.select(key, F.lit(-1).alias("n")))
    odd = marked.groupBy(key).agg(F.sum("n").alias("n")).where("n <> 0").limit(1).collect()
    if odd:
        raise ValueError(f"rows differ, at {key} {odd[0][0]} among others")
