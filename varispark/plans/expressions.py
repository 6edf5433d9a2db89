"""Table expressions such as ``(DP > 30) & (QD < 4.5)`` as Spark columns, by a whitelist over the syntax tree."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINARY: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Mod: operator.mod,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Pow: F.pow,
}
_COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "exp": F.exp, "where": lambda c, a, b: F.when(c, a).otherwise(b)}


def variables(expression: str) -> list[str]:
    """Column names that an expression uses."""
    tree = ast.parse(expression, mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called)


def to_column(expression: str) -> Column:
    """Translate; anything outside the whitelist raises ValueError."""
    return _column(ast.parse(expression, mode="eval").body)


def _column(n: ast.expr) -> Column:
    if isinstance(n, ast.Constant):
        return F.lit(n.value.decode() if isinstance(n.value, bytes) else n.value)
    if isinstance(n, ast.Name):
        return F.col(f"`{n.id}`")
    if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
        return _BINARY[type(n.op)](_column(n.left), _column(n.right))
    if isinstance(n, ast.UnaryOp):
        x = _column(n.operand)
        if isinstance(n.op, ast.USub):
            return -x
        if isinstance(n.op, (ast.Invert, ast.Not)):
            return ~x
    if isinstance(n, ast.BoolOp):
        out = _column(n.values[0])
        for v in n.values[1:]:
            out = out & _column(v) if isinstance(n.op, ast.And) else out | _column(v)
        return out
    if isinstance(n, ast.Compare) and all(type(o) in _COMPARE for o in n.ops):
        parts = [_column(x) for x in (n.left, *n.comparators)]
        out = None
        for o, a, b in zip(n.ops, parts, parts[1:], strict=False):
            one = _COMPARE[type(o)](a, b)
            out = one if out is None else out & one
        return out
    if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant):
        return _column(n.value)[n.slice.value]
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _FUNCTIONS and not n.keywords:
        return _FUNCTIONS[n.func.id](*[_column(a) for a in n.args])
    raise ValueError(f"unsupported expression: {ast.unparse(n)}")


def eval_table(df: DataFrame, expression: str, name: str = "value", key: str = "vidx") -> DataFrame:
    """key and the value of the expression; Catalyst reads its columns only."""
    return df.select(key, to_column(expression).alias(name))


def query(df: DataFrame, expression: str) -> DataFrame:
    return df.where(to_column(expression))
