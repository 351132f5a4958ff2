"""Boolean scripts over tags, translated to Column expressions from an allow-list of syntax.

Nothing is evaluated as Python: `amenity == 'cafe' and num(levels) > 2` becomes a
predicate that Catalyst optimises.  A row for which the expression cannot be
computed is null, and is dropped.
"""

from __future__ import annotations

import ast
import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_MATH = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_CALLS = {
    "num": lambda c: c.try_cast("double"),
    "lower": F.lower,
    "upper": F.upper,
    "len": F.length,
    "abs": F.abs,
    "sqrt": F.sqrt,
    "contains": lambda a, b: a.contains(b),
    "startswith": lambda a, b: a.startswith(b),
    "endswith": lambda a, b: a.endswith(b),
    "round": lambda c, n=None: F.round(c, n or 0),
}


def compile_script(source: str, columns: tuple[str, ...] = (), tags: str = "tags") -> Column:
    """A predicate; names are columns of `columns`, else tags.  Anything not on the list is an error."""
    tree = ast.parse(source, mode="eval").body

    def value(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float, bool, type(None))):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.col(node.id) if node.id in columns else F.col(tags)[node.id]
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in ("tags", "props") and isinstance(node.slice, ast.Constant):
            return F.col(tags)[str(node.slice.value)]
        if isinstance(node, ast.BoolOp):
            return functools.reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(value, node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~value(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _MATH:
            return _MATH[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Compare):
            return comparison(node)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            if node.func.id == "has" and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):
                return F.coalesce(F.map_contains_key(tags, str(node.args[0].value)), F.lit(False))
            if node.func.id == "matches" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                re.compile(node.args[1].value)
                return value(node.args[0]).rlike(node.args[1].value)
            if node.func.id == "round" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                return F.round(value(node.args[0]), int(node.args[1].value))
            if node.func.id in _CALLS:
                return _CALLS[node.func.id](*map(value, node.args))
        raise ValueError(f"not allowed in a script: {ast.unparse(node)}")

    def comparison(node: ast.Compare) -> Column:
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)) or not all(isinstance(e, ast.Constant) for e in right.elts):
                    raise ValueError(f"not allowed in a script: {ast.unparse(node)}")
                part = value(left).isin(*[e.value for e in right.elts])
                parts.append(~part if isinstance(op, ast.NotIn) else part)
            elif isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and right.value is None:
                parts.append(value(left).isNull() if isinstance(op, ast.Is) else value(left).isNotNull())
            elif type(op) in _COMPARE:
                parts.append(_COMPARE[type(op)](value(left), value(right)))
            else:
                raise ValueError(f"not allowed in a script: {ast.unparse(node)}")
            left = right
        return functools.reduce(operator.and_, parts)

    return F.coalesce(value(tree).cast("boolean"), F.lit(False))
