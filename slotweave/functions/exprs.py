"""Expression slots: a whitelisted Python expression becomes a Column; names in it can be listed.

Mapping rows are data, so nothing is ever evaluated as Python: an expression
outside the whitelist is refused.  Texts of several statements that assign
``target`` are walked symbolically (:mod:`slotweave.functions.statements`).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import statements

NAMESPACES = ("src",)

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_CALLS: dict[str, Callable[..., Column]] = {
    "str": lambda x: x.cast("string"), "int": lambda x: x.try_cast("long"), "float": lambda x: x.try_cast("double"), "len": F.length,
    "strip": F.trim, "lower": F.lower, "upper": F.upper, "abs": F.abs, "round": lambda x, n=None: F.round(x) if n is None else F.round(x, n),
}


def to_column(expression: str, resolve: Callable[[str], Column] = F.col) -> Column:
    """Column of an expression over source slots: ``name``, ``src.name``, literals, arithmetic, comparisons, ``and``/``or``/``not``, ``a if c else b``, ``case((c, v), ...)`` and a few functions."""

    def literal(node: ast.expr):
        return node.value if isinstance(node, ast.Constant) else None

    def textual(node: ast.expr) -> bool:
        """Whether the expression itself shows that it is text."""
        match node:
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return textual(a) or textual(b)
            case ast.Call(func=ast.Name(id=name) | ast.Attribute(attr=name)):
                return name in ("str", "strip", "lower", "upper")
        return isinstance(literal(node), str)

    def walk(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=value):
                return F.lit(value)
            case ast.Name(id=name):
                return resolve(name)
            case ast.Attribute(value=ast.Name(id=space), attr=name) if space in NAMESPACES:
                return resolve(name)
            case ast.BinOp(left=a, op=ast.Add(), right=b) if textual(node):
                return F.concat(walk(a), walk(b))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~walk(a)
            case ast.BoolOp(op=op, values=values):
                out = walk(values[0])
                for v in values[1:]:
                    out = out & walk(v) if isinstance(op, ast.And) else out | walk(v)
                return out
            case ast.Compare(left=a, ops=ops, comparators=rest):
                out, left = None, a
                for op, right in zip(ops, rest, strict=True):
                    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
                        term = walk(left).isin([literal(x) for x in right.elts])
                        term = ~term if isinstance(op, ast.NotIn) else term
                    elif isinstance(op, (ast.Is, ast.IsNot)) and literal(right) is None:
                        term = walk(left).isNull() if isinstance(op, ast.Is) else walk(left).isNotNull()
                    elif type(op) in _COMPARE:
                        term = _COMPARE[type(op)](walk(left), walk(right))
                    else:
                        raise ValueError(f"not allowed in an expression: {ast.dump(op)}")
                    out, left = term if out is None else out & term, right
                return out
            case ast.IfExp(test=test, body=a, orelse=b):
                return F.when(walk(test), walk(a)).otherwise(walk(b))
            case ast.Call(func=ast.Name(id="case"), args=args):
                out = F.lit(None)
                for pair in reversed(args):
                    if not isinstance(pair, ast.Tuple) or len(pair.elts) != 2:
                        raise ValueError("case takes (condition, value) pairs")
                    out = F.when(walk(pair.elts[0]), walk(pair.elts[1])).otherwise(out)
                return out
            case ast.Call(func=ast.Name(id=name), args=args) if name in _CALLS:
                return _CALLS[name](*(walk(a) if k == 0 else literal(a) for k, a in enumerate(args)))
            case ast.Call(func=ast.Attribute(value=a, attr=name), args=[]) if name in _CALLS:
                return _CALLS[name](walk(a))
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return walk(ast.parse(expression.strip(), mode="eval").body)


def slot_expression(expression: str, schema: T.StructType) -> Column:
    """Column of a slot's expression or statements over rows of this schema."""

    def slot(name: str) -> tuple[Column, str]:
        if name not in schema.names:
            raise statements.Refused(f"no source slot {name}")
        kind, column = statements.kind_of(schema[name].dataType), F.col(f"`{name}`")
        return column.cast("string") if kind == "text" else column, kind

    return statements.to_column(expression, slot) if statements.is_statements(expression) else to_column(expression)


def why_refused(expression: str, schema: T.StructType) -> str | None:
    """What keeps a text from being a Column over rows of this schema; None where nothing does."""
    try:
        slot_expression(expression, schema)
    except (ValueError, SyntaxError) as wrong:
        return str(wrong)
    return None


def slots_in(expression: str, spaces: tuple[str, ...] = NAMESPACES, bare: bool = False) -> list[str]:
    """Distinct slots that an expression or statements read, in order: ``src.x`` as x, also below ``src.x.strip()``; bare names on demand."""
    found: dict[str, None] = {}
    tree = ast.parse(expression.strip())
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for node in sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in spaces:
            found.setdefault(node.attr)
        elif bare and isinstance(node, ast.Name) and id(node) not in called and node.id not in spaces:
            found.setdefault(node.id)
    return list(found)
