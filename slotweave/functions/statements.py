"""Statement expressions: Python-like statements over ``src`` that assign ``target`` become one Column.

Mapping rows are data: nothing here is ever run as Python.  The statements are
walked once with symbolic values.  A value known from the text alone (a number, a
flag passed to a function, a separator) stays a constant and is computed on the
way; everything else is a Column with a kind (text, number, bool, list).  An
``if`` whose test is a Column walks both ways and joins what they assign and
return into CASE WHEN; functions defined in the statements are walked anew at
each call.  What cannot be a Column (loops, imports, attribute access, unknown
calls, recursion) is refused with :class:`Refused`.

Where Python would raise, the value of that operation is null and the statements
go on: an operation on None, an index out of range, a division by zero, text that
is no number.  A comparison of order with None counts as false.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The slot namespace, and the name that the statements assign.
SOURCE, RESULT = "src", "target"
#: Nested calls, all calls, and nodes of a Column: a text beyond these is refused, since its plan would be too large.
MOST_DEPTH, MOST_CALLS, MOST_NODES = 16, 500, 4000

_SPACE = " \t\n\r\x0b\x0c"


class Refused(ValueError):
    """Statements that cannot be a Column."""


@dataclass(frozen=True)
class Known:
    """A value known from the text: None, a bool, number or string, or a tuple of values."""

    value: Any


@dataclass(frozen=True)
class Value:
    """A value of the data: ``kind`` is text, number, bool or list."""

    column: Column
    kind: str
    nodes: int = 1
    item: str = "text"  # kind of a list's items


@dataclass(frozen=True)
class Function:
    name: str
    args: ast.arguments
    body: list[ast.stmt]
    scope: Scope


class Missing:
    """A name that only some of the ways here have assigned."""


@dataclass
class Scope:
    names: dict[str, Any] = field(default_factory=dict)
    outer: Scope | None = None

    def find(self, name: str) -> Any:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.outer
        raise Refused(f"unknown name: {name}")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "list" if isinstance(data_type, T.ArrayType) else "text"


def _checked(column: Column, kind: str, *parts: Any, item: str = "text") -> Value:
    nodes = 1 + sum(p.nodes for p in parts if isinstance(p, Value))
    if nodes > MOST_NODES:
        raise Refused(f"statements that grow to more than {MOST_NODES} operations")
    return Value(column, kind, nodes, item)


def lifted(value: Any) -> Value:
    """A value as a Column; None is a null text."""
    match value:
        case Value():
            return value
        case Known(value=bool(x)):
            return Value(F.lit(x), "bool")
        case Known(value=int(x)):
            return Value(F.lit(x).cast("long"), "number")
        case Known(value=float(x)):
            return Value(F.lit(x), "number")
        case Known(value=tuple(items)):
            held = [lifted(x) for x in items]
            kinds = {h.kind for h in held}
            if not held or kinds == {"text"}:
                return _checked(F.array(*(h.column for h in held)).cast("array<string>"), "list", *held)
            if kinds <= {"number", "bool"}:
                return _checked(F.array(*(_number(h).column.cast("double") for h in held)), "list", *held, item="number")
            return _checked(F.array(*(text(h).column for h in held)), "list", *held)
        case Known(value=None):
            return Value(F.lit(None).cast("string"), "text")
        case Known(value=str(x)):
            return Value(F.lit(x), "text")
    raise Refused(f"not a value: {type(value).__name__}")


def _written(value: Any) -> bool:
    """Whether a value is known from the text throughout."""
    return isinstance(value, Known) and (not isinstance(value.value, tuple) or all(map(_written, value.value)))


def truth(value: Any) -> Any:
    """Whether a value counts as true: Known, or a bool Value that is never null."""
    if isinstance(value, Known):
        return Known(bool(value.value))
    v = lifted(value)
    told = {"bool": v.column, "number": v.column != 0, "text": v.column != "", "list": F.size(v.column) > 0}[v.kind]
    return _checked(F.coalesce(told, F.lit(False)), "bool", v)


def text(value: Any) -> Value:
    """``str(value)`` of a known value or a Column."""
    if isinstance(value, Known):
        return Value(F.lit(str(value.value)), "text")
    if value.kind == "text":
        return value
    if value.kind == "bool":
        return _checked(F.when(value.column, "True").when(~value.column, "False"), "text", value)
    return _checked(value.column.cast("string"), "text", value)


def _number(value: Any) -> Value:
    v = lifted(value)
    if v.kind == "bool":
        return _checked(v.column.cast("long"), "number", v)
    if v.kind != "number":
        raise Refused(f"a {v.kind} where a number is needed")
    return v


def _same_kind(a: Any, b: Any) -> tuple[Value, Value]:
    """Both as Columns of one kind; None fits any, and values of different kinds meet as text."""
    none = Known(None)
    x, y = lifted(a), lifted(b)
    if a == none or b == none:
        like = y if a == none else x
        empty = Value(F.lit(None), like.kind, item=like.item)
        return (empty, y) if a == none else (x, empty)
    if x.kind == y.kind and (x.kind != "list" or x.item == y.item):
        return x, y
    if {x.kind, y.kind} == {"number", "bool"}:
        return _number(x), _number(y)
    if "list" in (x.kind, y.kind):
        raise Refused("a list and something else for one name")
    return text(x), text(y)


def choose(test: Any, a: Any, b: Any) -> Any:
    """``a if test else b``."""
    if isinstance(test, Known):
        return a if test.value else b
    if _written(a) and _written(b) and a == b and type(a.value) is type(b.value):
        return a
    if isinstance(a, (Missing, Function)) or isinstance(b, (Missing, Function)):
        return a if a is b else Missing()
    x, y = _same_kind(a, b)
    return _checked(F.when(test.column, x.column).otherwise(y.column), x.kind, test, x, y, item=x.item)


def _both(a: Any, b: Any) -> Any:
    """Conjunction of two truths."""
    for one, other in ((a, b), (b, a)):
        if isinstance(one, Known):
            return other if one.value else one
    return _checked(a.column & b.column, "bool", a, b)


def _not(a: Any) -> Any:
    return Known(not a.value) if isinstance(a, Known) else _checked(~a.column, "bool", a)


# --- operators and methods -----------------------------------------------------------------------------

_FOLD: dict[type, Callable[[Any, Any], Any]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b,
}
_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))), ast.Mod: lambda a, b: F.when(b > 0, F.pmod(a, b)).when(b < 0, -F.pmod(-a, -b)),
}
_ORDER: dict[type, Callable[[Any, Any], Any]] = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def _plain(value: Any, what: str) -> Any:
    if not isinstance(value, Known):
        raise Refused(f"{what} must be written out in the text")
    return value.value


def _binary(op: ast.operator, a: Any, b: Any) -> Any:
    if a == Known(None) or b == Known(None):
        return Known(None)
    if isinstance(a, Known) and isinstance(b, Known) and type(op) in _FOLD:
        if isinstance(op, ast.Mult) and any(isinstance(x.value, (str, tuple)) for x in (a, b)):
            raise Refused("a text or list times a number")
        try:
            return Known(_FOLD[type(op)](a.value, b.value))
        except (TypeError, ZeroDivisionError, ValueError):
            return Known(None)
    if type(op) not in _ARITHMETIC:
        raise Refused(f"not allowed in statements: {type(op).__name__}")
    x, y = lifted(a), lifted(b)
    if isinstance(op, ast.Add) and {x.kind, y.kind} == {"text"}:
        return _checked(F.concat(x.column, y.column), "text", x, y)
    if isinstance(op, ast.Add) and x.kind == y.kind == "list" and x.item == y.item:
        return _checked(F.concat(x.column, y.column), "list", x, y, item=x.item)
    x, y = _number(x), _number(y)
    return _checked(_ARITHMETIC[type(op)](x.column, y.column), "number", x, y)


def _equal(a: Any, b: Any) -> Any:
    """``a == b``: None equals None alone, and values of different kinds are never equal."""
    if _written(a) and _written(b):
        return Known(a.value == b.value)
    x, y = lifted(a), lifted(b)
    if a == Known(None) or b == Known(None):
        return _checked((y if a == Known(None) else x).column.isNull(), "bool", x, y)
    if x.kind != y.kind and not {x.kind, y.kind} <= {"number", "bool"}:
        return Known(False)
    if x.kind != y.kind:
        x, y = _number(x), _number(y)
    return _checked(x.column.eqNullSafe(y.column), "bool", x, y)


def _contains(item: Any, held: Any) -> Any:
    """``item in held``: text in text, or one of a list."""
    if _written(item) and _written(held):
        try:
            return Known((item in held.value) if isinstance(held.value, tuple) else item.value in held.value)
        except TypeError:
            raise Refused("'in' of something that holds nothing") from None
    if isinstance(held, Known) and isinstance(held.value, tuple):
        out: Any = Known(False)
        for x in held.value:
            out = _not(_both(_not(out), _not(_equal(item, x))))
        return out
    h, i = lifted(held), lifted(item)
    if h.kind == "list":
        return _checked(F.coalesce(F.array_contains(h.column, i.column), F.lit(False)), "bool", h, i)
    if {h.kind, i.kind} != {"text"}:
        raise Refused("'in' of something that holds nothing")
    return _checked(F.coalesce(F.contains(h.column, i.column), F.lit(False)), "bool", h, i)


def _compare(op: ast.cmpop, a: Any, b: Any) -> Any:
    match op:
        case ast.Eq() | ast.Is():
            return _equal(a, b)
        case ast.NotEq() | ast.IsNot():
            return _not(_equal(a, b))
        case ast.In():
            return _contains(a, b)
        case ast.NotIn():
            return _not(_contains(a, b))
    holds = _ORDER[type(op)]
    if isinstance(a, Known) and isinstance(b, Known):
        try:
            return Known(holds(a.value, b.value))
        except TypeError:
            return Known(False)
    x, y = lifted(a), lifted(b)
    if x.kind != y.kind:
        if not {x.kind, y.kind} <= {"number", "bool"}:
            return Known(False)
        x, y = _number(x), _number(y)
    return _checked(F.coalesce(holds(x.column, y.column), F.lit(False)), "bool", x, y)


def _at(value: Any, index: Any) -> Any:
    """``value[index]`` of a list or text; a negative index counts from the end."""
    if isinstance(value, Known) and isinstance(index, Known):
        try:
            found = value.value[index.value]
        except (IndexError, TypeError, KeyError):
            return Known(None)
        return found if isinstance(found, (Known, Value)) else Known(found)
    v, i = lifted(value), _number(index)
    if v.kind == "list":
        place = F.when(i.column < 0, F.size(v.column) + i.column).otherwise(i.column).cast("int")
        return _checked(F.when(place >= 0, F.get(v.column, place)), v.item, v, i)
    if v.kind != "text":
        raise Refused(f"an index into a {v.kind}")
    size = F.length(v.column)
    place = F.when(i.column < 0, size + i.column).otherwise(i.column).cast("int")
    return _checked(F.when((place >= 0) & (place < size), F.substr(v.column, place + 1, F.lit(1))), "text", v, i)


def _slice(value: Any, low: Any, high: Any) -> Any:
    """``value[low:high]``, bounds cut to what there is."""
    none = Known(None)
    if all(isinstance(x, Known) for x in (value, low, high)):
        found = value.value[low.value : high.value]
        return Known(found)
    v = lifted(value)
    if v.kind not in ("text", "list"):
        raise Refused(f"a slice of a {v.kind}")
    size = F.length(v.column) if v.kind == "text" else F.size(v.column)
    place = lambda x, default: default if x == none else F.greatest(F.lit(0), F.least(size, F.when(_number(x).column < 0, size + _number(x).column).otherwise(_number(x).column))).cast("int")
    start, stop = place(low, F.lit(0)), place(high, size)
    many = F.greatest(F.lit(0), stop - start)
    made = F.substr(v.column, start + 1, many) if v.kind == "text" else F.slice(v.column, start + 1, many)
    return _checked(made, v.kind, v, *(x for x in (low, high) if isinstance(x, Value)), item=v.item)


def _pattern(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _split(v: Value, separator: str | None, most: int, from_right: bool) -> Column:
    if separator is None:
        if most >= 0:
            raise Refused("a bounded split at white space")
        return F.filter(F.split(F.btrim(v.column, F.lit(_SPACE)), r"\s+"), lambda x: x != "")
    if separator == "":
        raise Refused("a split at nothing")
    if not from_right:
        return F.split(v.column, _pattern(separator), most + 1 if most >= 0 else -1)
    parts = F.split(v.column, _pattern(separator), -1)
    if most < 0:
        return parts
    n = F.size(parts)
    head = F.array(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - most, F.lit(1))), separator))
    return F.when(n <= most + 1, parts).otherwise(F.concat(head, F.slice(parts, F.greatest(n - most + 1, F.lit(1)), F.lit(most))) if most else head)


#: Methods whose result is known where the text and all arguments are.
_METHODS = {"strip", "lstrip", "rstrip", "lower", "upper", "startswith", "endswith", "replace", "split", "rsplit", "join", "find", "isdigit", "zfill", "get"}


def _method(name: str, owner: Any, args: list[Any]) -> Any:
    if name not in _METHODS:
        raise Refused(f"not allowed in statements: .{name}()")
    if name == "get":
        raise Refused(".get() of something that is no dictionary")
    if isinstance(owner, Known) and all(isinstance(a, Known) and not isinstance(a.value, tuple) for a in args):
        if not isinstance(owner.value, str) or name == "zfill":
            return Known(None) if name != "zfill" else _method(name, lifted(owner), args)
        found = getattr(owner.value, name)(*(a.value for a in args))
        return Known(tuple(map(Known, found)) if isinstance(found, list) else found)
    if name == "join":
        items = lifted(args[0])
        if items.kind != "list" or items.item != "text":
            raise Refused("join of something that is no list of texts")
        return _checked(F.array_join(items.column, _plain(owner, "what joins a list")), "text", items)
    v = lifted(owner)
    if v.kind != "text":
        raise Refused(f".{name}() of a {v.kind}")
    match name, args:
        case ("strip" | "lstrip" | "rstrip"), [] | [_]:
            chars = F.lit(_plain(args[0], "what to strip") if args else _SPACE)
            return _checked({"strip": F.btrim, "lstrip": F.ltrim, "rstrip": F.rtrim}[name](v.column, chars), "text", v)
        case ("lower" | "upper"), []:
            return _checked({"lower": F.lower, "upper": F.upper}[name](v.column), "text", v)
        case ("startswith" | "endswith"), [x]:
            heads = x.value if isinstance(x, Known) and isinstance(x.value, tuple) else (x,)
            test = {"startswith": F.startswith, "endswith": F.endswith}[name]
            found = reduce(lambda a, b: a | b, (test(v.column, lifted(h).column) for h in heads))
            return _checked(F.coalesce(found, F.lit(False)), "bool", v, x)
        case "replace", [a, b]:
            if _plain(a, "what to replace") == "":
                raise Refused("a replacement of nothing")
            return _checked(F.replace(v.column, lifted(a).column, lifted(b).column), "text", v, b)
        case ("split" | "rsplit"), _ if len(args) <= 2:
            separator, most = ([_plain(a, "a separator") for a in args] + [None, -1][len(args) :])[:2]
            return _checked(_split(v, separator, most, name == "rsplit"), "list", v)
        case "find", [x]:
            return _checked((F.locate(_plain(x, "what to find"), v.column) - 1).cast("long"), "number", v)
        case "isdigit", []:
            return _checked(F.coalesce(F.rlike(v.column, F.lit(r"\A[0-9]+\z")), F.lit(False)), "bool", v)
        case "zfill", [x]:
            width = _plain(x, "a width")
            if width > 1000:
                raise Refused("a text that wide")
            return _checked(F.when(F.length(v.column) >= width, v.column).otherwise(F.lpad(v.column, width, "0")), "text", v)
    raise Refused(f"not allowed in statements: .{name}() with {len(args)} values")


def _builtin(name: str, args: list[Any]) -> Any:
    match name, args:
        case "str", [x]:
            return Known(str(x.value)) if isinstance(x, Known) and not isinstance(x.value, tuple) else _none_as_text(text(x))
        case "len", [Known(value=str(x) | tuple(x))]:
            return Known(len(x))
        case "len", [x]:
            v = lifted(x)
            if v.kind not in ("text", "list"):
                raise Refused(f"the length of a {v.kind}")
            return _checked((F.length(v.column) if v.kind == "text" else F.when(v.column.isNotNull(), F.size(v.column))).cast("long"), "number", v)
        case "bool", [x]:
            return truth(x)
        case ("int" | "float"), [x]:
            v = lifted(x)
            if v.kind == "list":
                raise Refused(f"{name} of a list")
            source = F.btrim(v.column, F.lit(_SPACE)) if v.kind == "text" else v.column
            return _checked(source.try_cast("long" if name == "int" else "double"), "number", v)
        case "abs", [x]:
            v = _number(x)
            return _checked(F.abs(v.column), "number", v)
        case "round", [x] | [x, _]:
            v, places = _number(x), _plain(args[1], "places to round to") if len(args) > 1 else 0
            rounded = F.bround(v.column, places)
            return _checked(rounded if len(args) > 1 else rounded.cast("long"), "number", v)
        case ("min" | "max"), [_, _, *_]:
            held = [_number(x) for x in args]
            nulls = reduce(lambda a, b: a | b, (h.column.isNull() for h in held))
            return _checked(F.when(~nulls, {"min": F.least, "max": F.greatest}[name](*(h.column for h in held))), "number", *held)
    raise Refused(f"not allowed in statements: {name}() with {len(args)} values")


def _none_as_text(v: Value) -> Value:
    return _checked(F.coalesce(v.column, F.lit("None")), "text", v)


# --- statements ------------------------------------------------------------------------------------------


@dataclass
class Outcome:
    """What a block leaves: the ways that go on, and (way, value) of each return."""

    live: Any
    returns: list[tuple[Any, Any]] = field(default_factory=list)


class Walker:
    def __init__(self, slot: Callable[[str], Value]):
        self.slot, self.depth, self.calls = slot, 0, 0

    def value(self, node: ast.expr, scope: Scope) -> Any:
        of = lambda n: self.value(n, scope)
        match node:
            case ast.Constant(value=x) if x is None or isinstance(x, (bool, int, float, str)):
                return Known(x)
            case ast.Name(id=name):
                return self.named(name, scope)
            case ast.Attribute(value=ast.Name(id=space), attr=name) if space == SOURCE:
                return self.slot(name)
            case ast.Tuple(elts=items) | ast.List(elts=items):
                return Known(tuple(map(of, items)))
            case ast.BinOp(left=a, op=op, right=b):
                return _binary(op, of(a), of(b))
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return _not(truth(of(a)))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return _binary(ast.Sub(), Known(0), of(a))
            case ast.BoolOp(op=op, values=values):
                out = of(values[0])
                for v in values[1:]:
                    test, other = truth(out), of(v)
                    out = choose(test, other, out) if isinstance(op, ast.And) else choose(test, out, other)
                return out
            case ast.Compare(left=left, ops=ops, comparators=rest):
                out, a = Known(True), of(left)
                for op, right in zip(ops, rest, strict=True):
                    b = of(right)
                    out, a = _both(out, _compare(op, a, b)), b
                return out
            case ast.IfExp(test=test, body=a, orelse=b):
                told = truth(of(test))
                if isinstance(told, Known):
                    return of(a if told.value else b)
                return choose(told, of(a), of(b))
            case ast.Subscript(value=ast.Dict() as table, slice=key):
                return self.looked_up(table, of(key), Known(None), scope)
            case ast.Subscript(value=v, slice=ast.Slice(lower=low, upper=high, step=None)):
                return _slice(of(v), *(Known(None) if x is None else of(x) for x in (low, high)))
            case ast.Subscript(value=v, slice=index) if not isinstance(index, ast.Slice):
                return _at(of(v), of(index))
            case ast.JoinedStr(values=parts):
                return reduce(lambda a, b: _binary(ast.Add(), a, b), (self.piece(p, scope) for p in parts), Known(""))
            case ast.Call(keywords=[], func=ast.Attribute(value=ast.Dict() as table, attr="get"), args=[key, *rest]) if len(rest) < 2:
                return self.looked_up(table, of(key), of(rest[0]) if rest else Known(None), scope)
            case ast.Call(keywords=[], func=ast.Name(id="case"), args=args) if args:
                out: Any = Known(None)
                for pair in reversed(args):
                    if not isinstance(pair, ast.Tuple) or len(pair.elts) != 2:
                        raise Refused("case takes (condition, value) pairs")
                    out = choose(truth(of(pair.elts[0])), of(pair.elts[1]), out)
                return out
            case ast.Call(func=ast.Attribute(value=owner, attr=name), args=args, keywords=[]):
                return _method(name, of(owner), list(map(of, args)))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords):
                return self.called(name, list(map(of, args)), {k.arg: of(k.value) for k in keywords}, scope)
        raise Refused(f"not allowed in statements: {ast.unparse(node)}")

    def named(self, name: str, scope: Scope) -> Any:
        found = scope.find(name)
        if isinstance(found, Missing):
            raise Refused(f"{name} is not assigned on every way")
        return found

    def piece(self, node: ast.expr, scope: Scope) -> Any:
        if isinstance(node, ast.FormattedValue):
            if node.format_spec is not None or node.conversion != -1:
                raise Refused("a format in a text")
            return _builtin("str", [self.value(node.value, scope)])
        return self.value(node, scope)

    def looked_up(self, table: ast.Dict, key: Any, default: Any, scope: Scope) -> Any:
        out = default
        for k, v in reversed(list(zip(table.keys, table.values, strict=True))):
            if k is None:
                raise Refused("** in a dictionary")
            out = choose(_equal(key, self.value(k, scope)), self.value(v, scope), out)
        return out

    def called(self, name: str, args: list[Any], given: dict[str | None, Any], scope: Scope) -> Any:
        try:
            function = scope.find(name)
        except Refused:
            if given:
                raise Refused(f"named values for {name}()") from None
            return _builtin(name, args)
        if not isinstance(function, Function):
            raise Refused(f"{name} is no function")
        spec = function.args
        if spec.vararg or spec.kwarg or spec.kwonlyargs or spec.posonlyargs or None in given:
            raise Refused(f"{name}() takes more than plain arguments")
        wanted = [a.arg for a in spec.args]
        defaults = dict(zip(wanted[len(wanted) - len(spec.defaults) :], (self.value(d, function.scope) for d in spec.defaults), strict=True))
        own = defaults | dict(zip(wanted, args, strict=False)) | given
        if len(args) > len(wanted) or set(own) != set(wanted):
            raise Refused(f"{name}() is called with other values than it takes")
        self.depth, self.calls = self.depth + 1, self.calls + 1
        if self.depth > MOST_DEPTH or self.calls > MOST_CALLS:
            raise Refused("functions that call each other too often")
        done = self.block(function.body, Scope(own, function.scope), Known(True), True)
        self.depth -= 1
        out: Any = Known(None)
        for way, value in reversed(done.returns):
            out = choose(way, value, out)
        return out

    def assign(self, target: ast.expr, value: Any, scope: Scope) -> None:
        match target:
            case ast.Name(id=name) if name != SOURCE:
                scope.names[name] = value
            case ast.Tuple(elts=names) | ast.List(elts=names):
                if isinstance(value, Known) and isinstance(value.value, tuple) and len(value.value) != len(names):
                    raise Refused("as many names as values are needed")
                for k, n in enumerate(names):
                    self.assign(n, _at(value, Known(k)), scope)
            case _:
                raise Refused(f"not assigned in statements: {ast.unparse(target)}")

    def block(self, body: list[ast.stmt], scope: Scope, live: Any, in_function: bool) -> Outcome:
        """Walk statements; ``live`` is the truth that this block is still gone through."""
        out = Outcome(live)
        for statement in body:
            if isinstance(out.live, Known) and not out.live.value:
                break
            match statement:
                case ast.Pass() | ast.Expr(value=ast.Constant()):
                    pass
                case ast.Assign(targets=targets, value=v):
                    made = self.value(v, scope)
                    for t in targets:
                        self.assign(t, made, scope)
                case ast.AnnAssign(target=t, value=v) if v is not None:
                    self.assign(t, self.value(v, scope), scope)
                case ast.AugAssign(target=ast.Name(id=name) as t, op=op, value=v):
                    self.assign(t, _binary(op, self.named(name, scope), self.value(v, scope)), scope)
                case ast.FunctionDef(name=name, args=args, body=inner, decorator_list=[]):
                    scope.names[name] = Function(name, args, inner, scope)
                case ast.Return(value=v) if in_function:
                    out.returns.append((out.live, Known(None) if v is None else self.value(v, scope)))
                    out.live = Known(False)
                case ast.If(test=test, body=yes, orelse=no):
                    self.branch(truth(self.value(test, scope)), yes, no, scope, out, in_function)
                case _:
                    raise Refused(f"not allowed in statements: {ast.unparse(statement).splitlines()[0]}")
        return out

    def branch(self, test: Any, yes: list[ast.stmt], no: list[ast.stmt], scope: Scope, out: Outcome, in_function: bool) -> None:
        if isinstance(test, Known):
            done = self.block(yes if test.value else no, scope, out.live, in_function)
            out.returns += done.returns
            out.live = done.live
            return
        before = dict(scope.names)
        a, first = self.block(yes, scope, _both(out.live, test), in_function), scope.names
        scope.names = before
        b, second = self.block(no, scope, _both(out.live, _not(test)), in_function), scope.names
        scope.names = {}
        out.returns += a.returns + b.returns
        ends = [isinstance(x.live, Known) and not x.live.value for x in (a, b)]
        for name in {**first, **second}:
            x, y = first.get(name, Missing()), second.get(name, Missing())
            # what a way assigns that has returned is seen by nobody
            scope.names[name] = y if ends[0] else x if ends[1] else x if x is y else choose(test, x, y)
        out.live = b.live if ends[0] else a.live if ends[1] else _not(_both(_not(a.live), _not(b.live)))


def is_statements(expression: str) -> bool:
    """Whether a text is more than one expression."""
    body = ast.parse(expression.strip()).body
    return not (len(body) == 1 and isinstance(body[0], ast.Expr))


def to_column(statements: str, slot: Callable[[str], tuple[Column, str]]) -> Column:
    """Column of what the statements leave in ``target``; null on ways that leave nothing.

    ``slot`` gives the Column and kind of a source slot.
    """
    scope = Scope({RESULT: Known(None)})
    walker = Walker(lambda name: Value(*slot(name)))
    try:
        tree = ast.parse(re.sub(r"\r\n?", "\n", statements).strip("\n"))
    except SyntaxError as wrong:
        raise Refused(f"not statements: {wrong.msg}") from None
    walker.block(tree.body, scope, Known(True), False)
    out = scope.names[RESULT]
    if isinstance(out, (Missing, Function)):
        raise Refused(f"{RESULT} is no value")
    return lifted(out).column
