"""Expressions given as text or functions, compiled to Columns without evaluating Python."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.checks import col

_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")


def quote_names(text: str, names: list[str]) -> str:
    """Put back-ticks around column names that hold blanks or other marks; the longest name wins, text in quotes stays."""
    odd = sorted((n for n in names if not re.fullmatch(r"[A-Za-z_]\w*", n)), key=len, reverse=True)
    if not odd:
        return text
    pattern = re.compile(_QUOTED.pattern + "|" + "|".join(rf"(?<![\w`]){re.escape(n)}(?![\w`])" for n in odd))
    return pattern.sub(lambda m: m[0] if m[0][0] in "'\"`" else f"`{m[0]}`", text)


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: list[str], ticks: dict[str, str]):
        self.names, self.ticks = names, ticks

    def generic_visit(self, node: ast.AST) -> Column:
        raise ValueError(f"Could not safely evaluate: {type(node).__name__} is not allowed")

    def visit_Expression(self, node: ast.Expression) -> Column:
        return self.visit(node.body)

    def visit_Name(self, node: ast.Name) -> Column:
        name = self.ticks.get(node.id, node.id)
        if name not in self.names:
            raise ValueError(f"Could not safely evaluate: unknown column {name!r}")
        return col(name)

    def visit_Constant(self, node: ast.Constant) -> Column:
        if node.value is None or isinstance(node.value, bool | int | float | str):
            return F.lit(node.value)
        return self.generic_visit(node)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Column:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        if isinstance(node.op, ast.Not | ast.Invert):
            return F.coalesce(~x, F.lit(True))
        return self.generic_visit(node)

    def visit_BinOp(self, node: ast.BinOp) -> Column:
        a, b = self.visit(node.left), self.visit(node.right)
        match node.op:
            case ast.Add():
                strings = any(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in (node.left, node.right))
                return F.concat(a, b) if strings else a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a, b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a, b))
            case ast.Mod():  # sign of the divisor
                return a - b * F.floor(F.try_divide(a, b))
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))
            case ast.BitOr():
                return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
        return self.generic_visit(node)

    def visit_BoolOp(self, node: ast.BoolOp) -> Column:
        parts = [self.visit(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(node.op, ast.And) else (out | p)
        return out

    def visit_Compare(self, node: ast.Compare) -> Column:
        out, left_node = None, node.left
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            part = self._compare(op, left_node, right_node)
            out = part if out is None else out & part
            left_node = right_node
        return out

    def _compare(self, op: ast.cmpop, left: ast.expr, right: ast.expr) -> Column:
        a = self.visit(left)
        if isinstance(op, ast.In | ast.NotIn):
            if not isinstance(right, ast.List | ast.Tuple | ast.Set) or not all(isinstance(e, ast.Constant) for e in right.elts):
                raise ValueError("Could not safely evaluate: 'in' needs a list of constants")
            hit = F.coalesce(a.isin(*[e.value for e in right.elts]), F.lit(False))
            return ~hit if isinstance(op, ast.NotIn) else hit
        b = self.visit(right)
        match op:
            case ast.Eq():
                return a == b
            case ast.NotEq():  # null differs from everything
                return F.coalesce(a != b, F.lit(True))
            case ast.Lt():
                return a < b
            case ast.LtE():
                return a <= b
            case ast.Gt():
                return a > b
            case ast.GtE():
                return a >= b
        return self.generic_visit(op)


def compile_text(text: str, names: list[str]) -> Column:
    """A Column for `text`: arithmetic, comparisons, and/or/not, in; anything else is taken as Spark SQL.

    Python-like text is parsed and only names, constants and operators are let through: calls, attributes and
    subscripts of Python are refused. Text that is no Python expression, or uses SQL functions, goes to Spark SQL's parser,
    which knows no Python either.
    """
    if not isinstance(text, str) or not text.strip():
        raise ValueError("Could not safely evaluate: empty expression")
    quoted = quote_names(text.strip(), names)
    ticks: dict[str, str] = {}

    def name(m: re.Match) -> str:
        if m[0][0] != "`":
            return m[0]
        key = f"__tick{len(ticks)}"
        ticks[key] = m[0][1:-1]
        return key

    plain = _QUOTED.sub(name, quoted)
    try:
        tree = ast.parse(plain, mode="eval")
    except (SyntaxError, ValueError):
        tree = None
    if tree is not None:
        for node in ast.walk(tree):
            if isinstance(node, ast.Attribute | ast.Subscript | ast.Lambda | ast.ListComp | ast.GeneratorExp | ast.DictComp | ast.SetComp | ast.Await | ast.Yield | ast.NamedExpr | ast.Starred):
                raise ValueError(f"Could not safely evaluate expression: {text!r}")
            if isinstance(node, ast.Name) and "__" in node.id and node.id not in ticks and node.id not in names:
                raise ValueError(f"Could not safely evaluate expression: {text!r}")
        if not any(isinstance(node, ast.Call | ast.IfExp) for node in ast.walk(tree)):
            return _Compiler(names, ticks).visit(tree)
    if re.search(r"\b(java_method|reflect|input_file_name)\s*\(", text, re.I) or "__" in re.sub(r"'[^']*'|`[^`]*`", "", text):
        raise ValueError(f"Could not safely evaluate expression: {text!r}")
    return F.expr(quoted)


def compile_any(expression: str | Column | Callable, df: DataFrame) -> Column:
    """A Column from text, a Column, or a function of the DataFrame that returns a Column or text."""
    if isinstance(expression, Column):
        return expression
    if callable(expression):
        expression = expression(df)
        if isinstance(expression, Column):
            return expression
        if not isinstance(expression, str):
            raise TypeError("the function must return a Column or text")
    try:
        out = compile_text(expression, df.columns)
        df.select(out)
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"Could not safely evaluate expression {expression!r}: {str(e).splitlines()[0]}") from e
    return out
