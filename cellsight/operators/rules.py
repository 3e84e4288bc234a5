"""Intent rules: restricted expressions compiled to columns, and the signals they give to flagged cells."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOTIVES = ("gain_targeted", "fairness_masking", "obfuscation", "noise")


@dataclass(frozen=True)
class Rule:
    id: str
    columns: tuple[str, ...]
    expression: str
    intent_signal: int
    description: str = ""
    motive: str = "noise"


class Unsupported(ValueError):
    """A part of an expression that is outside the allowed subset."""


_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}
_METHODS = {"lower": F.lower, "upper": F.upper, "strip": F.trim}


def compile_expression(text: str, columns: list[str]) -> Column:
    """An expression over ``row['name']`` (text) as a Column. Nothing is evaluated; a failed conversion gives null.

    Allowed: and, or, not, comparisons, in / not in with literals, + - * /, str(), int(), float(), abs(), len(), .strip(),
    .lower(), .upper(), .startswith(), .endswith(), and a lambda of one parameter called on the spot.
    """
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise Unsupported(f"not an expression: {text!r}") from e

    def constant(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float, bool)):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -constant(node.operand)
        raise Unsupported(ast.dump(node))

    def number(c: Column) -> Column:
        d = F.trim(c.cast("string")).try_cast("double")
        return F.when(~F.isnan(d), d)

    def go(node, names) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(constant(node))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "row":
            name = constant(node.slice)
            if name not in columns:
                raise Unsupported(f"unknown column {name!r}")
            return F.col(f"`{name}`").cast("string")
        if isinstance(node, ast.BoolOp):
            parts = [go(v, names) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp):
            inner = go(node.operand, names)
            return ~inner if isinstance(node.op, ast.Not) else -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](go(node.left, names), go(node.right, names))
        if isinstance(node, ast.Compare):
            out, left = None, go(node.left, names)
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    if not isinstance(right, (ast.Tuple, ast.List, ast.Set)):
                        raise Unsupported("in needs a list of literals")
                    one = left.isin(*[constant(e) for e in right.elts])
                    one = ~one if isinstance(op, ast.NotIn) else one
                    value = left
                elif type(op) in _COMPARE:
                    value = go(right, names)
                    one = _COMPARE[type(op)](left, value)
                else:
                    raise Unsupported(ast.dump(op))
                out, left = one if out is None else out & one, value
            return out
        if isinstance(node, ast.Call) and not node.keywords:
            f, args = node.func, node.args
            if isinstance(f, ast.Lambda) and len(args) == 1 and len(f.args.args) == 1:
                return go(f.body, names | {f.args.args[0].arg: go(args[0], names)})
            if isinstance(f, ast.Name) and len(args) == 1:
                inner = go(args[0], names)
                known = {"str": lambda c: c.cast("string"), "float": number, "int": lambda c: F.when(number(c) < 0, F.ceil(number(c))).otherwise(F.floor(number(c))), "abs": F.abs, "len": F.char_length}
                if f.id in known:
                    return known[f.id](inner)
            if isinstance(f, ast.Attribute):
                inner = go(f.value, names)
                if f.attr in _METHODS and not args:
                    return _METHODS[f.attr](inner)
                if f.attr in ("startswith", "endswith") and len(args) == 1:
                    return getattr(inner, f.attr)(F.lit(constant(args[0])))
        raise Unsupported(ast.dump(node))

    return go(tree, {})


def split_rules(rules: list[dict], columns: list[str]) -> tuple[list[Rule], list[tuple[dict, str]]]:
    """Valid rules, and the others with the reason they are set aside."""
    good, bad = [], []
    for r in rules:
        try:
            rule = Rule(str(r["id"]), tuple(r["columns"]), r["expression"], int(r["intent_signal"]), r.get("description", ""), r.get("motive", "noise"))
            if rule.intent_signal not in (1, -1):
                raise Unsupported("the signal is +1 or -1")
            if unknown := [c for c in rule.columns if c not in columns]:
                raise Unsupported(f"unknown columns {unknown}")
            compile_expression(rule.expression, columns)
            good.append(rule)
        except (KeyError, TypeError, ValueError) as e:
            bad.append((r, str(e)))
    return good, bad


def signals(wide: DataFrame, rules: list[Rule], masks: dict[str, str], key: str = "row_idx", columns: list[str] | None = None) -> DataFrame:
    """Signals of every flagged cell: one per rule, their number, sum and ratio, and the row's sum. One pass, no shuffle."""
    columns = columns or [c for c in wide.columns]
    fired = [F.coalesce(compile_expression(r.expression, columns).cast("boolean"), F.lit(False)) for r in rules]
    flat = wide.select(F.col(key).alias("row_idx"), *[F.col(m).alias(f"__m_{c}") for c, m in masks.items()], *[f.alias(f"__f{i}") for i, f in enumerate(fired)])
    row_sum = sum((F.when(F.col(f"__f{i}"), r.intent_signal).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    cells = []
    for c in masks:
        own = {i for i, r in enumerate(rules) if c in r.columns}
        s = [F.when(F.col(f"__f{i}"), r.intent_signal).otherwise(0) if i in own else F.lit(0) for i, r in enumerate(rules)]
        total = sum(s, F.lit(0))
        ratio = (total / F.lit(len(own))) if own else F.lit(0.0)
        cells.append(
            F.struct(F.lit(c).alias("col_name"), F.col(f"__m_{c}").alias("__m"), *[x.alias(f"signal_{r.id}") for x, r in zip(s, rules)], F.lit(len(own)).alias("n_applicable"), total.alias("cell_signal_sum"), ratio.cast("double").alias("cell_signal_ratio"), row_sum.alias("row_signal_sum"))
        )
    return flat.select("row_idx", F.inline(F.array(*cells))).where("__m <> 0").drop("__m")


def coverage(signal_table: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, n_fired``: cells with a signal from each rule."""
    counts = signal_table.agg(*[F.count_if(F.col(f"signal_{r.id}") != 0).alias(r.id) for r in rules])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(r.id).alias("n_fired")) for r in rules])))
