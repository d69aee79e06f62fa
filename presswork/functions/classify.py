"""Decision trees compiled to one nested CASE expression.

A tree is JSON configuration: it is checked on the driver and becomes a Column, so the
optimizer sees plain predicates. A leaf's path is known at compile time and is a literal.
Null stands for a missing field: orderings and ``==`` with it are false, ``!=`` is true
unless the value is null too.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = (">", "<", ">=", "<=", "==", "!=")
CONDITIONS = ("url_matches", "text_contains", "compare", "flag", "and", "or")


def validate(node: dict | str) -> dict:
    """The node as a dict; ValueError if it breaks the format."""
    node = json.loads(node) if isinstance(node, str) else node

    def condition(c: object) -> None:
        if not isinstance(c, dict) or c.get("type") not in CONDITIONS:
            raise ValueError(f"bad condition: {c!r}")
        if c.get("operator") is not None and c["operator"] not in OPERATORS:
            raise ValueError(f"bad operator: {c['operator']!r}")
        for x in c.get("conditions") or ():
            condition(x)

    def walk(n: object) -> None:
        if not isinstance(n, dict) or not isinstance(n.get("id"), str):
            raise ValueError(f"bad node: {n!r}")
        if n.get("result") is not None and not isinstance(n["result"], bool):
            raise ValueError("result is no boolean")
        if n.get("condition") is not None:
            condition(n["condition"])
        for k in ("yes", "no"):
            if n.get(k) is not None:
                walk(n[k])

    walk(node)
    return node


def _shown(value: object) -> str:
    if value is None:
        return "undefined"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:g}" if isinstance(value, float) and value == int(value) else str(value)


def describe(c: dict) -> str:
    kind = c["type"]
    if kind == "url_matches":
        return f'URL matches "{c.get("pattern")}"'
    if kind == "text_contains":
        return f'Text contains "{c.get("pattern")}"'
    if kind == "compare":
        return f"{c.get('field')} {c.get('operator')} {_shown(c.get('value'))}"
    if kind == "flag":
        return f'Flag "{c.get("field")}" is set'
    return f"{'All' if kind == 'and' else 'Any'} of: {', '.join(map(describe, c.get('conditions') or ()))}"


class Compiler:
    """Compiles conditions against the columns of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.schema, self.df = df.schema, df
        self.names = set(df.columns)

    def _field(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.names else F.lit(None)

    def _pattern_ok(self, pattern: str) -> bool:
        """Whether the engine that will run the pattern can read it."""
        try:
            self.df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            if "java.util.regex" not in f"{e!r} {getattr(e, 'java_exception', '')}" and "near index" not in str(e):
                raise
            return False
        return True

    def _compare(self, c: dict) -> Column:
        field, op, value = c.get("field"), c.get("operator"), c.get("value")
        if not field or op is None:
            return F.lit(False)
        if field not in self.names or value is None:
            null = self._field(field).isNull() if field in self.names else F.lit(True)
            same = null if value is None else F.lit(False)
            return same if op == "==" else ~same if op == "!=" else F.lit(False)
        x, kind = self._field(field), self.schema[field].dataType
        if isinstance(kind, T.StringType) and isinstance(value, str):
            y = F.lit(value)
        else:
            number = lambda s: F.expr(f"try_cast(trim({s}) as double)")
            x = number(f"`{field}`") if isinstance(kind, T.StringType) else x.cast("double")
            try:
                y = F.lit(float(value))
            except ValueError:
                y = F.lit(None).cast("double")
        got = {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y}[op]
        return F.coalesce(got, F.lit(op == "!="))

    def condition(self, c: dict) -> Column:
        kind, pattern = c["type"], c.get("pattern")
        if kind == "url_matches":
            if not pattern:
                return F.lit(False)
            url = F.coalesce(self._field("url"), F.lit(""))
            found = url.rlike(f"(?i){pattern}") if self._pattern_ok(pattern) else url.contains(pattern)
            return (url != "") & found
        if kind == "text_contains":
            if not pattern:
                return F.lit(False)
            text = F.concat(F.coalesce(self._field("title"), F.lit("")), F.lit(" "), F.coalesce(self._field("content"), F.lit("")))
            return F.lower(text).contains(pattern.lower())
        if kind == "compare":
            return self._compare(c)
        if kind == "flag":
            if not c.get("field") or "flags" not in self.names:
                return F.lit(False)
            return F.coalesce(F.element_at(F.col("flags"), F.lit(c["field"])), F.lit(False))
        out = F.lit(kind == "and")
        for x in c.get("conditions") or ():
            out = out & self.condition(x) if kind == "and" else out | self.condition(x)
        return out

    def tree(self, node: dict, path: tuple = ()) -> Column:
        """Struct match, confidence, path, reason."""
        if node.get("result") is not None:
            sure = node["confidence"] if node.get("confidence") is not None else 0.8 if node["result"] else 0.2
            return self._leaf(node["result"], sure, path)
        c = node.get("condition")
        if not c:
            return self._leaf(False, 0.0, path)
        sides = []
        for branch, met in (("yes", True), ("no", False)):
            steps = (*path, (node["id"], describe(c), met, branch))
            sides.append(self.tree(node[branch], steps) if node.get(branch) else self._leaf(met, 0.5, steps))
        return F.when(self.condition(c), sides[0]).otherwise(sides[1])

    def _leaf(self, match: bool, confidence: float, path: tuple) -> Column:
        kind = "array<struct<nodeId:string,condition:string,result:boolean,branch:string>>"
        steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("nodeId", "condition", "result", "branch"), p, strict=True))) for p in path)).cast(kind)
        reason = ",".join(f"{p[0]}:{p[3]}" for p in path) or "empty-tree"
        return F.struct(F.lit(match).alias("match"), F.lit(float(confidence)).alias("confidence"), steps.alias("path"), F.lit(reason).alias("reason"))


def evaluate_tree(df: DataFrame, tree: dict | str) -> Column:
    return Compiler(df).tree(validate(tree))


def evaluate_all(df: DataFrame, trees: dict[str, dict | str]) -> Column:
    """Array of structs (category, result...) in the order of ``trees``."""
    c = Compiler(df)
    return F.array(*(F.struct(F.lit(k).alias("category"), c.tree(validate(t)).alias("result")) for k, t in trees.items()))


def matches(df: DataFrame, trees: dict[str, dict | str]) -> Column:
    return F.filter(evaluate_all(df, trees), lambda x: x["result"]["match"])
