"""Structural assertions as joins over all documents at once.

Most assertions of the invoice rule sets ask whether a context has a node at a fixed place below it: ``not(cac:A/cbc:B)`` forbids one,
``cbc:B`` or ``exists(cbc:B)`` requires one, ``count(cbc:B) <= 1`` bounds their number. Others look at the values there: that the first is not blank, that none
has more than two decimals, that it is one of a list of codes. Such assertions become rows of a small table (rule, last
name of the context, place below it), broadcast against the node relation: one join finds the contexts, one the nodes below
them, one aggregation counts. ``split`` leaves everything else to the per-document evaluation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xp
from .schematron import Assertion, Rule, Ruleset, branches

_NAME = r"(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*"
_PATH = re.compile(rf"(?:{_NAME}/)*@?{_NAME}")
_CONTEXT = re.compile(rf"(//|/)((?:{_NAME}/)*{_NAME})")
_FORBID = re.compile(rf"not\(\s*({_PATH.pattern})\s*\)")
_REQUIRE = re.compile(rf"(?:exists\(\s*({_PATH.pattern})\s*\)|\(?\s*({_PATH.pattern})\s*\)?)")
_STEP_NAME = rf"@?{_NAME}"
_FILLED = re.compile(rf"normalize-space\(\s*\(\s*({_PATH.pattern})\s*\)\[1\]\s*\) != ''")
_DECIMALS = re.compile(rf"every \$(\w+) in ({_PATH.pattern}) satisfies string-length\(substring-after\(\$\1, '\.'\)\) <= 2")
_LISTED = re.compile(rf"(not\((@{_NAME})\) or )?normalize-space\((\.|@?{_NAME})\) = \(('[^']*'(?:, '[^']*')*)\)")
_COUNT = re.compile(rf"count\(\s*({_PATH.pattern})\s*\)\s*(<=|<|=|>=|>)\s*(\d+)")


@dataclass(frozen=True)
class Shape:
    """Fires on a context whose number of nodes at ``below`` (itself, if that is empty) is not within low and high.

    ``kind`` tells which nodes count: any; filled: the first, if it is not blank; decimals: those of more than two; listed, unlisted: those whose value is one of ``codes`` or none.
    """

    rule_set: str
    pattern_ord: int
    assert_ord: int
    rule_id: str
    flag: str
    message: str
    context: tuple[str, ...]
    anchored: bool
    below: tuple[str, ...]
    low: int
    high: int
    kind: str = "any"
    codes: tuple[str, ...] = ()


def _steps(path: str, ns: dict[str, str]) -> tuple[str, ...] | None:
    out = []
    for step in path.split("/"):
        at, name = ("@", step[1:]) if step.startswith("@") else ("", step)
        prefix, _, local = name.rpartition(":")
        if prefix and prefix not in ns:
            return None
        out.append(at + (f"{{{ns[prefix]}}}{local}" if prefix else local))
    return tuple(out)


def _bounds(a: Assertion) -> tuple | None:
    """The place below the context, least and most nodes, and which nodes count."""
    test = " ".join(a.test.split())
    if a.report or any(kind != "text" for kind, _ in a.message):
        return None
    if m := _FORBID.fullmatch(test):
        return m[1], 0, 0
    if m := _COUNT.fullmatch(test):
        n = int(m[3])
        return (m[1], *{"<=": (0, n), "<": (0, n - 1), "=": (n, n), ">=": (n, 1 << 30), ">": (n + 1, 1 << 30)}[m[2]])
    if m := _FILLED.fullmatch(test):
        return m[1], 1, 1 << 30, "filled"
    if m := _DECIMALS.fullmatch(test):
        return m[2], 0, 0, "decimals"
    if m := _LISTED.fullmatch(test):
        codes = tuple(x.strip("'") for x in m[4].split(", "))
        if m[1]:
            return (m[3], 0, 0, "unlisted", codes) if m[2] == m[3] else None
        return m[3], 1, 1 << 30, "listed", codes
    if (m := _REQUIRE.fullmatch(test)) and test not in ("true", "false"):
        return m[1] or m[2], 1, 1 << 30
    return None


def _bare(path: str) -> str:
    """A path without its predicates."""
    out, depth, quote = [], 0, ""
    for ch in path:
        if quote:
            quote = "" if ch == quote else quote
        elif depth and ch in "'\"":
            quote = ch
        elif ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
            continue
        if not depth:
            out.append(ch)
    return "".join(out).strip()


_ENDING = re.compile(r"\*\[\s*ends-with\(\s*(?:local-)?name\(\)\s*,\s*'([\w.-]+)'\s*\)(?:(?!\bor\b).)*\]$", re.S)


def _last(context: str, ns: dict[str, str]) -> set[str] | None:
    """The names of nodes that a context may select, ``*x`` for any name that ends in x; None if that is not plain from it."""
    out = set()
    for b in branches(context):
        last = _bare(b).rsplit("/", 1)[-1]
        ending = _ENDING.search(b)
        if last == "*" and ending:
            out.add("*" + ending[1])
            continue
        steps = _steps(last, ns) if re.fullmatch(_STEP_NAME, last) else None
        if not steps:
            return None
        out.add(steps[-1])
    return out


def _clash(names: set[str], taken: set[str]) -> bool:
    """Whether a name of one set may be one of the other."""
    end = lambda x: x[1:] if x[0] == "*" else x
    may = lambda a, b: a == b or (a[0] == "*" and end(b).endswith(end(a))) or (b[0] == "*" and end(a).endswith(end(b)))
    return any(may(a, b) for a in names for b in taken)


def split(rules: Ruleset) -> tuple[list[Shape], Ruleset]:
    """The structural assertions, and a rule set of the others with all rules in place, so that ownership is unchanged.

    A rule qualifies where each of its contexts is a plain path and no earlier rule of its pattern could own nodes of that name.
    """
    shapes: list[Shape] = []
    rest = replace(rules, patterns=[])
    for p, pattern in enumerate(rules.patterns):
        taken: set[str] | None = set()
        kept = []
        for rule in pattern:
            names = _last(rule.context, rules.namespaces)
            plain = [_CONTEXT.fullmatch(b) for b in branches(rule.context)]
            own = taken is not None and names is not None and not _clash(names, taken) and all(plain)
            steps = [(_steps(m[2], rules.namespaces), m[1] == "/") for m in plain] if own else []
            # a node that two branches of one context select is one context
            own = own and len({s[-1] for s, _ in steps}) == len(steps)
            left = []
            for a in rule.asserts:
                bounds = _bounds(a) if own else None
                below = (() if bounds[0] == "." else _steps(bounds[0], rules.namespaces)) if bounds else None
                if below is None:
                    left.append(a)
                    continue
                text = " ".join("".join(t for _, t in a.message).split())
                shapes += [Shape(rules.id, p, a.place, a.id, a.flag, text, s, anchored, below, *bounds[1:]) for s, anchored in steps]
            kept.append(Rule(rule.context, rule.lets, left))
            taken = None if taken is None or names is None else taken | names
        rest.patterns.append(kept)
    return shapes, rest


def names(shapes: list[Shape]) -> frozenset[str]:
    """The keys of all nodes that ``findings`` asks for: contexts, and what ends a place below them."""
    return frozenset(x[-1].lstrip("@") for s in shapes for x in (s.context, s.below) if x)


#: Longer values are in no list of codes.
LONGEST_CODE = 100
FOUND = ["doc_id", "rule_set", "pattern_ord", "node_pre", "assert_ord", "rule_id", "flag", "message", "location", "line"]


def findings(nodes: DataFrame, shapes: list[Shape]) -> DataFrame:
    """One row for each context on which a shape fires. The table of shapes is as long as the rule set, and broadcast."""
    spark = nodes.sparkSession
    suffix = lambda steps: "/" + "/".join(steps)
    place = lambda s: s.below or s.context[-1:]
    rows = [
        (i, s.rule_set, s.pattern_ord, s.assert_ord, s.rule_id, s.flag, s.message, s.context[-1], suffix(s.context), s.anchored, place(s)[-1].lstrip("@"), "attribute" if place(s)[-1].startswith("@") else "element", suffix(place(s)), len(s.below), s.low, s.high, s.kind, list(s.codes))
        for i, s in enumerate(shapes)
    ]
    table = spark.createDataFrame(rows, "shape int, rule_set string, pattern_ord int, assert_ord int, rule_id string, flag string, message string, c_key string, c_path string, anchored boolean, b_key string, b_kind string, b_path string, b_len int, low int, high int, of string, codes array<string>")
    at = lambda path, end, whole: F.when(whole, F.col(path) == F.col(end)).otherwise(F.endswith(F.col(path), F.col(end)))
    context = nodes.filter("kind = 'element'").select("doc_id", F.col("pre").alias("c_pre"), F.col("last_pre").alias("c_last"), F.col("depth").alias("c_depth"), "qkey", "path_key", "location", "line")
    context = context.join(F.broadcast(table), F.col("qkey") == F.col("c_key")).filter(at("path_key", "c_path", F.col("anchored")))
    # nodes whose name ends some shape's place, with the context's depth they would have
    ends = F.broadcast(table.select("b_key", "b_kind", "b_path", "b_len").distinct())
    value = xp.nspace("sval")
    below = nodes.select("doc_id", "pre", "depth", F.when(F.length(value) <= LONGEST_CODE, value).otherwise(F.lit(None)).alias("value"), (value != "").alias("filled"), xp.two_decimals("sval").alias("short"), F.col("kind").alias("k"), F.col("qkey").alias("q"), F.col("path_key").alias("p"))
    below = below.join(ends, (F.col("q") == F.col("b_key")) & (F.col("k") == F.col("b_kind"))).filter(F.endswith("p", F.col("b_path")))
    below = below.select("doc_id", "pre", "value", "filled", "short", F.col("b_path").alias("n_path"), (F.col("depth") - F.col("b_len")).alias("n_depth"))
    pair = context.select("doc_id", "shape", "c_pre", "c_last", "c_depth", "of", "codes", F.col("b_path").alias("n_path"), F.col("b_len").alias("n_len"))
    pair = pair.join(below.withColumnRenamed("n_depth", "c_depth"), ["doc_id", "n_path", "c_depth"]).filter("pre >= c_pre and pre <= c_last")
    listed = F.coalesce(F.array_contains("codes", F.col("value")), F.lit(False))
    counts = {"any": F.lit(True), "decimals": ~F.col("short"), "listed": listed, "unlisted": ~listed}
    which = F.coalesce(*(F.when(F.col("of") == k, c) for k, c in counts.items()), F.lit(False))
    first = F.when(F.max("of") == "filled", F.min_by("filled", "pre").cast("long"))
    counted = pair.groupBy("doc_id", "shape", "c_pre").agg(F.coalesce(first, F.count_if(which)).alias("n"))
    out = context.join(counted, ["doc_id", "shape", "c_pre"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.filter("n < low or n > high").withColumnRenamed("c_pre", "node_pre").select(*FOUND)
