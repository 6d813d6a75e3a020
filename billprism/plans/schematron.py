"""Rule sets in Schematron with XPath 2.0 tests, evaluated over many documents: one Arrow pass, one row per finding."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.shred import Forms, Node, XmlError, bounded, location, parse, slices, without_declared_encoding
from .recall import Plan, names_used
from .xpath import Compiled, Focus, XPathError, XPathSyntaxError, boolean, compile_xpath, nodes_told, remembered, text_of

SCH, XSL = "http://purl.oclc.org/dsdl/schematron", "http://www.w3.org/1999/XSL/Transform"


@dataclass
class Assertion:
    id: str
    flag: str
    test: str
    report: bool
    message: list[tuple[str, str]]  # ("text", words), ("name", path) or ("value", expression)
    place: int  # among its rule's assertions


@dataclass
class Rule:
    context: str
    lets: list[tuple[str, str]] = field(default_factory=list)
    asserts: list[Assertion] = field(default_factory=list)


@dataclass
class Function:
    key: tuple[str, int]
    params: list[str]
    lets: list[tuple[str, str]]
    body: str


@dataclass
class Ruleset:
    """A compiled rule set. ``lets`` holds the global ones and those of patterns."""

    id: str
    namespaces: dict[str, str] = field(default_factory=dict)
    lets: list[tuple[str, str]] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    patterns: list[list[Rule]] = field(default_factory=list)

    @classmethod
    def from_text(cls, text: str, id: str, includes: dict[str, str] | None = None) -> Ruleset:
        """Phases and diagnostics are left out, abstract patterns and rules skipped."""
        out = cls(id)
        out._read(parse(without_declared_encoding(text)).children, includes or {})
        return out

    def _read(self, nodes: list[Node], includes: dict[str, str]) -> None:
        for n in nodes:
            if n.kind != "element":
                continue
            a = {x.local: x.value for x in n.attributes}
            if n.ns == XSL and n.local == "function":
                self._function(n, a)
            elif n.ns != SCH:
                continue
            elif n.local == "schema":
                self._read(n.children, includes)
            elif n.local == "ns":
                self.namespaces[a["prefix"]] = a["uri"]
            elif n.local == "let":
                self.lets.append((a["name"], a["value"]))
            elif n.local == "include":
                if a["href"] not in includes:
                    raise ValueError(f"no text for include {a['href']}")
                inner = parse(without_declared_encoding(includes[a["href"]]))
                self._read(inner.children, includes)
            elif n.local == "pattern" and a.get("abstract") != "true":
                self._pattern(n, includes)

    def _pattern(self, pattern: Node, includes: dict[str, str]) -> None:
        rules = []
        for n in pattern.children:
            a = {x.local: x.value for x in n.attributes}
            if n.ns != SCH:
                continue
            if n.local == "let":
                self.lets.append((a["name"], a["value"]))
            elif n.local == "include" and a["href"] in includes:
                self._read([c for c in parse(without_declared_encoding(includes[a["href"]])).children], includes)
            elif n.local == "rule" and a.get("abstract") != "true" and "context" in a:
                rule = Rule(a["context"])
                for c in n.children:
                    b = {x.local: x.value for x in c.attributes}
                    if c.ns == SCH and c.local == "let":
                        rule.lets.append((b["name"], b["value"]))
                    elif c.ns == SCH and c.local in ("assert", "report"):
                        rule.asserts.append(Assertion(b.get("id", ""), flag_of(b.get("flag") or b.get("role")), b["test"], c.local == "report", _message(c), len(rule.asserts)))
                rules.append(rule)
        self.patterns.append(rules)

    def _function(self, n: Node, a: dict[str, str]) -> None:
        named = lambda local, get: [(x["name"], x.get(get, "")) for c in n.children if c.ns == XSL and c.local == local for x in [{y.local: y.value for y in c.attributes}]]
        params = [p for p, _ in named("param", "name")]
        body = next((y.value for c in n.children if c.ns == XSL and c.local in ("sequence", "value-of") for y in c.attributes if y.local == "select"), "()")
        prefix, _, local = a["name"].rpartition(":")
        uri = n.namespaces.get(prefix, "")
        self.functions.append(Function((f"{{{uri}}}{local}", len(params)), params, named("variable", "select"), body))
        self.namespaces.setdefault(prefix, uri)

    def catalog(self) -> list[tuple]:
        """(rule_set, pattern_ord, rule_ord, assert_ord, id, flag, context, test)"""
        return [(self.id, p, r, x.place, x.id, x.flag, rule.context, x.test) for p, rules in enumerate(self.patterns) for r, rule in enumerate(rules) for x in rule.asserts]


def flag_of(flag: str | None) -> str:
    low = (flag or "").strip().lower()
    return {"warn": "warning", "warning": "warning", "info": "information", "information": "information"}.get(low, "fatal")


def _message(n: Node) -> list[tuple[str, str]]:
    out = []
    for c in n.children:
        a = {x.local: x.value for x in c.attributes}
        if c.kind == "text":
            out.append(("text", c.value))
        elif c.local == "value-of":
            out.append(("value", a["select"]))
        elif c.local == "name":
            out.append(("name", a.get("path", ".")))
        elif c.kind == "element":
            out += _message(c)
    return out


def branches(context: str) -> list[str]:
    """The alternatives of a context, each as an absolute path."""
    parts, depth, quote, now = [], 0, "", ""
    for ch in context:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and not depth:
            parts.append(now)
            now = ""
            continue
        now += ch
    return [p if p.startswith("/") else f"//{p}" for p in (x.strip() for x in [*parts, now]) if p]


class Runner:
    """Compiles every expression of a rule set once, then runs it on documents."""

    def __init__(self, rules: Ruleset, functions: dict | None = None):
        self.rules, self.extra = rules, functions or {}
        self.cache: dict[str, Compiled | XPathError] = {}
        self.branches = {rule.context: branches(rule.context) for p in rules.patterns for rule in p}
        self.kept = [0]  # paths that units of all forms keep
        self.free, self.bound, named = {}, {}, {name for name, _ in rules.lets}
        for i, p in enumerate(rules.patterns):  # those of equal contexts together; apart from those that need the rule set's variables
            needs = rules.functions or names_used([t for rule in p for t in texts_of(rule)]) & named
            (self.bound if needs else self.free).setdefault(tuple(rule.context for rule in p), []).append(i)
        every = [t for p in rules.patterns for rule in p for t in texts_of(rule)] + [t for _, t in rules.lets] + [t for f in rules.functions for t in (f.body, *(x for _, x in f.lets))]
        self.recalls = not self.extra and not any("current-date" in t for t in every)

    def eval(self, text: str, focus: Focus) -> list:
        found = self.cache.get(text)
        if found is None:
            try:
                found = compile_xpath(text, self.rules.namespaces)
                found = remembered(found) if nodes_told(found) else found
            except XPathSyntaxError as e:
                found = XPathError("XPST0003", str(e))
            self.cache[text] = found
        if isinstance(found, XPathError):
            raise found
        return found(focus)

    def user(self, f: Function, base: Focus):
        def call(focus: Focus, *args: list) -> list:
            inner = Focus(None, 1, 1, {**base.variables, **dict(zip(f.params, args, strict=True))}, base.functions)
            for name, expr in f.lets:
                inner = inner.bind(name, self.eval(expr, inner))
            return self.eval(f.body, inner)

        return call

    def base(self, doc: Node, variables: dict | None = None) -> Focus:
        """The focus of a document with the rule set's variables and functions."""
        base = Focus(doc, 1, 1, dict(variables or {}), dict(self.extra), doc)
        base.functions |= {f.key: self.user(f, base) for f in self.rules.functions}
        open_lets = list(self.rules.lets)
        while open_lets:  # lets may use each other in any order
            left = []
            for name, expr in open_lets:
                try:
                    base.variables[name] = self.eval(expr, base)
                except XPathError as e:
                    left.append((name, expr))
                    if e.code != "XPST0008":
                        base.variables.setdefault(name, [])
                        left.pop()
            if len(left) == len(open_lets):
                base.variables |= {name: [] for name, _ in left}
                break
            open_lets = left
        return base

    def fired(self, n: Node, rule: Rule, asserts: list[Assertion], base: Focus) -> Iterator[tuple]:
        """(assertion, message, evaluation_error) of those that a node fails."""
        focus = Focus(n, 1, 1, dict(base.variables) if rule.lets else base.variables, base.functions, n)
        for name, expr in rule.lets:
            try:
                focus.variables[name] = self.eval(expr, focus)
            except XPathError:
                focus.variables[name] = []
        for a in asserts:
            error = None
            try:
                fired = boolean(self.eval(a.test, focus)) == a.report
            except (XPathError, RecursionError) as e:
                fired, error = True, str(e)
            if fired:
                yield a, self.render(a.message, focus), error

    def run(self, doc: Node, variables: dict | None = None) -> Iterator[tuple]:
        """(pattern_ord, node_pre, assert_ord, id, flag, message, location, line, evaluation_error) in the order of evaluation."""
        if doc.memo is not None and self.recalls:
            plan = doc.memo.get(self)
            if plan is None:
                plan = doc.memo[self] = Plan(self, doc, variables or {})
            yield from plan.run(doc.memo["texts"])
            return
        base = self.base(doc, variables)
        selected: dict[str, list] = {}  # contexts see the document and the global lets only, so equal ones select the same
        for p, rules in enumerate(self.rules.patterns):
            owner: dict[int, tuple[Node, Rule]] = {}
            for rule in rules:
                if rule.context not in selected:
                    try:
                        selected[rule.context] = [n for b in self.branches[rule.context] for n in self.eval(b, base)]
                    except XPathError:
                        selected[rule.context] = []
                for n in selected[rule.context]:
                    if isinstance(n, Node):
                        owner.setdefault(n.pre, (n, rule))
            for pre in sorted(owner):
                n, rule = owner[pre]
                for a, message, error in self.fired(n, rule, rule.asserts, base):
                    yield p, pre, a.place, a.id, a.flag, message, location(n) or "/", n.line, error

    def render(self, message: list[tuple[str, str]], focus: Focus) -> str:
        out = []
        for kind, x in message:
            if kind == "text":
                out.append(x)
                continue
            try:
                got = self.eval(x, focus)
                out.append("" if not got else (got[0].name if kind == "name" and isinstance(got[0], Node) else " ".join(map(text_of, got))))
            except XPathError:
                continue
        return re.sub(r"\s+", " ", "".join(out)).strip()


def texts_of(rule: Rule) -> list[str]:
    """All expressions of a rule."""
    return [rule.context, *(t for _, t in rule.lets), *(t for a in rule.asserts for t in (a.test, *(x for kind, x in a.message if kind != "text")))]


FINDINGS = "doc_id string, rule_set string, rule_set_ord int, pattern_ord int, node_pre long, assert_ord int, rule_id string, flag string, message string, location string, line int, evaluation_error string"
_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in FINDINGS.split(", ")])


def check(docs: DataFrame, rulesets: list[Ruleset], wanted: str | None = None, functions: dict | None = None, variables: dict | None = None) -> DataFrame:
    """docs (doc_id, xml) -> findings of the rule sets, or of those whose ids the array column ``wanted`` names for a document.

    Documents that are not well-formed, or null, give no rows. Each document is evaluated alone, so a bad one costs no other: an error that no
    assertion accounts for is a finding SUM-RULESET of that document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = evaluator(rulesets, functions, variables)
        for b in slices(batches):
            lists = b.column(2).to_pylist() if wanted else [None] * b.num_rows
            out = [(doc_id, *x) for doc_id, xml, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists, strict=True) for x in evaluate(xml, names if not wanted else names or [])]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    columns = [docs["doc_id"].cast("string").alias("doc_id"), docs["xml"]] + ([docs[wanted]] if wanted else [])
    return bounded(docs).select(*columns).mapInArrow(run, FINDINGS)


class evaluator:
    """A function of a document's text and the ids of the rule sets that it is checked by, or None for all -> its findings without their doc_id."""

    def __init__(self, rulesets: list[Ruleset], functions: dict | None = None, variables: dict | None = None):
        self.runners, self.forms, self.variables = [Runner(r, functions) for r in rulesets], Forms(), variables
        gc.set_threshold(max(gc.get_threshold()[0], 50_000), 20, 20)  # trees of forms live long, and each collection walks through them

    def __call__(self, xml: str | None, names: list[str] | None) -> list[tuple]:
        if xml is None or not self.own(names):
            return []
        try:
            doc = self.forms.parse(without_declared_encoding(xml))
        except XmlError:
            return []
        return self.of(doc, names)

    def own(self, names: list[str] | None) -> list[tuple[int, Runner]]:
        return [(i, r) for i, r in enumerate(self.runners) if names is None or r.rules.id in names]

    def of(self, doc: Node, names: list[str] | None) -> list[tuple]:
        """The findings of a parsed document."""
        out: list[tuple] = []
        for i, r in self.own(names):
            try:
                out += [(r.rules.id, i, *x) for x in r.run(doc, self.variables)]
            except Exception as e:  # whatever a document does to a rule set, the others are still checked
                out.append((r.rules.id, i, -1, 0, 0, "SUM-RULESET", "fatal", f"The rule set could not be evaluated: {e}", "/", 1, f"{type(e).__name__}: {e}"))
        return out


def fired_type() -> T.DataType:
    """The type of a document's list of findings."""
    return T.ArrayType(T._parse_datatype_string(FINDINGS.partition(", ")[2]))


def fired_lists(found: list[list[tuple]]) -> pa.ListArray:
    """The findings of each document as an array of that type."""
    inner = pa.struct(list(_SCHEMA)[1:])
    flat = [x for f in found for x in f]
    columns = zip(*flat, strict=True) if flat else [[]] * inner.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, inner, strict=True)], fields=list(inner))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), items)
