"""Ad-hoc XPath over many documents: plain paths as filters on the node relation, everything else evaluated document by document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shred import Node, XmlError, bounded, location, parse, without_declared_encoding
from .schematron import Ruleset
from .xpath import Focus, XPathError, XPathSyntaxError, compile_xpath, text_of

_STEP = r"(?:@?(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*)"
_PLAIN = re.compile(rf"(//|/)({_STEP}(?:/{_STEP})*)(?:\[(\d+)\])?")
ITEMS = "doc_id string, item int, kind string, value string, location string, line int, error string"
_SCHEMA = pa.schema([("doc_id", pa.string()), ("item", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("location", pa.string()), ("line", pa.int32()), ("error", pa.string())])


def is_plain(expr: str) -> bool:
    return _PLAIN.fullmatch(expr.strip()) is not None


def on_nodes(nodes: DataFrame, expr: str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """Nodes at a plain path (/a/b, //a/b, //a/@b, with a position per parent behind the last step): one filter, no join."""
    m = _PLAIN.fullmatch(expr.strip())
    if not m:
        raise ValueError(f"{expr} is no plain path")
    steps = []
    for s in m[2].split("/"):
        at, name = ("@", s[1:]) if s.startswith("@") else ("", s)
        prefix, _, local = name.rpartition(":")
        steps.append(at + (f"{{{(namespaces or {})[prefix]}}}{local}" if prefix else local))
    path, last = "/" + "/".join(steps), steps[-1]
    kind = "attribute" if last.startswith("@") else "element"
    out = nodes.filter((F.col("kind") == kind) & (F.col("qkey") == last.lstrip("@")))
    out = out.filter(F.col("path_key") == path) if m[1] == "/" else out.filter(F.endswith("path_key", F.lit(path)))
    return out.filter(F.col("sib_idx") == int(m[3])) if m[3] else out


def select_path(docs: DataFrame, expr: str, namespaces: dict[str, str] | None = None, variables: dict | None = None) -> DataFrame:
    """docs (doc_id, xml) -> a row per item of the result, in its order. An error is a row with its code; documents that are no XML give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_xpath(expr, namespaces)
        for b in batches:
            out = []
            for doc_id, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(without_declared_encoding(xml or ""))
                    for i, x in enumerate(compiled(Focus(doc, 1, 1, dict(variables or {}), {}, doc)), 1):
                        out.append((doc_id, i, x.kind if isinstance(x, Node) else "value", text_of(x), location(x) or "/" if isinstance(x, Node) else None, x.line if isinstance(x, Node) else None, None))
                except XmlError:
                    continue
                except XPathError as e:
                    out.append((doc_id, 0, "error", None, None, None, e.code))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return bounded(docs).select(docs["doc_id"].cast("string").alias("doc_id"), "xml").mapInArrow(run, ITEMS)


VALUES = "doc_id string, key string, value string"
_VALUES_SCHEMA = pa.schema([("doc_id", pa.string()), ("key", pa.string()), ("value", pa.string())])


def evaluate(docs: DataFrame, expressions: dict[str, str], namespaces: dict[str, str] | None = None, variables: dict | None = None, functions: dict | None = None, by: str = "|") -> DataFrame:
    """docs (doc_id, xml) -> a row per document and expression: its items as text, joined by ``by``; an error is ``!`` and its code.

    Documents are parsed once, expressions compiled once a task. Documents that are no XML give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {}
        for key, expr in expressions.items():
            try:
                compiled[key] = compile_xpath(expr, namespaces)
            except XPathSyntaxError:
                compiled[key] = None
        for b in batches:
            out = []
            for doc_id, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(without_declared_encoding(xml or ""))
                except XmlError:
                    continue
                for key, one in compiled.items():
                    try:
                        value = "!XPST0003" if one is None else by.join(map(text_of, one(Focus(doc, 1, 1, dict(variables or {}), dict(functions or {}), doc))))
                    except XPathError as e:
                        value = f"!{e.code}"
                    out.append((doc_id, key, value))
            if out:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=_VALUES_SCHEMA)

    return bounded(docs).select(docs["doc_id"].cast("string").alias("doc_id"), "xml").mapInArrow(run, VALUES)


def rule_catalog(spark: SparkSession, rulesets: list[Ruleset]) -> DataFrame:
    """A row per assertion of the rule sets: rule_set, pattern_ord, rule_ord, assert_ord, id, flag, context, test, shape.

    ``shape`` tells how it is evaluated: ``join`` on the node relation, or ``document``.
    """
    from .structural import split

    rows = []
    for r in rulesets:
        joined = {(s.pattern_ord, s.rule_id, s.assert_ord) for s in split(r)[0]}
        rows += [(*x, "join" if (x[1], x[4], x[3]) in joined else "document") for x in r.catalog()]
    return spark.createDataFrame(rows, "rule_set string, pattern_ord int, rule_ord int, assert_ord int, id string, flag string, context string, test string, shape string")


def rule_set_info(catalog: DataFrame) -> DataFrame:
    """Assertions of each rule set: total, by flag, and how many are evaluated as joins."""
    flags = [F.count_if(F.col("flag") == f).alias(f) for f in ("fatal", "warning", "information")]
    return catalog.groupBy("rule_set").agg(F.count("*").alias("assertions"), *flags, F.count_if(F.col("shape") == "join").alias("joins"))
