"""XML Schema checks of many documents: schemas compile on the driver into plain tables, which Arrow tasks run over parsed documents.

A content model becomes a regular expression over one character per element name, so the verdict on an element's children is one match; only
where it fails are the children walked to tell what is wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shred import Node, XmlError, bounded, location, parse, without_declared_encoding
from .xpath import pattern as xpath_pattern

XSD, XSI = "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance"
MANY = 1 << 30


class SchemaError(ValueError):
    """A construct that is not supported."""


@dataclass
class Simple:
    base: str
    facets: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Particle:
    kind: str  # element, sequence, choice, all, any
    low: int = 1
    high: int = 1
    key: str = ""
    type: str = ""
    parts: list[Particle] = field(default_factory=list)
    spaces: str = "##any"
    process: str = "strict"


@dataclass
class Complex:
    content: Particle | None = None
    text: str = ""  # type of simple content
    mixed: bool = False
    attributes: dict[str, tuple[str, bool, str | None]] = field(default_factory=dict)


@dataclass
class Schema:
    elements: dict[str, str] = field(default_factory=dict)
    types: dict[str, Simple | Complex] = field(default_factory=dict)
    spaces: set[str] = field(default_factory=set)

    @classmethod
    def from_texts(cls, texts: dict[str, str], entry: str) -> Schema:
        """texts: file name -> schema; imports and includes are looked up by the last part of their location."""
        reader = _Reader(texts)
        reader.read(entry, None)
        reader.finish()
        return reader.schema


def _kids(n: Node, *names: str) -> list[Node]:
    return [c for c in n.children if c.kind == "element" and c.ns == XSD and (not names or c.local in names)]


class _Reader:
    def __init__(self, texts: dict[str, str]):
        self.texts = {k.rsplit("/", 1)[-1]: v for k, v in texts.items()}
        self.schema, self.seen, self.later = Schema(), set(), []
        self.attributes: dict[str, tuple] = {}
        self.groups: dict[str, tuple] = {}
        self.count = 0

    def read(self, name: str, space: str | None) -> None:
        name = name.rsplit("/", 1)[-1]
        if (name, space) in self.seen:
            return
        self.seen.add((name, space))
        root = next(c for c in parse(without_declared_encoding(self.texts[name])).children if c.kind == "element")
        a = _attrs(root)
        target = a.get("targetNamespace", space or "")
        self.schema.spaces.add(target)
        self.qualified = a.get("elementFormDefault") == "qualified"
        ctx = (target, a.get("elementFormDefault") == "qualified", a.get("attributeFormDefault") == "qualified")
        for c in _kids(root):
            b = _attrs(c)
            key = f"{{{target}}}{b.get('name', '')}" if target else b.get("name", "")
            if c.local in ("import", "include"):
                if b.get("schemaLocation", "").rsplit("/", 1)[-1] in self.texts:
                    self.read(b["schemaLocation"], target if c.local == "include" else None)
            elif c.local == "element":
                if "substitutionGroup" in b or b.get("nillable") == "true" or b.get("abstract") == "true":
                    raise SchemaError(f"{b['name']}: substitution groups and nillable elements are not supported")
                self.later.append((self._global_element, key, c, ctx))
            elif c.local in ("complexType", "simpleType"):
                self.later.append((self._type, key, c, ctx))
            elif c.local == "attribute":
                self.attributes[key] = (c, ctx)
            elif c.local in ("group", "attributeGroup"):
                self.groups[key] = (c, ctx)

    def finish(self) -> None:
        while self.later:
            f, *args = self.later.pop()
            f(*args)

    def _global_element(self, key: str, n: Node, ctx) -> None:
        self.schema.elements[key] = self._type_of(n, ctx)

    def _name(self, n: Node, qname: str) -> str:
        prefix, _, local = qname.rpartition(":")
        uri = n.namespaces.get(prefix, "")
        return f"{{{uri}}}{local}" if uri else local

    def _type_of(self, n: Node, ctx) -> str:
        a = _attrs(n)
        if "type" in a:
            return self._name(n, a["type"])
        for c in _kids(n, "complexType", "simpleType"):
            self.count += 1
            key = f"#{self.count}"
            self._type(key, c, ctx)
            return key
        return f"{{{XSD}}}anyType"

    def _type(self, key: str, n: Node, ctx) -> None:
        self.schema.types[key] = self._simple(n, ctx) if n.local == "simpleType" else self._complex(n, ctx)

    def _simple(self, n: Node, ctx) -> Simple:
        for r in _kids(n):
            if r.local == "restriction":
                a = _attrs(r)
                base = self._name(r, a["base"]) if "base" in a else self._type_of(r, ctx)
                return Simple(base, _facets(r))
            if r.local in ("list", "union"):
                raise SchemaError(f"xs:{r.local} is not supported")
        raise SchemaError("simple type without a restriction")

    def _complex(self, n: Node, ctx) -> Complex:
        out = Complex(mixed=_attrs(n).get("mixed") == "true")
        for c in _kids(n):
            if c.local == "annotation":
                continue
            if c.local in ("simpleContent", "complexContent"):
                d = _kids(c, "extension", "restriction")[0]
                base = self._name(d, _attrs(d)["base"])
                if c.local == "simpleContent":
                    out.text = base
                    if d.local == "restriction" and _facets(d):
                        self.count += 1
                        out.text = f"#{self.count}"
                        self.schema.types[out.text] = Simple(base, _facets(d))
                    out.attributes["#base"] = (base, False, None)
                else:
                    out.attributes["#base"] = (base, d.local == "extension", None)
                self._body(d, out, ctx)
            else:
                self._body(n, out, ctx)
                break
        return out

    def _body(self, n: Node, out: Complex, ctx) -> None:
        for c in _kids(n):
            a = _attrs(c)
            if c.local in ("sequence", "choice", "all", "group"):
                out.content = self._particle(c, ctx)
            elif c.local == "attribute":
                if a.get("use") == "prohibited":
                    continue
                if "ref" in a:
                    key = self._name(c, a["ref"])
                    decl, own = self.attributes.get(key, (None, ctx))
                    kind = self._type_of(decl, own) if decl is not None else f"{{{XSD}}}string"
                else:
                    key, kind = (f"{{{ctx[0]}}}{a['name']}" if (a.get("form") == "qualified" or ctx[2]) and ctx[0] else a["name"]), self._type_of(c, ctx)
                out.attributes[key] = (kind if "type" in a or _kids(c) or "ref" in a else f"{{{XSD}}}string", a.get("use") == "required", a.get("fixed"))
            elif c.local == "attributeGroup":
                g, own = self.groups[self._name(c, a["ref"])]
                self._body(g, out, own)
            elif c.local == "anyAttribute":
                raise SchemaError("xs:anyAttribute is not supported")

    def _particle(self, n: Node, ctx) -> Particle:
        a = _attrs(n)
        high = a.get("maxOccurs", "1")
        p = Particle(n.local, int(a.get("minOccurs", "1")), MANY if high == "unbounded" else int(high))
        if n.local == "element":
            if "ref" in a:
                p.key, p.type = self._name(n, a["ref"]), ""
            else:
                p.key = f"{{{ctx[0]}}}{a['name']}" if ctx[0] and a.get("form", "qualified" if ctx[1] else "unqualified") == "qualified" else a["name"]
                p.type = self._type_of(n, ctx)
        elif n.local == "any":
            p.spaces, p.process = a.get("namespace", "##any"), a.get("processContents", "strict")
            p.type = ctx[0]
        elif n.local == "group":
            g, own = self.groups[self._name(n, a["ref"])]
            inner = self._particle(_kids(g, "sequence", "choice", "all")[0], own)
            return Particle("sequence", p.low, p.high, parts=[inner])
        else:
            p.parts = [self._particle(c, ctx) for c in _kids(n, "element", "sequence", "choice", "all", "any", "group")]
        return p


def _attrs(n: Node) -> dict[str, str]:
    return {x.local: x.value for x in n.attributes}


FACETS = ("enumeration", "pattern", "length", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "totalDigits", "fractionDigits", "whiteSpace")


def _facets(n: Node) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in _kids(n, *FACETS):
        out.setdefault(c.local, []).append(_attrs(c)["value"])
    return out


# ---------------------------------------------------------------- values

_ZONE = r"(Z|[+-](0\d|1[0-4]):[0-5]\d)?"
_NUMBERS = {"byte": 7, "short": 15, "int": 31, "long": 63}
#: Lexical forms of the built-in types.
LEXICAL = {
    "boolean": r"true|false|1|0", "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN", "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN",
    "date": r"-?\d{4,}-\d\d-\d\d" + _ZONE, "dateTime": r"-?\d{4,}-\d\d-\d\dT([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d+)?" + _ZONE, "time": r"([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d+)?" + _ZONE,
    "gYear": r"-?\d{4,}" + _ZONE, "gYearMonth": r"-?\d{4,}-(0[1-9]|1[0-2])" + _ZONE, "gMonth": r"--(0[1-9]|1[0-2])" + _ZONE, "gDay": r"---(0[1-9]|[12]\d|3[01])" + _ZONE, "gMonthDay": r"--(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])" + _ZONE,
    "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?", "base64Binary": r"([A-Za-z0-9+/]\s*){0,}(=\s*){0,2}", "hexBinary": r"([0-9A-Fa-f]{2})*", "language": r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*",
    "NCName": r"[^\W\d][\w.\-]*", "ID": r"[^\W\d][\w.\-]*", "IDREF": r"[^\W\d][\w.\-]*", "ENTITY": r"[^\W\d][\w.\-]*", "Name": r"[^\W\d:]?[\w.\-:]*", "NMTOKEN": r"[\w.\-:]+", "QName": r"([^\W\d][\w.\-]*:)?[^\W\d][\w.\-]*",
}
_INTEGERS = {"integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1)}
_INTEGERS |= {k: (-(1 << b), (1 << b) - 1) for k, b in _NUMBERS.items()} | {f"unsigned{k.capitalize()}": (0, (1 << (b + 1)) - 1) for k, b in _NUMBERS.items()}
_COMPILED = {k: re.compile(v) for k, v in LEXICAL.items()}


def value_error(schema: Schema, kind: str, raw: str) -> str | None:
    """What is wrong with a value of a simple type; None if nothing is."""
    chain: list[Simple] = []
    while isinstance(t := schema.types.get(kind), (Simple, Complex)):
        if isinstance(t, Complex):
            kind = t.text or t.attributes.get("#base", (f"{{{XSD}}}string", 0, 0))[0]
            continue
        chain.append(t)
        kind = t.base
    name = kind.removeprefix(f"{{{XSD}}}")
    space = next((f for t in chain for f in t.facets.get("whiteSpace", ())), "preserve" if name == "string" else "replace" if name == "normalizedString" else "collapse")
    s = re.sub(r"[\t\n\r]", " ", raw) if space != "preserve" else raw
    s = re.sub(" +", " ", s).strip(" ") if space == "collapse" else s
    if name in _INTEGERS:
        low, high = _INTEGERS[name]
        if not re.fullmatch(r"[+-]?\d+", s) or (low is not None and int(s) < low) or (high is not None and int(s) > high):
            return f"{raw!r} is no valid {name}"
    elif name in _COMPILED:
        if not _COMPILED[name].fullmatch(s):
            return f"{raw!r} is no valid {name}"
        if name in ("date", "dateTime"):
            try:
                date.fromisoformat(s.lstrip("-")[:10])
            except ValueError:
                return f"{raw!r} is no valid {name}"
    size = len(s)
    number = None
    if re.fullmatch(LEXICAL["decimal"], s) and (name == "decimal" or name in _INTEGERS or name in ("float", "double")):
        from decimal import Decimal

        number = Decimal(s)
    for t in chain:
        for f, values in t.facets.items():
            v = values[0]
            bad = False
            if f == "enumeration":
                bad = s not in values
                v = ", ".join(values[:10]) + (" …" if len(values) > 10 else "")
            elif f == "pattern":
                bad = not any(xpath_pattern(p).fullmatch(s) for p in values)
            elif f in ("length", "minLength", "maxLength"):
                bad = {"length": size != int(v), "minLength": size < int(v), "maxLength": size > int(v)}[f]
            elif f == "totalDigits":
                bad = len(re.sub(r"^0+|[^\d]", "", s.split(".")[0].lstrip("+-0") + s.partition(".")[2].rstrip("0"))) > int(v)
            elif f == "fractionDigits":
                bad = len(s.partition(".")[2].rstrip("0")) > int(v)
            elif f.endswith(("Inclusive", "Exclusive")):
                a, b = (number, type(number)(v)) if number is not None else (s, v)
                bad = {"minInclusive": a < b, "maxInclusive": a > b, "minExclusive": a <= b, "maxExclusive": a >= b}[f]
            if bad:
                return f"{raw!r} does not meet {f} {v}"
    return None


# ---------------------------------------------------------------- documents


def _accepts(wild: Particle, ns: str) -> bool:
    """Whether a wildcard's namespace constraint takes a namespace; the particle's type is its schema's target."""
    if wild.spaces == "##any":
        return True
    if wild.spaces == "##other":
        return bool(ns) and ns != wild.type
    return any(ns == {"##local": "", "##targetNamespace": wild.type}.get(x, x) for x in wild.spaces.split())


#: Letters that stand for a model's wildcards, and for children no element of it names, by the wildcards that take their namespace.
_WILD, _OTHER = 0xE000, 0xF0000


class Checker:
    """kinds: unexpected-element, missing-element, element-order, too-many, content, value, missing-attribute, unknown-attribute, attribute-value."""

    def __init__(self, schema: Schema):
        self.schema, self.models = schema, {}

    def resolved(self, t: Complex) -> tuple[Particle | None, str, bool, dict]:
        content, text, attributes = t.content, t.text, {k: v for k, v in t.attributes.items() if k != "#base"}
        base = self.schema.types.get(t.attributes["#base"][0]) if "#base" in t.attributes else None
        if isinstance(base, Complex):
            c, x, _, more = self.resolved(base)
            attributes = {**more, **attributes}
            if t.attributes["#base"][1] and c is not None:  # extension
                content = Particle("sequence", parts=[p for p in (c, content) if p is not None])
            text = text if not isinstance(self.schema.types.get(text), Complex) else x
            text = x if text == t.attributes["#base"][0] and x else text
        return content, text, t.mixed, attributes

    def model(self, key: str):
        if key not in self.models:
            content, text, mixed, attributes = self.resolved(self.schema.types[key])
            letters: dict[str, str] = {}
            leaves: dict[str, Particle] = {}
            wilds: list[Particle] = []
            body = self._regex(content, letters, leaves, wilds) if content is not None else ""
            for i, w in enumerate(wilds):
                named = "".join(re.escape(x) for k, x in letters.items() if _accepts(w, k[1:].partition("}")[0] if k.startswith("{") else ""))
                body = body.replace(chr(_WILD + i), f"[{named}{''.join(chr(_OTHER + m) for m in range(1 << len(wilds)) if m >> i & 1)}]")
            slots = self._slots(content) if content is not None else []
            self.models[key] = (re.compile(body), letters, leaves, wilds, slots, content, text, mixed, attributes)
        return self.models[key]

    def _regex(self, p: Particle, letters: dict[str, str], leaves: dict[str, Particle], wilds: list[Particle]) -> str:
        if p.kind == "element":
            leaves.setdefault(p.key, p)
            one = re.escape(letters.setdefault(p.key, chr(0x4E00 + len(letters))))
        elif p.kind == "any":
            one = chr(_WILD + len(wilds))
            wilds.append(p)
        else:
            parts = [self._regex(x, letters, leaves, wilds) for x in p.parts]
            if p.kind == "all":
                one = "".join(f"(?=.*{x})" for x, q in zip(parts, p.parts, strict=True) if q.low) + f"(?:{'|'.join(parts)})*" if parts else ""
            else:
                one = f"(?:{('|' if p.kind == 'choice' else '').join(parts)})"
        if (p.low, p.high) == (1, 1):
            return one
        return f"(?:{one})" + ("*" if (p.low, p.high) == (0, MANY) else "+" if (p.low, p.high) == (1, MANY) else "?" if (p.low, p.high) == (0, 1) else f"{{{p.low},{'' if p.high == MANY else p.high}}}")

    def _slots(self, p: Particle) -> list[Particle] | None:
        """The elements of a sequence without choices, in order; None for other models."""
        if p.kind in ("element", "any"):
            return [p]
        if p.kind != "sequence" or (p.low, p.high) != (1, 1):
            return None
        out = []
        for x in p.parts:
            inner = self._slots(x)
            if inner is None:
                return None
            out += inner
        return out if len({x.key for x in out}) == len(out) else None

    def run(self, doc: Node) -> Iterator[tuple[str, str, Node]]:
        root = next(c for c in doc.children if c.kind == "element")
        if root.key not in self.schema.elements:
            yield "unexpected-element", f"element {root.name} is not declared", root
            return
        stack = [(root, self.schema.elements[root.key])]
        while stack:
            n, kind = stack.pop()
            own = {a.key: a for a in n.attributes}
            if f"{{{XSI}}}type" in own:
                continue
            if own.get(f"{{{XSI}}}nil", Node("attribute")).value in ("true", "1"):
                yield "content", f"element {n.name} may not be nil", n
                continue
            t = self.schema.types.get(kind)
            if not isinstance(t, Complex):
                if kind == f"{{{XSD}}}anyType":
                    continue
                yield from self._value(n, kind, {}, own)
                continue
            regex, letters, leaves, wilds, slots, content, text, mixed, attributes = self.model(kind)
            yield from self._attributes(n, attributes, own)
            kids = [c for c in n.children if c.kind == "element"]
            if text:
                yield from self._value(n, text, None, own)
                continue
            if not mixed and any(c.kind == "text" and c.value.strip(" \t\n\r") for c in n.children):
                yield "content", f"element {n.name} may not contain text", n
            takes = lambda c: sum(_accepts(w, c.ns) << i for i, w in enumerate(wilds))
            line = "".join(letters.get(c.key) or chr(_OTHER + takes(c)) for c in kids)
            if not regex.fullmatch(line):
                told = list(self._diagnose(n, kids, slots if content is not None else [], leaves, lambda c: takes(c) > 0))
                yield from told or [("content", f"the children of {n.name} do not match its content model", n)]
            children = []
            for c in kids:
                leaf = leaves.get(c.key)
                if leaf is None:
                    wild = next((w for w in wilds if _accepts(w, c.ns)), None)
                    if wild is not None and wild.process != "skip" and c.key in self.schema.elements:
                        children.append((c, self.schema.elements[c.key]))
                    elif wild is not None and wild.process == "strict":
                        yield "unexpected-element", f"element {c.name} is not declared", c
                    continue
                inner = leaf.type or self.schema.elements.get(leaf.key)
                if inner:
                    children.append((c, inner))
            stack += reversed(children)

    def _attributes(self, n: Node, declared: dict, own: dict[str, Node]):
        for key, a in own.items():
            if a.ns == XSI:
                continue
            if key not in declared:
                yield "unknown-attribute", f"attribute {a.name} is not allowed on {n.name}", a
                continue
            kind, _, fixed = declared[key]
            wrong = value_error(self.schema, kind, a.value)
            if wrong is None and fixed is not None and a.value != fixed:
                wrong = f"{a.value!r} must be {fixed!r}"
            if wrong:
                yield "attribute-value", f"attribute {a.name} of {n.name}: {wrong}", a
        for key, (_, required, _) in declared.items():
            if required and key not in own:
                yield "missing-attribute", f"attribute {key.rpartition('}')[2]} of {n.name} is missing", n

    def _value(self, n: Node, kind: str, declared, own):
        if declared is not None:
            yield from self._attributes(n, declared, own)
        inner = next((c for c in n.children if c.kind == "element"), None)
        if inner is not None:
            yield "unexpected-element", f"element {inner.name} is not allowed in {n.name}", inner
            return
        wrong = value_error(self.schema, kind, n.string())
        if wrong:
            yield "value", f"element {n.name}: {wrong}", n

    def _diagnose(self, n: Node, kids: list[Node], slots: list[Particle] | None, leaves: dict, takes):
        name = lambda key: key.rpartition("}")[2]
        if slots is None:
            bad = [c for c in kids if c.key not in leaves and not takes(c)]
            for c in bad[:1]:
                yield "unexpected-element", f"element {c.name} is not allowed in {n.name}", c
            if not bad:
                yield "content", f"the children of {n.name} do not match its content model", n
            return
        place = {s.key: i for i, s in enumerate(slots) if s.kind == "element"}
        there: dict[str, int] = {}
        for c in kids:
            there[c.key] = there.get(c.key, 0) + 1
        at, seen, told = 0, {}, set()
        for c in kids:
            i = place.get(c.key)
            if i is None:
                if not takes(c):
                    expected = ", ".join(name(s.key) for s in slots[at : at + 6])
                    yield "unexpected-element", f"element {c.name} is not allowed in {n.name}" + (f"; expected: {expected}" if expected else ""), c
                continue
            seen[c.key] = seen.get(c.key, 0) + 1
            if seen[c.key] > slots[i].high:
                if c.key not in told:
                    told.add(c.key)
                    yield "too-many", f"element {c.name} occurs {there[c.key]} times in {n.name}, at most {slots[i].high} allowed", c
            elif i < at:
                if c.key not in told:
                    told.add(c.key)
                    yield "element-order", f"element {c.name} must come before {name(slots[at].key)} in {n.name}", c
            else:
                at = i
        for s in slots:
            if s.kind == "element" and there.get(s.key, 0) < s.low:
                follows = next((c.name for c in kids if place.get(c.key, -1) > place[s.key]), None)
                yield "missing-element", f"Required element {name(s.key)} is missing in {n.name}" + (f" (expected before {follows})" if follows else ""), n


FOUND = "doc_id string, ord int, node_pre long, kind string, message string, location string, line int"
_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in FOUND.split(", ")])


def check(docs: DataFrame, schema: Schema) -> DataFrame:
    """docs (doc_id, xml) -> violations, in document order. Null or malformed documents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(schema)
        for b in batches:
            out = []
            for doc_id, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if xml is None:
                    continue
                try:
                    doc = parse(without_declared_encoding(xml))
                except XmlError:
                    continue
                out += [(doc_id, i, n.pre, kind, message, location(n) or "/", n.line) for i, (kind, message, n) in enumerate(checker.run(doc))]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return bounded(docs).select(docs["doc_id"].cast("string").alias("doc_id"), "xml").mapInArrow(run, FOUND)
