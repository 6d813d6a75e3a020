"""XML documents into the node relation: one Arrow pass with expat, no external entity is ever read.

A row of ``nodes`` is a node of a document's tree: elements, attributes, texts, comments, processing instructions and the document itself (pre
0), numbered in document order with an element's attributes right behind it. A document that is no XML gives a single row of
kind ``error`` with the message as value and the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import ClassVar
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = (
    "doc_id string, pre long, last_pre long, parent_pre long, depth int, kind string, ns string, local string, prefix string, qkey string, "
    "path_key string, sib_idx int, sib_cnt int, value string, sval string, line int, location string"
)
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODES.split(", ")])

#: Documents of a batch that are Python objects at once; rows about that a batch going out has.
SLICE, OUT_ROWS = 64, 8192

XML_NS = "http://www.w3.org/XML/1998/namespace"


class XmlError(ValueError):
    def __init__(self, message: str, line: int, column: int = 0):
        super().__init__(message)
        self.line, self.column = line, column


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    ns: str = ""
    local: str = ""
    prefix: str = ""
    value: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    attributes: list[Node] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)
    pre: int = 0
    last: int = 0
    line: int = 1
    nth: int = 1  # among its parent's elements of that name, and their number
    of: int = 1
    memo: dict | None = None  # in the tree of a form, what follows from it alone
    log: ClassVar[list | None] = None  # while what is read is noted (``plans.recall``), the texts that ``string`` came to; all values of texts are read by it

    def root(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def string(self) -> str:
        if self.kind not in ("document", "element"):
            if self.log is not None and self.kind == "text":
                self.log.append(self)
            return self.value
        if len(self.children) < 2:
            return self.children[0].string() if self.children and self.children[0].kind in ("text", "element") else ""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.kind == "text":
                out.append(n.value)
                if self.log is not None:
                    self.log.append(n)
            elif n.kind in ("document", "element"):
                stack.extend(reversed(n.children))
        return "".join(out)

    @property
    def key(self) -> str:
        return f"{{{self.ns}}}{self.local}" if self.ns else self.local

    @property
    def name(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else self.local


def location(n: Node) -> str:
    """/a/b[2]/@c, with an index only where a parent has several children of that name."""
    parts = []
    while n.parent is not None:
        if n.kind == "attribute":
            parts.append(f"@{n.name}")
        elif n.kind == "element":
            parts.append(n.name + (f"[{n.nth}]" if n.of > 1 else ""))
        else:
            parts.append({"text": "text()", "comment": "comment()", "pi": "processing-instruction()"}[n.kind])
        n = n.parent
    return "/" + "/".join(reversed(parts))


def parse(xml: str) -> Node:
    """The tree of a document; XmlError with the line where it is not well-formed."""
    doc = Node("document")
    stack, texts = [doc], []
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def flush() -> None:
        if texts:
            if len(stack) > 1:
                stack[-1].children.append(Node("text", value="".join(t for t, _ in texts), parent=stack[-1], line=texts[0][1]))
            texts.clear()

    def resolve(name: str, scope: dict[str, str], attribute: bool) -> tuple[str, str, str]:
        prefix, _, local = name.rpartition(":")
        if prefix == "xml":
            return XML_NS, local, prefix
        if not prefix:
            return ("" if attribute else scope.get("", "")), local, ""
        if prefix not in scope:
            raise XmlError(f"undeclared prefix {prefix}", parser.CurrentLineNumber, parser.CurrentColumnNumber)
        return scope[prefix], local, prefix

    def start(name: str, attrs: list[str]) -> None:
        flush()
        top, line = stack[-1], parser.CurrentLineNumber
        pairs = list(zip(attrs[::2], attrs[1::2], strict=True))
        own = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        scope = {**top.namespaces, **own} if own else top.namespaces
        n = Node("element", *resolve(name, scope, False), parent=top, namespaces=scope, line=line)
        seen = set()
        for k, v in pairs:
            if k == "xmlns" or k.startswith("xmlns:"):
                continue
            a = Node("attribute", *resolve(k, scope, True), value=v, parent=n, line=line)
            if a.key in seen:
                raise XmlError(f"duplicate attribute {k}", line, parser.CurrentColumnNumber)
            seen.add(a.key)
            n.attributes.append(a)
        top.children.append(n)
        stack.append(n)

    def end(_: str) -> None:
        flush()
        stack.pop()

    def other(kind: str, value: str, local: str = "") -> None:
        flush()
        stack[-1].children.append(Node(kind, local=local, value=value, parent=stack[-1], line=parser.CurrentLineNumber))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: texts.append((s, parser.CurrentLineNumber))
    parser.CommentHandler = lambda s: other("comment", s)
    parser.ProcessingInstructionHandler = lambda target, s: other("pi", s, target)
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise XmlError(expat.ErrorString(e.code), e.lineno, e.offset) from None
    number(doc)
    return doc


def number(doc: Node) -> None:
    """Document order and places among siblings, without recursion."""
    count, stack = 0, [(doc, False)]
    while stack:
        n, done = stack.pop()
        if done:
            n.last = count - 1
            continue
        n.pre = count
        count += 1
        for a in n.attributes:
            a.pre = a.last = count
            count += 1
        named: dict[tuple[str, str], list[Node]] = {}
        for c in n.children:
            if c.kind == "element":
                named.setdefault((c.ns, c.local), []).append(c)
        for same in named.values():
            for i, c in enumerate(same, 1):
                c.nth, c.of = i, len(same)
        stack.append((n, True))
        stack += [(c, False) for c in reversed(n.children)]


#: Nodes of the trees that a task keeps, and keys of documents it has met once.
FORM_NODES, MET_MOST = 120_000, 100_000
#: Texts with line ends that are longer come in pieces from the parser, which tell the line of another place.
PLAIN_MOST = 2000
_TAG = re.compile(r"""<([^<>"']*(?:"[^"<]*"[^<>"']*|'[^'<]*'[^<>"']*)*)>""")
_DECLARATION = re.compile(r"\ufeff?<\?xml\s[^<>]*\?>")
_REFERENCE = re.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _plain(text: str) -> str:
    return _REFERENCE.sub(lambda m: _NAMED[m[3]] if m[3] else chr(int(m[1], 16) if m[1] else int(m[2])), text) if "&" in text else text


class Forms:
    """Parses documents; those of equal tags share one tree, whose texts and lines are set for each, so it holds until the next document is parsed.

    The tree is made where a form is met again; the one not met for longest goes first. Whether a document is well-formed is told for each. Documents with comments, instructions or a document type are
    parsed alone.
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.met: set[int] = set()
        self.nodes = 0

    def parse(self, xml: str) -> Node:
        first = 0
        if "<?" in xml:
            head = _DECLARATION.match(xml)
            first = head.end() if head else 0
        if "<!" in xml or xml.find("<?", first) >= 0:
            return parse(xml)
        plain = xml.replace("\r\n", "\n").replace("\r", "\n") if "\r" in xml else xml
        parts = _TAG.split(plain)
        tags, texts = parts[1::2], parts[::2]
        key = ("<".join(tags), bytes(map(bool, texts)))
        form = self.known.pop(key, None)
        if form is None:
            return self._meet(key, xml, tags, texts)
        self.known[key] = form  # now the last one to go
        lined = "\n" in plain
        if lined and max(map(len, texts)) > PLAIN_MOST:
            return parse(xml)
        try:
            expat.ParserCreate().Parse(xml.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError:
            return parse(xml)  # which tells the first error
        doc, places, spots = form[:3]
        doc.memo["texts"] = texts
        for n, i in places:
            t = texts[i]
            n.value = _plain(t) if "&" in t else t
        if lined:
            ends = list(accumulate((t.count("\n") + g.count("\n") for t, g in zip(texts, tags)), initial=1))
            for n, i in spots:
                n.line = ends[i] + texts[i].count("\n")
            form[3] = True
        elif form[3]:
            for n, _ in spots:
                n.line = 1
            form[3] = False
        return doc

    def _meet(self, key: tuple, xml: str, tags: list[str], texts: list[str]) -> Node:
        doc = parse(xml)
        if hash(key) not in self.met:
            if len(self.met) >= MET_MOST:
                self.met.clear()
            self.met.add(hash(key))
            return doc
        nodes, stack = [], [doc]
        while stack:
            n = stack.pop()
            nodes.append(n)
            stack += reversed(n.children)
        opened = [i for i, t in enumerate(tags) if t[0] not in "/?"]
        within = [i for i in range(opened[0] + 1, len(texts) - 1) if texts[i]]
        elements, leaves = ([n for n in nodes if n.kind == k] for k in ("element", "text"))
        size = len(nodes) + sum(len(n.attributes) for n in elements)
        if size > FORM_NODES or len(opened) != len(elements) or [n.value for n in leaves] != [_plain(texts[i]) for i in within]:
            return doc
        while self.nodes + size > FORM_NODES:
            self.nodes -= self.known.pop(next(iter(self.known)))[4]
        for n in nodes:
            n.memo = {}
            for a in n.attributes:
                a.memo = {}
        places = list(zip(leaves, within))
        spots = [(x, i) for n, i in zip(elements, opened) for x in (n, *n.attributes)] + places
        doc.memo["texts"], doc.memo["places"] = texts, {id(n): i for n, i in places}
        self.known[key] = [doc, places, spots, "\n" in xml or "\r" in xml, size]
        self.nodes += size
        return doc


def decode(content: bytes) -> str:
    """Byte order mark, else the declared encoding, else UTF-8."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    declared = re.search(rb"""encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", content[:200])
    for name in (declared[1].decode() if declared else "utf-8", "utf-8"):
        try:
            return content.decode(name, "replace")
        except LookupError:
            continue
    return ""


def without_declared_encoding(xml: str) -> str:
    """The text with its declaration's encoding taken out, as the text is decoded already."""
    return re.sub(r"""^(﻿?<\?xml[^>]*?)\s+encoding\s*=\s*["'][^"']*["']""", r"\1", xml, count=1)


def rows(doc_id: str, doc: Node) -> Iterator[tuple]:
    stack = [(doc, 0, "", "", 0, 0)]
    while stack:
        n, depth, path, place, at, of = stack.pop()
        yield (doc_id, n.pre, n.last, n.parent.pre if n.parent else None, depth, n.kind, n.ns, n.local, n.prefix, n.key, path, at, of, n.value, n.string(), n.line, place or "/")
        for a in n.attributes:
            yield (doc_id, a.pre, a.pre, n.pre, depth + 1, "attribute", a.ns, a.local, a.prefix, a.key, f"{path}/@{a.key}", 1, 1, a.value, a.value, a.line, f"{place}/@{a.name}")
        totals: dict[str, int] = {}
        for c in n.children:
            totals[c.kind + c.key] = totals.get(c.kind + c.key, 0) + 1
        seen: dict[str, int] = {}
        todo = []
        for c in n.children:
            k = c.kind + c.key
            seen[k] = seen.get(k, 0) + 1
            label = c.name if c.kind == "element" else {"text": "text()", "comment": "comment()", "pi": "processing-instruction()"}[c.kind]
            index = f"[{seen[k]}]" if c.kind == "element" and totals[k] > 1 else ""
            todo.append((c, depth + 1, f"{path}/{c.key if c.kind == 'element' else label}", f"{place}/{label}{index}", seen[k], totals[k]))
        stack += reversed(todo)


#: Bytes of a batch between the JVM and a Python worker, and the setting that bounds it with Spark's own value.
BATCH_BYTES, BATCH_SETTING, BATCH_UNSET = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(docs: DataFrame) -> DataFrame:
    """docs, whose Arrow batches the session bounds by bytes from now on: else 64 MB of documents are one batch, and an executor holds a dozen of them off the heap. A session's own bound stays."""
    session = getattr(docs, "sparkSession", None)
    if session is not None and session.conf.get(BATCH_SETTING) == BATCH_UNSET:
        session.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most: a worker's memory follows these, not the thousands of documents that arrive together."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


#: Columns of rows that follow from a document's form.
_FIXED = [c for c in _COLUMNS if c not in ("doc_id", "value", "sval", "line")]


def _tree_rows(doc: Node, names: frozenset[str] | None) -> tuple[list[Node], list[pa.Array]]:
    """The nodes of a tree that have rows, and the columns of these that follow from its form."""
    kept = doc.memo.get(("rows", names))
    if kept is None:
        by_pre, stack = {}, [doc]
        while stack:
            n = stack.pop()
            by_pre[n.pre] = n
            by_pre.update((a.pre, a) for a in n.attributes)
            stack += n.children
        own = [r for r in rows("", doc) if names is None or _wanted(r, names)]
        columns = [pa.array([r[_COLUMNS.index(c)] for r in own], SCHEMA.field(c).type) for c in _FIXED]
        kept = doc.memo["rows", names] = ([by_pre[r[1]] for r in own], columns)
    return kept


def _wanted(row: tuple, names: frozenset[str]) -> bool:
    return row[4] == 1 or (row[5] in ("element", "attribute") and row[9] in names)


def shred(docs: DataFrame, names: frozenset[str] | None = None) -> DataFrame:
    """docs (doc_id, xml: string) -> nodes. Null xml gives no rows. With ``names`` only errors, what stands at the top, and elements and attributes of these keys have rows; all are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, out = Forms(), Out()
        for b in slices(batches):
            for doc_id, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if xml is None:
                    continue
                try:
                    doc = forms.parse(without_declared_encoding(xml))
                    if doc.memo is None:
                        out.add([r for r in rows(doc_id, doc) if names is None or _wanted(r, names)])
                    else:
                        out.add_tree(doc_id, *_tree_rows(doc, names))
                except XmlError as e:
                    out.add([(doc_id, 0, 0, None, 0, "error", "", "", "", "", "", 0, 0, str(e), "", e.line, "/")])
                if out.n >= OUT_ROWS:
                    yield out.batch()
        if out.n:
            yield out.batch()

    return bounded(docs).select(docs["doc_id"].cast("string").alias("doc_id"), "xml").mapInArrow(run, NODES)


class Out:
    """Rows of nodes on their way out: of documents parsed alone, and columns of trees with what each document has of its own."""

    def __init__(self):
        self.n, self.parts, self.open = 0, [], []
        self._fresh()

    def _fresh(self) -> None:
        self.fixed: list[list[pa.Array]] = [[] for _ in _FIXED]
        self.own: dict[str, list] = {c: [] for c in ("doc_id", "value", "sval", "line")}

    def _close(self) -> None:
        """Ends a run of rows of one sort, as the order of documents stays."""
        if self.open:
            self.parts.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.open, strict=True), SCHEMA, strict=True)], schema=SCHEMA))
            self.open = []
        if self.own["doc_id"]:
            fixed = dict(zip(_FIXED, map(pa.concat_arrays, self.fixed), strict=True))
            self.parts.append(pa.record_batch([fixed[c] if c in fixed else pa.array(self.own[c], SCHEMA.field(c).type) for c in _COLUMNS], schema=SCHEMA))
            self._fresh()

    def add(self, found: list[tuple]) -> None:
        if self.own["doc_id"]:
            self._close()
        self.open += found
        self.n += len(found)

    def add_tree(self, doc_id: str, nodes: list[Node], columns: list[pa.Array]) -> None:
        if self.open:
            self._close()
        for held, c in zip(self.fixed, columns, strict=True):
            held.append(c)
        self.own["doc_id"] += [doc_id] * len(nodes)
        self.own["value"] += [n.value for n in nodes]
        self.own["sval"] += [n.string() for n in nodes]
        self.own["line"] += [n.line for n in nodes]
        self.n += len(nodes)

    def batch(self) -> pa.RecordBatch:
        self._close()
        parts, self.parts, self.n = self.parts, [], 0
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
