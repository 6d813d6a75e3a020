"""Syntax, profile and summary of each document, out of the node relation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shred import Forms, Node, XmlError, bounded, slices, without_declared_encoding

#: Namespaces of the syntaxes and the roots of the supported documents.
NS = {
    "ubl": "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2",
    "cn": "urn:oasis:names:specification:ubl:schema:xsd:CreditNote-2",
    "cac": "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2",
    "cbc": "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2",
    "rsm": "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100",
    "ram": "urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100",
    "udt": "urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100",
    "qdt": "urn:un:unece:uncefact:data:standard:QualifiedDataType:100",
    "zf1": "urn:ferd:CrossIndustryDocument:invoice:1p0",
}
ROOTS = {"ubl-invoice": ("ubl", "Invoice"), "ubl-creditnote": ("cn", "CreditNote"), "cii": ("rsm", "CrossIndustryInvoice")}


def clark(path: str) -> str:
    """/cac:A/cbc:B as a path_key below the root; ``*`` steps stay."""
    def one(step: str) -> str:
        if step in ("", "*"):
            return step
        at, name = ("@", step[1:]) if step.startswith("@") else ("", step)
        prefix, _, local = name.rpartition(":")
        return at + (f"{{{NS[prefix]}}}{local}" if prefix else local)

    return "/".join(one(s) for s in path.split("/"))


#: Marks of profiles in a lower-cased specification identifier, the first that occurs decides.
PROFILES = (
    (("xrechnung", "kosit:extension"), "xrechnung-extension", "XRechnung%s Extension", True),
    (("xrechnung", ":cvd"), "xrechnung-cvd", "XRechnung%s CVD", True),
    (("xrechnung",), "xrechnung", "XRechnung%s", True),
    (("peppol",), "peppol-bis-billing-3", "Peppol BIS Billing 3.0", True),
    (("factur-x.eu:1p0:minimum",), "factur-x-minimum", "ZUGFeRD / Factur-X MINIMUM", False),
    (("zugferd.de:2p0:minimum",), "factur-x-minimum", "ZUGFeRD / Factur-X MINIMUM", False),
    (("factur-x.eu:1p0:basicwl",), "factur-x-basic-wl", "ZUGFeRD / Factur-X BASIC WL", False),
    (("zugferd.de:2p0:basicwl",), "factur-x-basic-wl", "ZUGFeRD / Factur-X BASIC WL", False),
    (("factur-x.eu:1p0:basic",), "factur-x-basic", "ZUGFeRD / Factur-X BASIC", True),
    (("zugferd.de:2p0:basic",), "factur-x-basic", "ZUGFeRD / Factur-X BASIC", True),
    (("factur-x.eu:1p0:extended",), "factur-x-extended", "ZUGFeRD / Factur-X EXTENDED", True),
    (("zugferd.de:2p0:extended",), "factur-x-extended", "ZUGFeRD / Factur-X EXTENDED", True),
)


def _chain(spec, pick, plain, nothing) -> Column:
    low = F.lower(F.coalesce(spec, F.lit("")))
    out = None
    for marks, *values in PROFILES:
        test = reduce(lambda a, b: a & b, (F.contains(low, F.lit(m)) for m in marks))
        out = (F if out is None else out).when(test, pick(values, low))
    return out.when(F.startswith(low, F.lit("urn:cen.eu:en16931:2017")), plain).otherwise(nothing)


def profile_id(spec: Column) -> Column:
    return _chain(spec, lambda v, _: F.lit(v[0]), F.lit("en16931"), F.lit("unknown"))


def profile_label(spec: Column) -> Column:
    version = lambda low: F.regexp_extract(low, r"xrechnung_([0-9]+\.[0-9]+)", 1)
    named = lambda v, low: F.format_string(v[1], F.when(version(low) != "", F.concat(F.lit(" "), version(low))).otherwise("")) if "%s" in v[1] else F.lit(v[1])
    return _chain(spec, named, F.lit("EN 16931"), F.when(F.coalesce(spec, F.lit("")) != "", "Unknown specification").otherwise("No specification identifier"))


def profile_conforms(spec: Column) -> Column:
    return _chain(spec, lambda v, _: F.lit(v[2]), F.lit(True), F.lit(True))


def profile_of(spec: Column) -> Column:
    """Short name of the family of a profile."""
    p = profile_id(spec)
    return F.when(F.startswith(p, F.lit("xrechnung")), "xrechnung").when(p == "peppol-bis-billing-3", "peppol").when(F.startswith(p, F.lit("factur-x")), F.concat(F.lit("facturx-"), F.regexp_replace(p, "^factur-x-", ""))).otherwise(p)


def _trim(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def detect(nodes: DataFrame) -> DataFrame:
    """doc_id, status (null, ``xml``, ``zugferd-1`` or ``not-an-invoice``), syntax, spec_id, profile_id, profile_label, en16931."""
    ubl = clark("/cbc:CustomizationID")
    cii = clark("/rsm:CrossIndustryInvoice/rsm:ExchangedDocumentContext/ram:GuidelineSpecifiedDocumentContextParameter/ram:ID")
    rooted = nodes.withColumn("below_root", F.regexp_replace("path_key", r"^/(\{[^}]*\})?[^/]*", ""))
    is_root = (F.col("depth") == 1) & (F.col("kind") == "element")
    per = rooted.filter(is_root | (F.col("kind") == "error") | (F.col("below_root") == ubl) | (F.col("path_key") == cii)).groupBy("doc_id").agg(
        F.max(F.when(is_root, F.col("qkey"))).alias("root"),
        F.max(F.col("kind") == "error").alias("bad"),
        F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("xml_error"),
        F.max(F.when(F.col("kind") == "error", F.col("line"))).alias("xml_error_line"),
        F.min_by(F.when(F.col("below_root") == ubl, F.col("sval")), F.when(F.col("below_root") == ubl, F.col("pre"))).alias("u"),
        F.min_by(F.when(F.col("path_key") == cii, F.col("sval")), F.when(F.col("path_key") == cii, F.col("pre"))).alias("c"),
    )
    return judged(per).select("doc_id", *DETECTION)


DETECTION = ["status", "xml_error", "xml_error_line", "syntax", "spec_id", "profile_id", "profile_label", "en16931"]


def judged(per: DataFrame) -> DataFrame:
    """Rows with root, bad, xml_error, xml_error_line and the specification identifiers u and c as written -> the rows with DETECTION."""
    syntax = reduce(lambda out, kv: (F if out is None else out).when(F.col("root") == f"{{{NS[kv[1][0]]}}}{kv[1][1]}", kv[0]), ROOTS.items(), None)
    out = per.withColumn("syntax", syntax)
    own = lambda c: F.coalesce(_trim(F.col(c)), F.lit(""))
    out = out.withColumn("spec_id", F.when(F.col("syntax") == "cii", own("c")).when(F.col("syntax").isNotNull(), own("u")))
    status = F.when(F.col("bad"), "xml").when(F.col("syntax").isNotNull() | F.col("bad").isNull(), F.lit(None)).when(F.startswith(F.col("root"), F.lit(f"{{{NS['zf1']}}}")), "zugferd-1").otherwise("not-an-invoice")
    known = lambda c: F.when(F.col("syntax").isNotNull(), c)
    s = F.col("spec_id")
    return out.withColumns({"status": status, "profile_id": known(profile_id(s)), "profile_label": known(profile_label(s)), "en16931": known(profile_conforms(s))}).drop("root", "bad", "u", "c")


_PARTY = "/*/cac:Accounting{}Party/cac:Party/"
_T = "/rsm:CrossIndustryInvoice/rsm:SupplyChainTradeTransaction/"
_AG, _ST = _T + "ram:ApplicableHeaderTradeAgreement/", _T + "ram:ApplicableHeaderTradeSettlement/"
_SUM = _ST + "ram:SpecifiedTradeSettlementHeaderMonetarySummation/"
#: Places of the summary's fields; several are tried in order, places joined by | count as one in document order.
UBL = {
    "number": "/*/cbc:ID", "type_code": "/*/cbc:InvoiceTypeCode|/*/cbc:CreditNoteTypeCode", "issue_date": "/*/cbc:IssueDate", "due_date": "/*/cbc:DueDate|/*/cac:PaymentMeans/cbc:PaymentDueDate",
    "currency": "/*/cbc:DocumentCurrencyCode", "buyer_reference": "/*/cbc:BuyerReference", "order_reference": "/*/cac:OrderReference/cbc:ID",
    "line_total": "/*/cac:LegalMonetaryTotal/cbc:LineExtensionAmount", "tax_exclusive_total": "/*/cac:LegalMonetaryTotal/cbc:TaxExclusiveAmount", "tax_inclusive_total": "/*/cac:LegalMonetaryTotal/cbc:TaxInclusiveAmount", "payable_amount": "/*/cac:LegalMonetaryTotal/cbc:PayableAmount",
} | {f"{who}_{k}": _PARTY.format(p) + v for who, p in (("seller", "Supplier"), ("buyer", "Customer")) for k, v in (("name", "cac:PartyLegalEntity/cbc:RegistrationName"), ("name2", "cac:PartyName/cbc:Name"), ("vat_id", "cac:PartyTaxScheme/cbc:CompanyID"), ("country", "cac:PostalAddress/cac:Country/cbc:IdentificationCode"))}
CII = {
    "number": "/rsm:CrossIndustryInvoice/rsm:ExchangedDocument/ram:ID", "type_code": "/rsm:CrossIndustryInvoice/rsm:ExchangedDocument/ram:TypeCode", "issue_date": "/rsm:CrossIndustryInvoice/rsm:ExchangedDocument/ram:IssueDateTime/udt:DateTimeString",
    "due_date": _ST + "ram:SpecifiedTradePaymentTerms/ram:DueDateDateTime/udt:DateTimeString", "currency": _ST + "ram:InvoiceCurrencyCode", "buyer_reference": _AG + "ram:BuyerReference", "order_reference": _AG + "ram:BuyerOrderReferencedDocument/ram:IssuerAssignedID",
    "line_total": _SUM + "ram:LineTotalAmount", "tax_exclusive_total": _SUM + "ram:TaxBasisTotalAmount", "tax_inclusive_total": _SUM + "ram:GrandTotalAmount", "payable_amount": _SUM + "ram:DuePayableAmount",
} | {f"{who}_{k}": _AG + f"ram:{p}TradeParty/" + v for who, p in (("seller", "Seller"), ("buyer", "Buyer")) for k, v in (("name", "ram:Name"), ("country", "ram:PostalTradeAddress/ram:CountryID"))}
LINES = {"ubl": ("/*/cac:InvoiceLine", "/*/cac:CreditNoteLine"), "cii": (_T + "ram:IncludedSupplyChainTradeLineItem",)}


def _place(path: str) -> Column:
    key = clark(path)
    return F.col("below_root") == key[2:] if key.startswith("/*/") else F.col("path_key") == key


def _first(paths: str, keep: Column | None = None, value: str = "sval") -> Column:
    test = reduce(lambda a, b: a | b, (_place(p) for p in paths.split("|")))
    test = test if keep is None else test & keep
    return F.nullif(_trim(F.min_by(F.when(test, F.col(value)), F.when(test, F.col("pre")))), F.lit(""))


def summarize(nodes: DataFrame) -> DataFrame:
    """One row per document: the header's facts as written, null where missing, and the number of lines.

    One pass and one shuffle on the document: each field is the first node in document order at its place.
    """
    attribute = nodes.filter("kind = 'attribute' and local in ('currencyID', 'schemeID')").groupBy("doc_id", "parent_pre").agg(F.max(F.when(F.col("local") == "currencyID", F.col("value"))).alias("currency_id"), F.max(F.when(F.col("local") == "schemeID", F.col("value"))).alias("scheme_id"))
    elements = nodes.filter("kind = 'element'").withColumn("below_root", F.regexp_replace("path_key", r"^/(\{[^}]*\})?[^/]*", ""))
    wanted = {*UBL.values(), *CII.values()}
    tax = {"ubl": "/*/cac:TaxTotal/cbc:TaxAmount", "cii": _SUM + "ram:TaxTotalAmount"}
    vat = {who: _AG + f"ram:{p}TradeParty/ram:SpecifiedTaxRegistration/ram:ID" for who, p in (("seller", "Seller"), ("buyer", "Buyer"))}
    places = [p for paths in wanted for p in paths.split("|")] + list(tax.values()) + list(vat.values()) + [p for x in LINES.values() for p in x]
    keys = sorted({clark(p) for p in places})
    named = F.col("qkey").isin(sorted({k[k.rindex("/{") + 1 :] for k in keys}))  # first, as it needs no expression over the path
    at = F.col("below_root").isin([k[2:] for k in keys if k.startswith("/*/")]) | F.col("path_key").isin([k for k in keys if not k.startswith("/*/")])
    rows = elements.filter(named & at).join(attribute.withColumnRenamed("parent_pre", "pre"), ["doc_id", "pre"], "left")
    is_line = lambda k: reduce(lambda a, b: a | b, (_place(p) for p in LINES[k]))
    aggs = [_first(v).alias(f"u_{k}") for k, v in UBL.items()] + [_first(v).alias(f"c_{k}") for k, v in CII.items()]
    aggs += [F.array_sort(F.collect_list(F.when(_place(p), F.struct("pre", "currency_id", _trim(F.col("sval")).alias("v"))))).alias(f"{k}_tax") for k, p in tax.items()]
    aggs += [_first(p, F.col("scheme_id") == "VA").alias(f"c_{who}_vat_id") for who, p in vat.items()]
    aggs += [F.count_if(is_line("ubl") | is_line("cii")).cast("int").alias("line_count")]
    per = rows.groupBy("doc_id").agg(*aggs)
    return per.select("doc_id", *_summary())


def _summary() -> list[Column]:
    """The summary's columns out of u_ and c_ fields, tax totals and the number of lines."""
    iso = lambda c: F.regexp_replace(c, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"$1-$2-$3")
    either = lambda k: F.coalesce(f"u_{k}", f"c_{k}")
    own = lambda k, currency, bare: F.try_element_at(F.filter(f"{k}_tax", lambda t: F.coalesce(t["currency_id"] == currency, F.lit(bare)) | ((t["currency_id"].isNull()) if bare else F.lit(False))), F.lit(1))["v"]
    party = lambda who: F.struct((F.coalesce(f"u_{who}_name", f"u_{who}_name2", f"c_{who}_name")).alias("name"), F.coalesce(f"u_{who}_vat_id", f"c_{who}_vat_id").alias("vat_id"), either(f"{who}_country").alias("country")).alias(who)
    flat = ["number", "type_code", "currency", "buyer_reference", "order_reference", "line_total", "tax_exclusive_total", "tax_inclusive_total", "payable_amount"]
    return [*(either(k).alias(k) for k in flat), *(F.coalesce(f"u_{k}", iso(F.col(f"c_{k}"))).alias(k) for k in ("issue_date", "due_date")), party("seller"), party("buyer"), F.nullif(F.coalesce(own("ubl", F.col("u_currency"), False), own("cii", F.col("c_currency"), True)), F.lit("")).alias("tax_total"), F.col("line_count")]


#: What the tree of a document gives for detection and summary.
_TEXTS = ["u", "c", *(f"u_{k}" for k in UBL), *(f"c_{k}" for k in CII), "c_seller_vat_id", "c_buyer_vat_id"]
_TAX = {"ubl_tax": "/*/cac:TaxTotal/cbc:TaxAmount", "cii_tax": _SUM + "ram:TaxTotalAmount"}
_ITEM = "array<struct<pre:long,currency_id:string,v:string>>"
FACTS = ", ".join(["root string, bad boolean, xml_error string, xml_error_line int, summed boolean, line_count int", *(f"{c} string" for c in _TEXTS), *(f"{c} {_ITEM}" for c in _TAX)])
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), _ITEM: pa.list_(pa.struct([("pre", pa.int64()), ("currency_id", pa.string()), ("v", pa.string())]))}
#: Places of the specification identifiers of UBL and CII among the facts.
_SPEC = [[c.split()[0] for c in FACTS.split(", ")].index(c) for c in ("u", "c")]
_FACTS = [(c.split()[0], _ARROW[c.split(" ", 1)[1]]) for c in FACTS.split(", ")]


def _spots(doc: Node) -> tuple:
    """The root's key, whether there is anything to sum up, the number of lines, and the nodes that texts and tax totals come from: they follow from the form of a tree."""
    below: dict[str, list[Node]] = {}
    whole: dict[str, list[Node]] = {}
    stack = [(c, f"/{c.key}", "") for c in doc.children if c.kind == "element"]
    root = stack[0][0].key
    while stack:
        n, path, under = stack.pop()
        whole.setdefault(path, []).append(n)
        below.setdefault(under, []).append(n)
        stack += [(c, f"{path}/{c.key}", f"{under}/{c.key}") for c in reversed(n.children) if c.kind == "element"]
    at = lambda p: (lambda key: below.get(key[2:], []) if key.startswith("/*/") else whole.get(key, []))(clark(p))
    every = lambda paths: sorted((n for p in paths.split("|") for n in at(p)), key=lambda n: n.pre)
    named = lambda n, local: max((a.value for a in n.attributes if a.local == local), default=None)
    found = {"u": at("/*/cbc:CustomizationID"), "c": at("/rsm:CrossIndustryInvoice/rsm:ExchangedDocumentContext/ram:GuidelineSpecifiedDocumentContextParameter/ram:ID")}
    fields = {f"u_{k}": every(v) for k, v in UBL.items()} | {f"c_{k}": every(v) for k, v in CII.items()}
    vat = {f"c_{who}_vat_id": at(_AG + f"ram:{p}TradeParty/ram:SpecifiedTaxRegistration/ram:ID") for who, p in (("seller", "Seller"), ("buyer", "Buyer"))}
    tax = {k: at(p) for k, p in _TAX.items()}
    lines = sum(len(at(p)) for paths in LINES.values() for p in paths)
    some = bool(lines or any(fields.values()) or any(vat.values()) or any(tax.values()))
    found |= fields | {k: [n for n in v if named(n, "schemeID") == "VA"] for k, v in vat.items()}
    return root, some, lines, [next(iter(found[c]), None) for c in _TEXTS], [[(n.pre, named(n, "currencyID"), n) for n in tax[c]] for c in _TAX]


def profile(spec: str) -> tuple[str, bool]:
    """Id of a specification identifier's profile, and whether EN 16931 holds for it, as ``profile_id`` and ``profile_conforms`` say of a column."""
    low = spec.lower()
    for marks, name, _, conforms in PROFILES:
        if all(m in low for m in marks):
            return name, conforms
    return ("en16931" if low.startswith("urn:cen.eu:en16931:2017") else "unknown"), True


_SYNTAX = {f"{{{NS[prefix]}}}{local}": syntax for syntax, (prefix, local) in ROOTS.items()}


def with_facts(docs: DataFrame, rules: tuple[Callable, Callable, T.DataType, Callable] | None = None, keep_xml: bool = True) -> DataFrame:
    """docs with DETECTION, and ``summary`` of those that are invoices: each document is parsed once and stays the row it is.

    rules: what makes a function of a tree and ids of rule sets that gives findings, the ids that a syntax and a specification identifier ask for, and the type and the Arrow array of
    a column ``fired`` of lists of findings. The same tree is checked, and ``rule_sets`` tells what by. Without keep_xml the texts end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        check = rules and rules[0]()
        for b in slices(batches):
            out, names, fired = [], [], []
            for xml in b.column("xml").to_pylist():
                names.append(None)
                fired.append([])
                if xml is None:
                    out.append((None,) * len(_FACTS))
                    continue
                try:
                    doc = forms.parse(without_declared_encoding(xml))
                except XmlError as e:
                    out.append((None, True, str(e), e.line, False, 0) + (None,) * (len(_FACTS) - 6))
                    continue
                memo = {} if doc.memo is None else doc.memo
                if _spots not in memo:
                    memo[_spots] = _spots(doc)
                root, some, lines, texts, taxes = memo[_spots]
                out.append((root, False, None, None, some, lines, *(n and n.string() for n in texts), *([{"pre": p, "currency_id": c, "v": n.string()} for p, c, n in t] for t in taxes)))
                syntax = _SYNTAX.get(root)
                if check and syntax:
                    names[-1] = rules[1](syntax, out[-1][_SPEC[syntax == "cii"]] or "")
                    fired[-1] = check(doc, names[-1])
            held = {c: b.column(c) for c in b.schema.names if keep_xml or c != "xml"}
            held |= {c: pa.array(v, k) for v, (c, k) in zip(zip(*out, strict=True), _FACTS, strict=True)}
            if check:
                held |= {"rule_sets": pa.array(names, pa.list_(pa.string())), "fired": rules[3](fired)}
            yield pa.record_batch([*held.values()], names=[*held])

    fields = [f for f in docs.schema.fields if keep_xml or f.name != "xml"] + T._parse_datatype_string(FACTS).fields
    if rules:
        fields += [T.StructField("rule_sets", T.ArrayType(T.StringType())), T.StructField("fired", rules[2])]
    rows = judged(bounded(docs).mapInArrow(run, T.StructType(fields)))
    clean = {c: F.nullif(_trim(F.col(c)), F.lit("")) for c in _TEXTS if c not in ("u", "c")}
    trimmed = lambda x: F.struct(x["pre"].alias("pre"), x["currency_id"].alias("currency_id"), _trim(x["v"]).alias("v"))
    clean |= {c: F.transform(F.col(c), trimmed) for c in _TAX}
    summary = F.when(F.col("syntax").isNotNull() & F.col("summed"), F.struct(*_summary()))
    return rows.withColumns(clean).withColumn("summary", summary).drop("summed", "line_count", *clean)
