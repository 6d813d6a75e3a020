import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from invoices import NS, RULES, pdf, ubl

from billprism.api import Options, RulesetError, report, validate
from billprism.functions import xp
from billprism.plans.schema import Checker, Schema
from billprism.plans.schematron import Ruleset
from billprism.plans.xpath import Day, XPathError, select, text_of
from billprism.sources import documents
from billprism.sources.shred import XmlError, decode, location, parse, shred

DOC = parse('<r xmlns:p="u"><a n="1"><b>1.10</b><b>2.20</b></a><a n="2"><b>3</b></a><p:c>x</p:c></r>')


@pytest.mark.parametrize(
    "expr, expected",
    [
        ("sum(//b/xs:decimal(.))", ["6.3"]), ("round(-2.5)", ["-2"]), ("//a[1]/b[2]", ["2.20"]), ("//a/b[1]", ["1.10", "3"]), ("count(//a//b)", ["3"]), ("//b = '3'", ["true"]), ("//p:c/text()", ["x"]),
        ("some $x in //b satisfies $x > 2", ["true"]), ("every $x in () satisfies false()", ["true"]), ("1 div 3", ["0." + "3" * 24]), ("-7 mod 3", ["-1"]), ("7 idiv 2", ["3"]), ("matches('abc','^a.c$')", ["true"]), ("matches('a\n','a$')", ["false"]),
        ("replace('2024','(\\d)(\\d)','$2$1')", ["0242"]), ("substring('12345',1.5,2.6)", ["234"]), ("tokenize('a,,b',',')", ["a", "", "b"]), ("distinct-values((1,1.0,2))", ["1", "2"]), ("//a[@n='2']/preceding-sibling::a/@n", ["1"]),
        ("(1 to 5)[. > 3]", ["4", "5"]), ("translate('abc','ab','x')", ["xc"]), ("normalize-space('  a  b ')", ["a b"]), ("//a/(b|@n)", ["1", "1.10", "2.20", "2", "3"]), ("//b except //a[1]/b", ["3"]), ("//b[1] << //b[2]", ["true"]),
        ("'2024-02-30' castable as xs:date", ["false"]), ("xs:decimal('1e3') castable as xs:decimal", None), ("substring-after('abc','x')", [""]), ("1 = ('a')", None), ("for $x in 1 to 2, $y in 1 to 2 return $x * $y", ["1", "2", "2", "4"]),
        ("xs:decimal('123456789012345678901234') + 1", ["123456789012345678901235"]), ("string-join(//a/@n, '|')", ["1|2"]), ("if (//zz) then 1 else 2", ["2"]), ("//b[last()]", ["2.20", "3"]), ("../x", []), ("round-half-to-even(2.5)", ["2"]),
    ],
)
def test_xpath(expr, expected):
    if expected is None:
        with pytest.raises(XPathError):
            select(expr, DOC, {"p": "u"})
    else:
        assert [text_of(x) for x in select(expr, DOC, {"p": "u"})] == expected


def test_xpath_compares_days_without_zone():
    assert select("xs:date('2024-01-02Z') = xs:date('2024-01-02+05:00')", DOC) == [True]
    assert isinstance(select("xs:dateTime('2024-01-02T03:04:05')", DOC)[0], Day)


def test_parser_errors_and_locations():
    with pytest.raises(XmlError) as e:
        parse("<a>\n<b></a>")
    assert e.value.line == 2
    for bad in ("<x:a/>", "", "no xml", '<a xmlns:p="u" xmlns:q="u" p:k="1" q:k="2"/>'):
        with pytest.raises(XmlError):
            parse(bad)
    doc = parse("<a><!-- c --><b/><b k='1'><![CDATA[<]]>x</b></a>")
    b = doc.children[0].children[2]
    assert location(b) == "/a/b[2]" and location(b.attributes[0]) == "/a/b[2]/@k" and b.string() == "<x"
    assert decode("<a>ü</a>".encode("utf-16")) == "<a>ü</a>" and decode('<?xml version="1.0" encoding="latin-1"?><a>ü</a>'.encode("latin-1")).endswith("ü</a>")


def test_nodes_follow_the_tree(spark):
    docs = spark.createDataFrame([("1", ubl()), ("2", "<a"), ("3", None)], "doc_id string, xml string")
    rows = shred(docs).collect()
    assert {r["doc_id"] for r in rows} == {"1", "2"}
    assert [r["kind"] for r in rows if r["doc_id"] == "2"] == ["error"]
    own = sorted((r for r in rows if r["doc_id"] == "1"), key=lambda r: r["pre"])
    assert [r["pre"] for r in own] == list(range(len(own)))
    by_pre = {r["pre"]: r for r in own}
    assert all(by_pre[r["parent_pre"]]["last_pre"] >= r["last_pre"] for r in own if r["parent_pre"] is not None)
    assert [r["location"] for r in own if r["local"] == "InvoiceLine"] == ["/Invoice/cac:InvoiceLine[1]", "/Invoice/cac:InvoiceLine[2]"]


@pytest.fixture(scope="module")
def found(spark):
    rules = [Ruleset.from_text(RULES, "en16931-ubl")]
    inputs = [
        ("good", ubl()), ("wrong sum", ubl(total="31.00")), ("no xml", "not xml"), ("other", "<Order/>"), ("leitweg", ubl(reference="04011000-12345-34")), ("minimum", ubl(spec="urn:factur-x.eu:1p0:minimum")),
        ("unknown", ubl(spec="urn:x")), ("bad value", ubl(lines=("10.00", "x"))),
    ]
    rows = [(i, n, x.encode()) for i, (n, x) in enumerate(inputs)] + [(8, "pdf", pdf(ubl())), (9, "pdf level", pdf(ubl(), level="BASIC")), (10, "pdf empty", b"%PDF-1.7"), (11, "null", None)]
    docs = documents.from_rows(spark.createDataFrame(rows, "input_idx long, name string, content binary"))
    result = validate(docs, rules)
    return result, {r["name"]: r.asDict(True) for r in result.results.collect()}


def ids(row, kind="errors"):
    return [m["rule_id"] for m in row[kind]]


def test_validate(found):
    _, rows = found
    assert len(rows) == 12 and rows["good"]["valid"] and ids(rows["good"], "warnings") == ["T-FIRST"]
    assert ids(rows["wrong sum"]) == ["T-SUM"] and rows["wrong sum"]["errors"][0]["message"] == "Sum is 30, not 31.00" and rows["wrong sum"]["errors"][0]["location"] == "/Invoice/cac:LegalMonetaryTotal"
    assert ids(rows["no xml"]) == ["SUM-XML"] and ids(rows["other"]) == ["SUM-FORMAT"] and rows["other"]["syntax"] is None
    assert ids(rows["leitweg"], "warnings") == ["T-FIRST", "SUM-LEITWEG"] and rows["leitweg"]["valid"]
    assert ids(rows["minimum"]) == ["SUM-PROFILE"] and ids(rows["unknown"], "warnings") == ["SUM-PROFILE", "T-FIRST"]
    assert rows["pdf"]["valid"] and rows["pdf"]["attachment"] == "factur-x.xml" and ids(rows["pdf level"], "warnings") == ["T-FIRST", "SUM-PDF-LEVEL"]
    assert ids(rows["pdf empty"]) == ["SUM-PDF"] and ids(rows["null"]) == ["SUM-BATCH"] and not rows["null"]["valid"]


def test_errors_in_tests_fire_with_their_cause(found):
    _, rows = found
    fired = {m["rule_id"]: m["evaluation_error"] for m in rows["bad value"]["errors"] + rows["bad value"]["infos"]}
    # a let that fails is empty, so T-SUM fires as any comparison with nothing; tests that fail themselves say why
    assert fired["T-SUM"] is None and fired["T-ERR"].startswith("FORG0001") and fired["T-LINE"].startswith("FORG0001")
    assert not rows["bad value"]["valid"]


def test_summary(found):
    _, rows = found
    s = rows["good"]["summary"]
    assert (s["number"], s["issue_date"], s["currency"], s["line_total"], s["tax_total"], s["line_count"]) == ("A-1", "2024-05-06", "EUR", "30.00", "5.70", 2)
    assert s["seller"]["name"] == "Büro & Söhne" and s["due_date"] is None and rows["good"]["spec_id"] == "urn:cen.eu:en16931:2017"


def test_report_and_rule_set_choice(found, spark):
    result, _ = found
    text = {r["input_idx"]: r["text"] for r in report(result).collect()}
    assert text[0].startswith("good: valid (EN 16931)") and "error   SUM-XML" in text[2]
    with pytest.raises(RulesetError):
        validate(result.docs, [], Options(rule_sets=["none"]))


def test_schema():
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" elementFormDefault="qualified"><xs:element name="r" type="T"/>
    <xs:complexType name="T"><xs:annotation/><xs:sequence><xs:element name="a" type="xs:date"/><xs:element name="b" type="C" minOccurs="0" maxOccurs="2"/><xs:element name="c" type="Ch" minOccurs="0"/></xs:sequence><xs:attribute name="k" type="xs:int" use="required"/><xs:attribute name="f" fixed="1"/></xs:complexType>
    <xs:simpleType name="C"><xs:restriction base="xs:string"><xs:enumeration value="x"/><xs:enumeration value="y"/></xs:restriction></xs:simpleType>
    <xs:complexType name="Ch"><xs:choice><xs:element name="d" type="xs:decimal"/><xs:element name="e" type="xs:string"/></xs:choice></xs:complexType></xs:schema>"""
    checker = Checker(Schema.from_texts({"s.xsd": xsd}, "s.xsd"))
    kinds = lambda x: [k for k, _, _ in checker.run(parse(x))]
    assert kinds("<r k='1'><a>2024-01-02</a><b>x</b></r>") == []
    assert kinds("<r k='z' f='2' q=''><a>2.1.24</a></r>") == ["attribute-value", "attribute-value", "unknown-attribute", "value"]
    assert kinds("<r><b>x</b><a>2024-01-02</a></r>") == ["missing-attribute", "element-order"]
    assert kinds("<r k='1'><b>x</b></r>") == ["missing-element"] and kinds("<r k='1'><a>2024-01-02</a><z/></r>") == ["unexpected-element"]
    assert kinds("<r k='1'><a>2024-01-02</a><b>x</b><b>y</b><b>q</b></r>") == ["too-many", "value"]
    assert kinds("<r k='1'><a>2024-01-02</a><c><d>1</d></c></r>") == [] and kinds("<r k='1'><a>2024-01-02</a><c><d>1</d><e/></c></r>") == ["content"]
    assert kinds("<q/>") == ["unexpected-element"] and kinds("<r k='1'>t<a>2024-01-02</a></r>") == ["content"]


def test_column_functions(spark):
    row = spark.createDataFrame([("  a \n b ", "12.345", "2024-2-3", "04011000-12345-03", "DE89 3704 0044 0532 0130 00", None)], "s string, d string, t string, l string, i string, n string").select(
        xp.nspace("s").alias("s"), xp.decimal("d", 20, 6).alias("d"), xp.decimal(F.lit("1e3")).alias("e"), xp.date("t").alias("t"), xp.leitweg_ok("l").alias("l"), xp.iban_ok("i").alias("i"), xp.nspace("n").alias("n"),
        xp.round_half_up(F.lit(-2.5).cast("decimal(4,1)")).cast("int").alias("r"), xp.substring_after("s", "zz").alias("z"), xp.tokenize("n", ",").alias("k"), xp.two_decimals("d").alias("two"), F.isnan(xp.number("s")).alias("nan"), xp.matches(F.lit("a\n"), "a$").alias("m"),
        xp.any_pair(F.array(F.lit(1)), F.array().cast("array<int>"), lambda a, b: a == b).alias("p"), xp.leitweg_check_digits(F.lit("04011000"), F.lit("12345")).alias("c"),
    ).first()
    assert (row["s"], row["d"], row["e"], row["t"], row["l"], row["i"], row["n"], row["r"], row["z"], row["k"], row["two"], row["nan"], row["m"], row["p"]) == ("a b", Decimal("12.345"), None, None, row["c"] == "03", True, "", -2, "", [], False, True, False, False)


def test_missing_paths_cost_no_other(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ubl(), "utf-8")
    rows = {r["input_idx"]: r for r in documents.from_list(spark, [str(tmp_path / "a.xml"), str(tmp_path / "none.xml"), str(tmp_path), str(tmp_path / "a.xml")]).collect()}
    assert [rows[i]["read_error"] is None for i in range(4)] == [True, False, False, True] and rows[0]["xml"] == rows[3]["xml"]


def test_stream(spark, tmp_path):
    from billprism.streaming.validation import start, stream_files

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.xml").write_text(ubl(total="30.00" if i else "1.00"), "utf-8")
    q = start(stream_files(spark, str(tmp_path / "in"), 2), [Ruleset.from_text(RULES, "en16931-ubl")], str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    q.awaitTermination(120)
    assert sorted(r["valid"] for r in spark.read.parquet(str(tmp_path / "out/results")).collect()) == [False, True, True]


STRUCTURE = """<schema xmlns="http://purl.oclc.org/dsdl/schematron"><ns prefix="cac" uri="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"/><ns prefix="cbc" uri="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"/>
<ns prefix="ubl" uri="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"/>
<pattern><rule context="/ubl:Invoice"><assert id="F1" flag="warning" test="not(cac:TaxTotal/cbc:TaxAmount)">no tax</assert><assert id="R1" test="cbc:DueDate">due</assert><assert id="R2" test="exists(cbc:ID)">id</assert>
<assert id="C1" test="count(cac:InvoiceLine) &lt;= 1">one line</assert><assert id="C2" test="count(cac:InvoiceLine) >= 2">two lines</assert><assert id="X1" test="cbc:ID = 'B'">own</assert></rule>
<rule context="cac:InvoiceLine"><assert id="F2" test="not(cbc:LineExtensionAmount/@currencyID)">no currency</assert><assert id="V1" test="not(cbc:ID)">has <value-of select="cbc:ID"/></assert></rule>
<rule context="cac:InvoiceLine"><assert id="N1" test="cbc:Nothing">never owns</assert></rule>
<rule context="cbc:TaxAmount[@currencyID = 'USD']"><assert id="P1" test="not(@currencyID)">usd</assert></rule><rule context="cac:TaxTotal/cbc:TaxAmount"><assert id="P2" test="not(@currencyID)">any</assert></rule></pattern></schema>"""


def test_structural_plan_equals_per_document_evaluation(spark):
    from billprism.plans.schematron import check
    from billprism.plans.structural import findings, split

    rules = Ruleset.from_text(STRUCTURE, "s")
    shapes, rest = split(rules)
    assert {s.rule_id for s in shapes} == {"F1", "R1", "R2", "C1", "C2", "F2"}
    docs = spark.createDataFrame([("1", ubl()), ("2", ubl(lines=("1.00",))), ("3", ubl(lines=())), ("4", "<a")], "doc_id string, xml string")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "pattern_ord", "node_pre", "rule_id", "flag", "message", "location", "line").collect()))
    both = key(findings(shred(docs), shapes)) + key(check(docs, [rest]))
    assert sorted(both) == key(check(docs, [rules]))


def test_validation_is_the_same_with_and_without_joins(spark):
    rules = [Ruleset.from_text(STRUCTURE, "en16931-ubl"), Ruleset.from_text(RULES, "own-ubl")]
    docs = documents.from_rows(spark.createDataFrame([(0, "a", ubl()), (1, "b", ubl(lines=("1.00",), total="1.00")), (2, "c", "<a")], "input_idx long, name string, content string"))
    plain, joined = (sorted(map(str, validate(docs, rules, Options(["en16931-ubl", "own"], structural=s, keep_nodes=s)).findings.collect())) for s in (False, True))
    assert plain == joined and any("own-ubl" in x for x in plain) and any("R1" in x for x in plain)


def test_paths_and_catalog(spark):
    from billprism.plans import paths

    ns = {"cac": "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2", "cbc": "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2", "u": "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"}
    docs = spark.createDataFrame([("1", ubl()), ("2", ubl(lines=("1.00",))), ("3", "<a")], "doc_id string, xml string")
    nodes = shred(docs).cache()
    for expr in ("//cac:InvoiceLine/cbc:ID", "/u:Invoice/cbc:ID", "//cbc:LineExtensionAmount/@currencyID", "//cac:InvoiceLine[2]", "//cac:TaxTotal/cbc:TaxAmount[1]"):
        assert paths.is_plain(expr)
        want = sorted((r["doc_id"], r["location"], r["value"]) for r in paths.select_path(docs, expr, ns).collect())
        assert want and sorted((r["doc_id"], r["location"], r["sval"]) for r in paths.on_nodes(nodes, expr, ns).collect()) == want
    rows = paths.select_path(docs, "sum(//cac:InvoiceLine/xs:decimal(cbc:LineExtensionAmount))", ns).collect()
    assert sorted((r["doc_id"], r["value"]) for r in rows) == [("1", "30"), ("2", "1")]
    assert {r["error"] for r in paths.select_path(docs, "1 idiv 0").collect()} == {"FOAR0001"}
    catalog = paths.rule_catalog(spark, [Ruleset.from_text(STRUCTURE, "s"), Ruleset.from_text(RULES, "r")])
    info = {r["rule_set"]: r.asDict() for r in paths.rule_set_info(catalog).collect()}
    assert info["s"] == {"rule_set": "s", "assertions": 11, "fatal": 10, "warning": 1, "information": 0, "joins": 6} and info["r"]["information"] == 1


def test_core_rules(spark):
    from billprism.plans.core_rules import RULES as CORE

    assert len({x[0] for x in CORE}) == len(CORE) > 130
    party = "<cac:Party><cac:PostalAddress><cac:Country><cbc:IdentificationCode>DE</cbc:IdentificationCode></cac:Country></cac:PostalAddress><cac:PartyTaxScheme><cbc:CompanyID>DE1</cbc:CompanyID><cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme></cac:PartyTaxScheme><cac:PartyLegalEntity><cbc:RegistrationName>N</cbc:RegistrationName></cac:PartyLegalEntity></cac:Party>"
    rate = lambda tag: f"<cac:{tag}><cbc:ID>S</cbc:ID><cbc:Percent>19</cbc:Percent><cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme></cac:{tag}>"
    xml = f"""<Invoice {NS}><cbc:CustomizationID>urn:cen.eu:en16931:2017</cbc:CustomizationID><cbc:ID>1</cbc:ID><cbc:IssueDate>2024-01-02</cbc:IssueDate><cbc:DueDate>2024-02-02</cbc:DueDate><cbc:InvoiceTypeCode>380</cbc:InvoiceTypeCode><cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode>
    <cac:AccountingSupplierParty>{party}</cac:AccountingSupplierParty><cac:AccountingCustomerParty>{party}</cac:AccountingCustomerParty>
    <cac:TaxTotal><cbc:TaxAmount currencyID="EUR">19.00</cbc:TaxAmount><cac:TaxSubtotal><cbc:TaxableAmount>100.00</cbc:TaxableAmount><cbc:TaxAmount>19.00</cbc:TaxAmount>{rate("TaxCategory")}</cac:TaxSubtotal></cac:TaxTotal>
    <cac:LegalMonetaryTotal><cbc:LineExtensionAmount>100.00</cbc:LineExtensionAmount><cbc:TaxExclusiveAmount>100.00</cbc:TaxExclusiveAmount><cbc:TaxInclusiveAmount>119.00</cbc:TaxInclusiveAmount><cbc:PayableAmount>119.00</cbc:PayableAmount></cac:LegalMonetaryTotal>
    <cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity unitCode="C62">1</cbc:InvoicedQuantity><cbc:LineExtensionAmount>100.00</cbc:LineExtensionAmount><cac:Item><cbc:Name>x</cbc:Name>{rate("ClassifiedTaxCategory")}</cac:Item><cac:Price><cbc:PriceAmount>100.00</cbc:PriceAmount></cac:Price></cac:InvoiceLine></Invoice>"""
    cases = {
        "good": (xml, set()), "due": (xml.replace("PayableAmount>119.00", "PayableAmount>120.00"), {"BR-CO-16"}), "country": (xml.replace("<cbc:IdentificationCode>DE</cbc:IdentificationCode>", "", 1), {"BR-09"}), "decimals": (xml.replace("TaxableAmount>100.00", "TaxableAmount>100.001"), {"BR-DEC-19"}),
        "rate": (xml.replace("<cbc:Percent>19</cbc:Percent><cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme></cac:ClassifiedTaxCategory>", "<cbc:Percent>0</cbc:Percent><cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme></cac:ClassifiedTaxCategory>"), {"BR-S-05", "BR-S-08"}), "sum": (xml.replace("LineExtensionAmount>100.00", "LineExtensionAmount>99.00", 1), {"BR-CO-10", "BR-CO-13"}),
    }
    docs = documents.from_rows(spark.createDataFrame([(i, n, x) for i, (n, (x, _)) in enumerate(cases.items())], "input_idx long, name string, content string"))
    got = {r["name"]: set(ids(r.asDict(True))) for r in validate(docs).results.collect()}
    assert got == {n: want for n, (_, want) in cases.items()}


def test_shredding_holds_few_rows_at_once():
    """3,000 documents that arrive together go out in batches of bounded length, so a worker's memory does not follow the batch."""
    import tracemalloc

    import pyarrow as pa

    from billprism.sources.shred import shred

    class Plan:
        def __getitem__(self, _):
            return self

        def select(self, *_):
            return self

        cast = alias = select

        def mapInArrow(self, run, _):
            return run

    texts = ["<a>" + "".join(f"<b c='{j}'>{i} {j}</b>" for j in range(30)) + "</a>" for i in range(3000)]
    batch = pa.record_batch({"doc_id": [str(i) for i in range(3000)], "xml": texts})
    tracemalloc.start()
    sizes = [x.num_rows for x in shred(Plan())(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 3000 * 92 and max(sizes) < 10_000 and peak < 20e6


def test_own_messages_read_the_state_once(spark):
    """The engine's messages come out of one pass over the state of documents, whose plan parses again wherever it is read: 15 passes in Arrow, 35 with a reading for each message."""
    from billprism.api import Options, validate
    from billprism.sources.documents import from_rows

    rows = spark.createDataFrame([("a", 0, "<a/>"), ("b", 1, "<b")], "doc_id string, input_idx long, content string").withColumn("name", F.col("doc_id"))
    found = validate(from_rows(rows), [], Options(keep_nodes=False)).findings
    assert sorted(r["rule_id"] for r in found.collect()) == ["SUM-FORMAT", "SUM-XML"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 20


def test_summary_cuts_a_path_once(spark):
    """The places of the summary are told by sets: the path below the root is cut once a node, not once for each place."""
    from billprism.plans.detect import summarize
    from billprism.sources.shred import NODES

    plan = summarize(spark.createDataFrame([], NODES))._jdf.queryExecution().optimizedPlan().toString()
    assert max(x.count("regexp_replace(path_key") for x in plan.splitlines() if "Filter" in x) <= 2


def test_forms_share_trees_and_change_no_node():
    """Documents of equal tags share one tree; nodes, values, lines and errors are those of a document that is parsed alone."""
    from billprism.sources.shred import Forms, Out, _tree_rows, rows, without_declared_encoding

    odd = ["", "x", "<>", "<a/>", "<a>]]></a>", "<a>u&</a>", "<p:a/>", "<a b='1' b='2'/>", "<a><!-- c --></a>", "<a><?p i?></a>", "<a><![CDATA[x]]></a>", "<a>&nope;</a>", "<a", "<a>" + "l\n" * 3000 + "</a>", "<a>\n</a>\n", "\n<a>t</a>x"]
    texts = [ubl(lines=(a, b), number=c).replace("\n", end) for a in ("1.00", "a\nb", "", "&lt;&#65;") for b in ("x", " ") for c in ("A", "q&amp;r", "]] > '") for end in ("\n", "\r\n", "\r", " ")]
    forms, shared = Forms(), 0
    for xml in [without_declared_encoding(x) for x in (odd + texts) * 3]:
        try:
            want = list(rows("d", parse(xml)))
        except XmlError as e:
            with pytest.raises(XmlError) as got:
                forms.parse(xml)
            assert (str(got.value), got.value.line) == (str(e), e.line)
            continue
        doc = forms.parse(xml)
        assert list(rows("d", doc)) == want
        if doc.memo is not None:
            out = Out()
            out.add_tree("d", *_tree_rows(doc, None))
            assert [tuple(r.values()) for r in out.batch().to_pylist()] == want
            shared += 1
    assert shared > 200 and len(forms.known) < 20


def test_rules_on_shared_trees_are_those_of_documents_alone():
    """What is kept with a tree follows from its form: findings are the same whatever document of the form came before."""
    from billprism.api import builtin
    from billprism.plans.schematron import Runner, evaluator

    rules = [*builtin(), Ruleset.from_text(RULES, "own"), Ruleset.from_text(STRUCTURE, "s")]
    texts = [ubl(lines=a, number=c, total=t, spec=s).replace("9.99", x) for a in (("1.00",), ("1.00", "2.00"), ("x", "1.001")) for c in ("A", " ") for t in ("3.00", "1.001") for s in ("urn:x", " ") for x in ("9.99", "9.999")]
    evaluate = evaluator(rules)
    for xml in texts * 3:
        want = [(r.id, i, *f) for i, r in enumerate(rules) for f in Runner(r).run(parse(xml.replace(' encoding="UTF-8"', "")))]
        assert evaluate(xml, None) == want


def test_validation_joins_nothing(spark):
    """A document stays one row from its text to its result: it is parsed twice, and no join or shuffle stands between."""
    rows = spark.createDataFrame([("a", 0, ubl()), ("b", 1, "<b")], "doc_id string, input_idx long, content string").withColumn("name", F.col("doc_id"))
    found = validate(documents.from_rows(rows), None, Options(keep_nodes=False))
    for df in (found.findings, found.results):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 3 and "Join" not in plan and "Exchange" not in plan


def test_shredding_gives_the_rows_that_are_asked_for(spark):
    """Rows of the names that shapes ask for are numbered as among all; findings are the same."""
    from billprism.plans.structural import findings, names, split

    shapes, _ = split(Ruleset.from_text(STRUCTURE, "s"))
    docs = spark.createDataFrame([("1", ubl()), ("2", ubl(lines=("1.00",))), ("3", ubl()), ("4", ubl()), ("5", "<a")], "doc_id string, xml string").coalesce(1)
    every, some = shred(docs), shred(docs, names(shapes))
    assert some.count() < every.count() / 3 and set(some.collect()) <= set(every.collect())
    assert sorted(findings(some, shapes).collect()) == sorted(findings(every, shapes).collect())


def test_batches_of_documents_are_bounded_by_bytes(spark):
    from billprism.sources.shred import BATCH_BYTES, BATCH_SETTING, BATCH_UNSET, bounded

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("xml"))
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, BATCH_UNSET)
        assert max(r["n"] for r in bounded(docs).mapInArrow(count, "n long").collect()) <= BATCH_BYTES // 10_000 + 1
        spark.conf.set(BATCH_SETTING, "1048576")  # a session's own bound stays
        bounded(docs)
        assert spark.conf.get(BATCH_SETTING).rstrip("b") == "1048576"
        spark.conf.set(BATCH_SETTING, BATCH_UNSET)
        documents.from_rows(spark.createDataFrame([("a", ubl())], "name string, content string"))
        assert spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_BYTES)
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_what_was_read_tells_findings_again():
    """On trees of a form an assertion is evaluated again only where a text that it read is another one; also by a task's copy of the function, batch by batch."""
    from billprism.plans.schematron import Runner, evaluator

    rules = Ruleset.from_text(RULES, "own")
    asked, evaluate = [], evaluator([rules])
    evaluate.runners[0].eval, inner = (lambda text, focus: asked.append(text) or inner(text, focus)), evaluate.runners[0].eval
    texts = [ubl(lines=("10.00", x), number=n) for x in ("20.00", "x", "20.00") for n in ("A", "B", "C")]
    for xml in texts:
        asked.clear()
        want = [("own", 0, *f) for f in Runner(rules).run(parse(xml.replace(' encoding="UTF-8"', "")))]
        assert evaluate(xml, None) == want
    assert not asked  # the number of an invoice is read by no rule


def test_a_document_is_parsed_once_for_detection_and_rules(spark):
    """Detection, summary and rules are one pass, so a task has two Python workers (three before), and texts do not come back from it unless they are asked for."""
    rows = spark.createDataFrame([("a", 0, ubl()), ("b", 1, ubl(lines=("10.00", "x"))), ("c", 2, ubl())], "doc_id string, input_idx long, content string").withColumn("name", F.col("doc_id"))
    found = validate(documents.from_rows(rows.coalesce(1)), [Ruleset.from_text(RULES, "en16931-ubl")], Options(keep_nodes=False))
    plan = found.findings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2
    assert sorted((r["doc_id"], r["rule_id"]) for r in found.findings.collect()) == [("a", "T-FIRST"), ("b", "T-ERR"), ("b", "T-FIRST"), ("b", "T-LINE"), ("b", "T-SUM"), ("c", "T-FIRST")]
