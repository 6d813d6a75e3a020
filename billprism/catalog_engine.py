"""Registered queries of validation, rule sets, sources and schemas: orders as complete invoices with known faults, beside the findings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import HEADERS, LINES, invoices_xml, lines, query, table
from .functions import xp
from .plans.detect import NS

_UBL = f'xmlns="{NS["ubl"]}" xmlns:cac="{NS["cac"]}" xmlns:cbc="{NS["cbc"]}"'

# ---------------------------------------------------------------- complete invoices

#: Faults by the divisors of an order's key.
FAULTS = {"due": 13, "country": 17, "decimals": 19, "inclusive": 23, "name": 29, "tax": 31, "type": 37, "unit": 41, "taxable": 43, "reference": 47}
_SPECS = ("urn:cen.eu:en16931:2017", "urn:cen.eu:en16931:2017#compliant#urn:factur-x.eu:1p0:extended", "", "urn:example:own")


def _has(fault: str):
    return F.col("doc_id") % FAULTS[fault] == 0


def _money(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%d.%02d", F.floor(c / 100).cast("long"), (c % 100).cast("long"))


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, category, rate, taxable and tax in cents: what an order's lines come to."""
    per = lines(spark, sf_dir).groupBy("doc_id", "category", "rate").agg(F.sum("net").alias("taxable"))
    return per.withColumn("tax", F.floor((F.col("taxable") * F.col("rate") + 50) / 100).cast("long"))


def full_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): orders as invoices that keep all built-in core rules, but for the FAULTS of their key."""
    vat = "<cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme>"
    part = F.format_string(f'<cac:TaxSubtotal><cbc:TaxableAmount currencyID="EUR">%s</cbc:TaxableAmount><cbc:TaxAmount currencyID="EUR">%s</cbc:TaxAmount><cac:TaxCategory><cbc:ID>%s</cbc:ID><cbc:Percent>%d</cbc:Percent>{vat}</cac:TaxCategory></cac:TaxSubtotal>', _money(F.col("taxable") + F.when(_has("taxable") & (F.col("k") == 1), 500).otherwise(0)), _money("tax"), "category", "rate")
    from pyspark.sql import Window

    rates = breakdown(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("rate")))
    taxes = rates.groupBy("doc_id").agg(F.sum("taxable").alias("net"), F.sum("tax").alias("tax"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rate", part.alias("x")))), lambda s: s["x"]), "").alias("subtotals"))
    first = F.col("line_no") == 1
    line = F.format_string(
        f'<cac:InvoiceLine><cbc:ID>%d</cbc:ID><cbc:InvoicedQuantity%s>1</cbc:InvoicedQuantity><cbc:LineExtensionAmount currencyID="EUR">%s</cbc:LineExtensionAmount><cac:Item><cbc:Name>%s</cbc:Name><cac:ClassifiedTaxCategory><cbc:ID>%s</cbc:ID><cbc:Percent>%d</cbc:Percent>{vat}</cac:ClassifiedTaxCategory></cac:Item><cac:Price><cbc:PriceAmount currencyID="EUR">%s</cbc:PriceAmount></cac:Price></cac:InvoiceLine>',
        "line_no", F.when(_has("unit") & first, "").otherwise(' unitCode="C62"'), _money("net"), F.when(_has("name") & first, " ").otherwise(F.concat(F.lit("part "), F.col("item").cast("string"))), "category", "rate", _money("net"),
    )
    body = lines(spark, sf_dir).select("doc_id", line.alias("x")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("body"))
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("doc_id") % len(_SPECS) + 1).cast("int"))
    party = lambda who, name, country: f"<cac:Accounting{who}Party><cac:Party><cac:PostalAddress><cac:Country><cbc:IdentificationCode>{country}</cbc:IdentificationCode></cac:Country></cac:PostalAddress><cac:PartyTaxScheme><cbc:CompanyID>DE123456789</cbc:CompanyID>{vat}</cac:PartyTaxScheme><cac:PartyLegalEntity><cbc:RegistrationName>{name}</cbc:RegistrationName></cac:PartyLegalEntity></cac:Party></cac:Accounting{who}Party>"
    tax = F.col("tax") + F.when(_has("tax"), 1).otherwise(0)
    gross = F.col("net") + tax + F.when(_has("inclusive"), 1).otherwise(0)
    whole = F.format_string(
        f"<Invoice {_UBL}><cbc:CustomizationID>%s</cbc:CustomizationID><cbc:ID>%d</cbc:ID><cbc:IssueDate>2024-01-15</cbc:IssueDate>%s<cbc:InvoiceTypeCode>%s</cbc:InvoiceTypeCode><cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode><cbc:BuyerReference>%s</cbc:BuyerReference>"
        + party("Supplier", "Seller", "%s") + party("Customer", "Buyer", "FR")
        + '<cac:TaxTotal><cbc:TaxAmount currencyID="EUR">%s</cbc:TaxAmount>%s</cac:TaxTotal><cac:LegalMonetaryTotal><cbc:LineExtensionAmount currencyID="EUR">%s</cbc:LineExtensionAmount><cbc:TaxExclusiveAmount currencyID="EUR">%s</cbc:TaxExclusiveAmount><cbc:TaxInclusiveAmount currencyID="EUR">%s</cbc:TaxInclusiveAmount><cbc:PayableAmount currencyID="EUR">%s</cbc:PayableAmount></cac:LegalMonetaryTotal>%s</Invoice>',
        spec, "doc_id", F.when(_has("due"), "").otherwise("<cbc:DueDate>2024-02-15</cbc:DueDate>"), F.when(_has("type"), "999").otherwise("380"), F.when(_has("reference"), "04011000-12345-04").otherwise("04011000-12345-03"),
        F.when(_has("country"), "").otherwise("DE"), _money(tax), "subtotals", _money("net"), _money("net"), _money(gross), F.concat(_money(gross), F.when(_has("decimals"), "0").otherwise("")), "body",
    )
    return taxes.join(body, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), whole.alias("xml"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, as the tables are small for what is done to a document."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "doc_id")


def as_docs(rows: DataFrame, content: str = "xml") -> DataFrame:
    """Rows (doc_id, xml) as the sources make docs."""
    from .sources.documents import from_rows

    return from_rows(spread(rows).withColumn("input_idx", F.col("doc_id").cast("long")), "doc_id", content)


#: What the faults make rules find: (doc_id, rule_id, severity). EXTENDED invoices have warnings for errors.
_FOUND = f"""WITH {LINES}, ids AS (SELECT doc_id, doc_id % 4 AS spec, any_value(CASE WHEN doc_id % 43 = 0 THEN r END) AS r, bool_or(line_no = 1) AS has_first, count(*) FILTER (WHERE line_no = 1) AS firsts
 FROM l JOIN (SELECT doc_id, min(rate) AS r FROM l GROUP BY doc_id) USING (doc_id) GROUP BY doc_id),
f AS (SELECT doc_id, spec, 'BR-CO-25' AS rule_id, 1 AS n FROM ids WHERE doc_id % 13 = 0
 UNION ALL SELECT doc_id, spec, 'BR-09', 1 FROM ids WHERE doc_id % 17 = 0
 UNION ALL SELECT doc_id, spec, 'BR-DEC-18', 1 FROM ids WHERE doc_id % 19 = 0
 UNION ALL SELECT doc_id, spec, 'BR-CO-15', 1 FROM ids WHERE doc_id % 23 = 0
 UNION ALL SELECT doc_id, spec, 'BR-25', firsts FROM ids WHERE doc_id % 29 = 0 AND has_first
 UNION ALL SELECT doc_id, spec, 'BR-CO-14', 1 FROM ids WHERE doc_id % 31 = 0
 UNION ALL SELECT doc_id, spec, 'BR-CL-01', 1 FROM ids WHERE doc_id % 37 = 0
 UNION ALL SELECT doc_id, spec, 'BR-23', firsts FROM ids WHERE doc_id % 41 = 0 AND has_first
 UNION ALL SELECT doc_id, spec, CASE WHEN r = 0 THEN 'BR-Z-08' ELSE 'BR-S-08' END, 1 FROM ids WHERE doc_id % 43 = 0
 UNION ALL SELECT doc_id, spec, 'BR-01', 1 FROM ids WHERE spec = 2),
a AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, rule_id, CASE WHEN spec = 1 THEN 'warning' ELSE 'error' END AS severity, n FROM f
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'SUM-LEITWEG', 'warning', 1 FROM ids WHERE doc_id % 47 = 0
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'SUM-EXTENDED', 'info', 1 FROM ids WHERE spec = 1
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'SUM-PROFILE', 'warning', 1 FROM ids WHERE spec > 1)"""


@query(_FOUND + " SELECT doc_id, rule_id, severity, CAST(n AS BIGINT) AS n FROM a")
def validate_findings_e2e(spark, sf_dir):
    """All findings of the built-in core rules and the engine's own messages on complete invoices."""
    from .api import validate

    found = validate(as_docs(full_invoices(spark, sf_dir)))
    return found.findings.groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(_FOUND + """ SELECT CAST(ids.doc_id AS VARCHAR) AS doc_id, coalesce(e, 0) = 0 AS valid, CASE spec WHEN 0 THEN 'en16931' WHEN 1 THEN 'factur-x-extended' ELSE 'unknown' END AS profile_id, CAST(coalesce(e, 0) AS INTEGER) AS errors, CAST(coalesce(w, 0) AS INTEGER) AS warnings, CAST(coalesce(i, 0) AS INTEGER) AS infos
FROM ids LEFT JOIN (SELECT doc_id, sum(n) FILTER (WHERE severity = 'error') AS e, sum(n) FILTER (WHERE severity = 'warning') AS w, sum(n) FILTER (WHERE severity = 'info') AS i FROM a GROUP BY 1) c ON c.doc_id = CAST(ids.doc_id AS VARCHAR)""")
def validate_results_e2e(spark, sf_dir):
    """One result per document: validity, profile, messages by severity."""
    from .api import validate

    found = validate(as_docs(full_invoices(spark, sf_dir)))
    return found.results.select("doc_id", "valid", "profile_id", *(F.size(c).alias(c) for c in ("errors", "warnings", "infos")))


# ---------------------------------------------------------------- sources


def _bytes(xml, kind):
    """An invoice as the bytes of a file: UTF-8 plain, with a mark, declared Latin-1, or UTF-16 with a mark."""
    marked = lambda mark, name: F.concat(F.unhex(F.lit(mark)), F.encode(xml, name))
    latin = F.encode(F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'), xml), "ISO-8859-1")
    return F.when(kind == 0, F.encode(xml, "UTF-8")).when(kind == 1, marked("EFBBBF", "UTF-8")).when(kind == 2, latin).when(kind == 3, marked("FFFE", "UTF-16LE")).otherwise(marked("FEFF", "UTF-16BE"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'xml' AS source_type, 'Büro ' || o_orderkey AS value FROM orders")
def xml_decode_e2e(spark, sf_dir):
    """Files in five encodings, told by mark or declaration, come out as the same text."""
    from .plans.paths import evaluate
    from .sources.documents import from_rows

    key = F.col("o_orderkey")
    xml = F.format_string("<a>Büro %d</a>", key)
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), key.alias("input_idx"), key.cast("string").alias("name"), _bytes(xml, key % 5).alias("content"))
    docs = from_rows(rows)
    return docs.select("doc_id", "source_type").join(evaluate(docs, {"a": "string(/a)"}).select("doc_id", "value"), "doc_id")


def _pdf(xml, name, level, key):
    """The bytes of a small PDF with an embedded file and metadata; its stream is plain, hexadecimal or of an unknown filter."""
    how = key % 4
    stream = F.when(how == 1, F.concat(F.hex(F.encode(xml, "UTF-8")), F.lit(">"))).otherwise(xml)
    filter_ = F.when(how == 1, " /Filter /ASCIIHexDecode").when(how == 2, " /Filter [/Strange]").otherwise("")
    meta = F.format_string("<x fx:ConformanceLevel='%s'/>", level)
    return F.encode(F.format_string("%%PDF-1.7\n1 0 obj\n<< /Type /EmbeddedFile /Subtype /text#2Fxml%s /Length %d >>\nstream\n%s\nendstream\nendobj\n2 0 obj\n<< /Type /Filespec /F (%s) /UF (%s) /EF << /F 1 0 R >> >>\nendobj\n3 0 obj\n<< /Type /Metadata /Subtype /XML /Length %d >>\nstream\n%s\nendstream\nendobj\n%%%%EOF", filter_, F.octet_length(stream), stream, name, name, F.octet_length(meta), meta), "UTF-8")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'pdf' AS source_type, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CASE o_orderkey % 3 WHEN 0 THEN 'factur-x.xml' ELSE 'other.xml' END END AS attachment,
CASE o_orderkey % 2 WHEN 0 THEN 'EN 16931' ELSE 'BASIC' END AS pdf_level, CASE o_orderkey % 4 WHEN 2 THEN 'no embedded invoice XML; filter Strange is not supported' WHEN 3 THEN 'no embedded invoice XML' END AS pdf_error,
CASE WHEN o_orderkey % 4 IN (0, 1) THEN '<Invoice>' || o_orderkey || '</Invoice>' END AS xml FROM orders""")
def pdf_extract_e2e(spark, sf_dir):
    """The invoice embedded in a PDF, its name and declared level; filters that are not known and files without an invoice are told."""
    from .sources.documents import from_rows

    key = F.col("o_orderkey")
    root = F.when(key % 4 == 3, "Other").otherwise("Invoice")
    xml = F.format_string("<%s>%d</%s>", root, key, root)
    content = _pdf(xml, F.when(key % 3 == 0, "factur-x.xml").otherwise("other.xml"), F.when(key % 2 == 0, "EN 16931").otherwise("BASIC"), key)
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), key.alias("input_idx"), key.cast("string").alias("name"), content.alias("content"))
    return from_rows(rows).select("doc_id", "source_type", "attachment", "pdf_level", "pdf_error", "xml")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'SUM-XML' WHEN 1 THEN 'SUM-FORMAT' WHEN 2 THEN 'SUM-FORMAT' WHEN 3 THEN 'SUM-PROFILE' WHEN 4 THEN 'SUM-PDF' ELSE 'SUM-BATCH' END AS rule_id, 'error' AS severity, CASE o_orderkey % 6 WHEN 0 THEN 2 END AS line FROM orders""")
def early_stop_e2e(spark, sf_dir):
    """What stops a validation early: no XML, no invoice, the older format, a profile below EN 16931, a PDF without an invoice, a file without content."""
    from .api import Options, validate
    from .sources.documents import from_rows

    key = F.col("o_orderkey")
    minimum = "urn:factur-x.eu:1p0:minimum"
    xml = F.when(key % 6 == 0, F.format_string("<a>%d\n</b>", key)).when(key % 6 == 1, F.format_string("<a>%d</a>", key)).when(key % 6 == 2, F.format_string('<x:CrossIndustryDocument xmlns:x="%s">%d</x:CrossIndustryDocument>', F.lit(NS["zf1"] + ":1p0"), key))
    xml = xml.when(key % 6 == 3, F.format_string(f"<Invoice {_UBL}><cbc:CustomizationID>{minimum}</cbc:CustomizationID><cbc:ID>%d</cbc:ID></Invoice>", key)).when(key % 6 == 4, F.lit("%PDF-1.7 nothing"))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), key.alias("input_idx"), key.cast("string").alias("name"), F.encode(xml, "UTF-8").alias("content"))
    return validate(from_rows(rows), options=Options(keep_nodes=False)).findings.select("doc_id", "rule_id", "severity", "line")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SUM-PDF-LEVEL' END AS rule_id FROM orders""")
def pdf_level_e2e(spark, sf_dir):
    """A PDF's declared level against the profile of the invoice in it."""
    from .api import Options, validate
    from .sources.documents import from_rows

    key = F.col("o_orderkey")
    xml = F.format_string(f"<Invoice {_UBL}><cbc:CustomizationID>urn:cen.eu:en16931:2017</cbc:CustomizationID><cbc:ID>%d</cbc:ID></Invoice>", key)
    content = _pdf(xml, F.lit("factur-x.xml"), F.when(key % 3 == 0, "BASIC").when(key % 3 == 1, "EN 16931").otherwise("COMFORT"), F.lit(0))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), key.alias("input_idx"), key.cast("string").alias("name"), content.alias("content"))
    found = validate(from_rows(spread(rows)), [], Options(keep_nodes=False))
    return found.results.select("doc_id", F.element_at(F.transform(F.array_append(F.filter("warnings", lambda m: m["rule_id"] == "SUM-PDF-LEVEL")["rule_id"], F.lit(None)), lambda x: x), 1).alias("rule_id"))


# ---------------------------------------------------------------- rule sets

FEATURES = """<schema xmlns="http://purl.oclc.org/dsdl/schematron" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:f="urn:own">
<ns prefix="ubl" uri="%(ubl)s"/><ns prefix="cac" uri="%(cac)s"/><ns prefix="cbc" uri="%(cbc)s"/><ns prefix="f" uri="urn:own"/>
<let name="twice" value="$lines * 2"/><let name="lines" value="count(//cac:InvoiceLine)"/>
<xsl:function name="f:cents"><xsl:param name="x"/><xsl:sequence select="xs:integer(xs:decimal($x) * 100)"/></xsl:function>
<pattern><let name="third" value="(//cac:InvoiceLine)[3]/cbc:ID"/>
 <rule context="cac:InvoiceLine[cbc:ID = '1']"><assert id="FIRST" flag="warn" test="false()">first of <value-of select="$lines"/></assert></rule>
 <rule context="cac:InvoiceLine | cac:LegalMonetaryTotal"><let name="own" value="f:cents(cbc:LineExtensionAmount)"/>
  <assert id="BIG" role="info" test="$own &lt; 5000000"><name/> of <value-of select="$own"/></assert>
  <report id="EVEN" flag="strange" test="cbc:ID = '2'">second</report></rule>
 <rule context="cac:InvoiceLine"><assert id="NEVER" test="false()">owned by the rule before</assert></rule></pattern>
<pattern><rule context="/*"><assert id="TWICE" test="$twice &lt;= 8">twice</assert><assert id="THIRD" test="not($third) or $third = '3'">third</assert>
 <assert id="GIVEN" flag="warning" test="$lines &lt;= $most">given</assert><assert id="OWN" test="f:odd($lines)">own</assert><assert id="BROKEN" test="xs:decimal('x') = 1">broken</assert></rule></pattern></schema>""" % NS  # noqa: UP031

_M = "printf('%d', {0})"


@query(f"""WITH {HEADERS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, printf('%d.%02d', net // 100, net % 100)) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
f AS (SELECT doc_id, 'FIRST' AS rule_id, 'warning' AS flag, 'first of ' || n AS message, CASE WHEN n > 1 THEN '/Invoice/cac:InvoiceLine[' || pos || ']' ELSE '/Invoice/cac:InvoiceLine' END AS location, '' AS error FROM o WHERE line_no = 1
UNION ALL SELECT doc_id, 'BIG', 'information', 'cac:InvoiceLine of ' || net, CASE WHEN n > 1 THEN '/Invoice/cac:InvoiceLine[' || pos || ']' ELSE '/Invoice/cac:InvoiceLine' END, '' FROM o WHERE line_no <> 1 AND net >= 5000000
UNION ALL SELECT doc_id, 'BIG', 'information', 'cac:LegalMonetaryTotal of ' || line_total, '/Invoice/cac:LegalMonetaryTotal', '' FROM h WHERE line_total >= 5000000
UNION ALL SELECT doc_id, 'EVEN', 'fatal', 'second', CASE WHEN n > 1 THEN '/Invoice/cac:InvoiceLine[' || pos || ']' ELSE '/Invoice/cac:InvoiceLine' END, '' FROM o WHERE line_no = 2
UNION ALL SELECT doc_id, 'TWICE', 'fatal', 'twice', '/Invoice', '' FROM h WHERE n_lines > 4
UNION ALL SELECT doc_id, 'THIRD', 'fatal', 'third', '/Invoice', '' FROM o WHERE pos = 3 AND line_no <> 3
UNION ALL SELECT doc_id, 'GIVEN', 'warning', 'given', '/Invoice', '' FROM h WHERE n_lines > 5
UNION ALL SELECT doc_id, 'OWN', 'fatal', 'own', '/Invoice', '' FROM h WHERE n_lines % 2 = 0
UNION ALL SELECT doc_id, 'BROKEN', 'fatal', 'broken', '/Invoice', 'FORG0001' FROM h)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, rule_id, flag, message, location, error FROM f""")
def schematron_features_e2e(spark, sf_dir):
    """Lets of schema, pattern and rule in any order, functions of the rule set and of the caller, variables, united contexts, first match, reports, flags, messages and evaluation errors."""
    from .plans.schematron import Ruleset, check

    rules = Ruleset.from_text(FEATURES, "features")
    found = check(invoices_xml(spark, sf_dir), [rules], functions={("{urn:own}odd", 1): lambda focus, a: [a[0] % 2 == 1]}, variables={"most": [5]})
    return found.select("doc_id", "rule_id", "flag", "message", "location", F.coalesce(F.regexp_extract("evaluation_error", "[A-Z]{4}[0-9]{4}", 0), F.lit("")).alias("error"))


@query("""SELECT * FROM (VALUES ('features', 'FIRST', 'warning', 'document'), ('features', 'BIG', 'information', 'document'), ('features', 'EVEN', 'fatal', 'document'), ('features', 'NEVER', 'fatal', 'document'), ('features', 'TWICE', 'fatal', 'document'),
('features', 'THIRD', 'fatal', 'document'), ('features', 'GIVEN', 'warning', 'document'), ('features', 'OWN', 'fatal', 'document'), ('features', 'BROKEN', 'fatal', 'document'), ('orders', 'LINES', 'warning', 'join'), ('orders', 'DUE', 'fatal', 'join'), ('orders', 'SUM', 'fatal', 'document')) t(rule_set, id, flag, shape)""")
def rule_catalog_list(spark, sf_dir):
    """Every assertion of two rule sets: flag, and whether it runs as a join."""
    from .catalog import RULES
    from .plans.paths import rule_catalog
    from .plans.schematron import Ruleset

    return rule_catalog(spark, [Ruleset.from_text(FEATURES, "features"), Ruleset.from_text(RULES, "orders")]).select("rule_set", "id", "flag", "shape")


@query("SELECT * FROM (VALUES ('features', 9, 6, 2, 1, 0), ('orders', 3, 2, 1, 0, 2)) t(rule_set, assertions, fatal, warning, information, joins)")
def rule_set_counts(spark, sf_dir):
    """Assertions of each rule set by flag."""
    from .catalog import RULES
    from .plans.paths import rule_catalog, rule_set_info
    from .plans.schematron import Ruleset

    return rule_set_info(rule_catalog(spark, [Ruleset.from_text(FEATURES, "features"), Ruleset.from_text(RULES, "orders")])).select("rule_set", *(F.col(c).cast("int").alias(c) for c in ("assertions", "fatal", "warning", "information", "joins")))


@query("""SELECT * FROM (VALUES ('en16931', 'en16931-ubl', 'en16931-cii'), ('en16931,xrechnung', 'en16931-ubl,xrechnung-ubl', 'en16931-cii,xrechnung-cii'), ('xrechnung@2.5.0', 'xrechnung-ubl@2.5.0', 'xrechnung-cii@2.5.0'), ('own', 'own', 'own'), ('nothing', 'SUM-RULESET', 'SUM-RULESET')) t(asked, ubl, cii)""")
def rule_set_selection(spark, sf_dir):
    """The rule sets that names, families and versions stand for, by syntax."""
    from .api import RulesetError, chosen

    have = ["en16931-ubl", "en16931-cii", "xrechnung-ubl", "xrechnung-cii", "xrechnung-ubl@2.5.0", "xrechnung-cii@2.5.0", "own"]
    rows = []
    for asked in ("en16931", "en16931,xrechnung", "xrechnung@2.5.0", "own", "nothing"):
        try:
            got = chosen(asked.split(","), have)
            rows.append((asked, ",".join(got["ubl"]), ",".join(got["cii"])))
        except RulesetError:
            rows.append((asked, "SUM-RULESET", "SUM-RULESET"))
    return spark.createDataFrame(rows, "asked string, ubl string, cii string")


@query("SELECT * FROM (VALUES ('SUM-XML', 'error'), ('SUM-FORMAT', 'error'), ('SUM-PDF', 'error'), ('SUM-XSD', 'error'), ('SUM-PROFILE', 'error or warning'), ('SUM-EXTENDED', 'info'), ('SUM-LEITWEG', 'warning'), ('SUM-PDF-LEVEL', 'warning'), ('SUM-RULESET', 'error'), ('SUM-BATCH', 'error')) t(code, severity)")
def message_codes(spark, sf_dir):
    """The codes of the engine's own messages."""
    from .api import CODES

    return spark.createDataFrame(list(CODES.items()), "code string, severity string")


@query(f"WITH {HEADERS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(line_no AS VARCHAR) AS value FROM l")
def path_on_nodes(spark, sf_dir):
    """A plain path over all documents at once: one filter on the node relation."""
    from .plans.paths import on_nodes
    from .sources.shred import shred

    return on_nodes(shred(invoices_xml(spark, sf_dir)), "//cac:InvoiceLine/cbc:ID", NS).select("doc_id", F.col("sval").alias("value"))


@query(f"WITH {HEADERS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS item, 'element' AS kind, CAST(ids[i] AS VARCHAR) AS value, CASE WHEN n > 1 THEN '/Invoice/cac:InvoiceLine[' || i || ']/cbc:ID' ELSE '/Invoice/cac:InvoiceLine/cbc:ID' END AS location FROM (SELECT doc_id, list(line_no ORDER BY line_no) AS ids, count(*) AS n, unnest(range(1, count(*) + 1)) AS i FROM l GROUP BY doc_id)")
def select_path_e2e(spark, sf_dir):
    """An ad-hoc expression over all documents: a row for each item, in its order, with its place."""
    from .plans.paths import select_path

    return select_path(invoices_xml(spark, sf_dir), "/ubl:Invoice/cac:InvoiceLine/cbc:ID", NS).select("doc_id", "item", "kind", "value", "location")


# ---------------------------------------------------------------- columns


@query("""SELECT c_custkey, contains(c_name, '9') AS has, starts_with(c_name, 'Customer#00') AS starts, ends_with(c_name, '7') AS ends, 'c' || c_custkey || '/' || c_nationkey AS joined, regexp_full_match(c_name, '[A-Za-z_:].*') AS name, regexp_full_match(right(c_name, 1), '[02468]') AS even,
CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE substr(c_name, CAST(1 + c_nationkey % 3 AS INTEGER), 2) END AS part, CASE WHEN c_name < 'Customer#000000500' THEN -1 WHEN c_name > 'Customer#000000500' THEN 1 ELSE 0 END AS against FROM customer""")
def fn_strings(spark, sf_dir):
    """Tests of strings, name classes, subtracted classes, substring by columns and NaN, comparison by code points."""
    name, k = F.col("c_name"), F.col("c_nationkey") % 3
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.contains(xp.text(name), F.lit("9")).alias("has"), F.startswith(xp.text(name), F.lit("Customer#00")).alias("starts"), F.endswith(xp.text(name), F.lit("7")).alias("ends"), F.concat(F.lit("c"), xp.text("c_custkey"), F.lit("/"), xp.text("c_nationkey")).alias("joined"),
        xp.matches(name, r"^\i.*$").alias("name"), xp.matches(F.substring(name, -1, 1), "^[0-9-[13579]]$").alias("even"), xp.substring(name, F.when(k == 0, float("nan")).otherwise(k + 1.0), F.lit(2.0)).alias("part"), xp.compare(name, F.lit("Customer#000000500")).alias("against"),
    )


@query("""SELECT l_orderkey, list_aggregate(list_transform(list_reverse(q), lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS back, coalesce(list_aggregate(list_transform(q[2:3], lambda x: CAST(x AS VARCHAR)), 'string_agg', ','), '') AS part,
coalesce(list_aggregate(list_transform(list_filter(range(1, len(q) + 1), lambda i: q[i] = 1), lambda i: CAST(i AS VARCHAR)), 'string_agg', ','), '') AS at, q[1] AS first, list_max(r) > list_min(a) AS some_pair FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS q,
coalesce(list(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R'), [-1]) AS r, coalesce(list(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A'), [1000]) AS a FROM lineitem GROUP BY 1)""")
def fn_sequences(spark, sf_dir):
    """reverse, subsequence, index-of, the first item and the general comparison of two sequences."""
    flag = lambda f: F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("long")))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("q"), flag("R").alias("r"), flag("A").alias("a"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return per.select("l_orderkey", text(F.reverse("q")).alias("back"), text(xp.subsequence(F.col("q"), 2, 2)).alias("part"), text(xp.index_of(F.col("q"), 1)).alias("at"), xp.first(F.col("q")).alias("first"), xp.any_pair(F.col("r"), F.col("a"), lambda x, y: x > y).alias("some_pair"))


@query("""SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(12,2))) AS abs, CAST(floor(c_acctbal) AS BIGINT) AS down, CAST(ceil(c_acctbal) AS BIGINT) AS up, c_custkey % 3 = 1 AS whole FROM customer""")
def fn_numbers(spark, sf_dir):
    """abs, floor and ceiling of exact decimals, and strict lexical forms of integers."""
    amount = xp.decimal(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), 12, 2)
    form = F.when(F.col("c_custkey") % 3 == 0, "1.0").when(F.col("c_custkey") % 3 == 1, " +12 ").otherwise("12a")
    return table(spark, sf_dir, "customer").select("c_custkey", F.abs(amount).alias("abs"), F.floor(amount).cast("long").alias("down"), F.ceil(amount).cast("long").alias("up"), xp.castable(form, "integer").alias("whole"))


# ---------------------------------------------------------------- rules for both syntaxes

_CII = f'xmlns:rsm="{NS["rsm"]}" xmlns:ram="{NS["ram"]}" xmlns:udt="{NS["udt"]}"'


def cii_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): orders as CII invoices with the same faults, but for the reference's."""
    from pyspark.sql import Window

    rates = breakdown(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("rate")))
    part = F.format_string("<ram:ApplicableTradeTax><ram:CalculatedAmount>%s</ram:CalculatedAmount><ram:TypeCode>VAT</ram:TypeCode><ram:BasisAmount>%s</ram:BasisAmount><ram:CategoryCode>%s</ram:CategoryCode><ram:RateApplicablePercent>%d</ram:RateApplicablePercent></ram:ApplicableTradeTax>", _money("tax"), _money(F.col("taxable") + F.when(_has("taxable") & (F.col("k") == 1), 500).otherwise(0)), "category", "rate")
    taxes = rates.groupBy("doc_id").agg(F.sum("taxable").alias("net"), F.sum("tax").alias("tax"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rate", part.alias("x")))), lambda s: s["x"]), "").alias("subtotals"))
    first = F.col("line_no") == 1
    line = F.format_string(
        "<ram:IncludedSupplyChainTradeLineItem><ram:AssociatedDocumentLineDocument><ram:LineID>%d</ram:LineID></ram:AssociatedDocumentLineDocument><ram:SpecifiedTradeProduct><ram:Name>%s</ram:Name></ram:SpecifiedTradeProduct><ram:SpecifiedLineTradeAgreement><ram:NetPriceProductTradePrice><ram:ChargeAmount>%s</ram:ChargeAmount></ram:NetPriceProductTradePrice></ram:SpecifiedLineTradeAgreement><ram:SpecifiedLineTradeDelivery><ram:BilledQuantity%s>1</ram:BilledQuantity></ram:SpecifiedLineTradeDelivery><ram:SpecifiedLineTradeSettlement><ram:ApplicableTradeTax><ram:TypeCode>VAT</ram:TypeCode><ram:CategoryCode>%s</ram:CategoryCode><ram:RateApplicablePercent>%d</ram:RateApplicablePercent></ram:ApplicableTradeTax><ram:SpecifiedTradeSettlementLineMonetarySummation><ram:LineTotalAmount>%s</ram:LineTotalAmount></ram:SpecifiedTradeSettlementLineMonetarySummation></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem>",
        "line_no", F.when(_has("name") & first, " ").otherwise(F.concat(F.lit("part "), F.col("item").cast("string"))), _money("net"), F.when(_has("unit") & first, "").otherwise(' unitCode="C62"'), "category", "rate", _money("net"),
    )
    body = lines(spark, sf_dir).select("doc_id", line.alias("x")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("body"))
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("doc_id") % len(_SPECS) + 1).cast("int"))
    party = lambda who, country: f'<ram:{who}TradeParty><ram:Name>{who}</ram:Name><ram:PostalTradeAddress><ram:CountryID>{country}</ram:CountryID></ram:PostalTradeAddress><ram:SpecifiedTaxRegistration><ram:ID schemeID="VA">DE123456789</ram:ID></ram:SpecifiedTaxRegistration></ram:{who}TradeParty>'
    tax = F.col("tax") + F.when(_has("tax"), 1).otherwise(0)
    gross = F.col("net") + tax + F.when(_has("inclusive"), 1).otherwise(0)
    whole = F.format_string(
        f'<rsm:CrossIndustryInvoice {_CII}><rsm:ExchangedDocumentContext><ram:GuidelineSpecifiedDocumentContextParameter><ram:ID>%s</ram:ID></ram:GuidelineSpecifiedDocumentContextParameter></rsm:ExchangedDocumentContext><rsm:ExchangedDocument><ram:ID>%d</ram:ID><ram:TypeCode>%s</ram:TypeCode><ram:IssueDateTime><udt:DateTimeString format="102">20240115</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction>%s<ram:ApplicableHeaderTradeAgreement>'
        + party("Seller", "%s") + party("Buyer", "FR")
        + '</ram:ApplicableHeaderTradeAgreement><ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR</ram:InvoiceCurrencyCode>%s%s<ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:LineTotalAmount>%s</ram:LineTotalAmount><ram:TaxBasisTotalAmount>%s</ram:TaxBasisTotalAmount><ram:TaxTotalAmount currencyID="EUR">%s</ram:TaxTotalAmount><ram:GrandTotalAmount>%s</ram:GrandTotalAmount><ram:DuePayableAmount>%s</ram:DuePayableAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>',
        spec, "doc_id", F.when(_has("type"), "999").otherwise("380"), "body", F.when(_has("country"), "").otherwise("DE"), "subtotals",
        F.when(_has("due"), "").otherwise('<ram:SpecifiedTradePaymentTerms><ram:DueDateDateTime><udt:DateTimeString format="102">20240215</udt:DateTimeString></ram:DueDateDateTime></ram:SpecifiedTradePaymentTerms>'),
        _money("net"), _money("net"), _money(tax), _money(gross), F.concat(_money(gross), F.when(_has("decimals"), "0").otherwise("")),
    )
    return taxes.join(body, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), whole.alias("xml"))


@query(_FOUND + " SELECT doc_id, rule_id, severity, CAST(n AS BIGINT) AS n FROM a WHERE rule_id <> 'SUM-LEITWEG'")
def validate_cii_e2e(spark, sf_dir):
    """The same faults in the other syntax: the core rules on CII invoices."""
    from .api import validate

    found = validate(as_docs(cii_invoices(spark, sf_dir)))
    return found.findings.groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


def _fold_iban(k: str) -> str:
    return f"list_reduce(list_transform(string_split(lpad({k}::VARCHAR, 18, '0') || '1314' || lpad(({k} % 97)::VARCHAR, 2, '0'), ''), lambda d: d::INTEGER), lambda r, d: (r * 10 + d) % 97, 0)"


_NATIONAL = f"""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, rule_id, flag FROM customer, (VALUES ('BR-DE-15', 'fatal', 7), ('BR-DE-17', 'warning', 11), ('BR-DE-27', 'warning', 13), ('BR-DE-28', 'warning', 17), ('BR-DE-18', 'fatal', 19), ('BR-DE-3', 'fatal', 23), ('BR-DE-25', 'fatal', 29), ('BR-DE-22', 'fatal', 31)) r(rule_id, flag, m) WHERE c_custkey % m = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'BR-DE-19', 'warning' FROM customer WHERE c_custkey % 29 <> 0 AND {_fold_iban('c_custkey')} <> 1"""


def _national(syntax: str):
    def run(spark, sf_dir):
        from .plans import structural
        from .plans.national_rules import national_rules
        from .plans.schematron import check
        from .sources.shred import shred

        k = F.col("c_custkey")
        on = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
        iban = F.concat(F.lit("DE"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(" "), F.lpad(k.cast("string"), 18, "0"))
        values = [on(11, "999", "380"), on(7, " ", "04011000-1-02"), on(23, "", "Bonn"), on(13, "12", "+49 228 1"), on(17, "a@@b", "a.b@c.de"), on(29, "59", "58"), iban, on(19, "#SKONTO#TAGE=14#\nrest", "to be paid\n#SKONTO#TAGE=14#PROZENT=2.00#\n"), on(31, "a.pdf", "b.pdf")]
        spec = "urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0"
        if syntax == "ubl":
            file = '<cac:AdditionalDocumentReference><cac:Attachment><cbc:EmbeddedDocumentBinaryObject filename="{}"/></cac:Attachment></cac:AdditionalDocumentReference>'
            address = "<cac:PostalAddress><cbc:CityName>{}</cbc:CityName><cbc:PostalZone>53111</cbc:PostalZone></cac:PostalAddress>"
            text = (
                f"<Invoice {_UBL}><cbc:CustomizationID>{spec}</cbc:CustomizationID><cbc:InvoiceTypeCode>%1$s</cbc:InvoiceTypeCode><cbc:BuyerReference>%2$s</cbc:BuyerReference>{file.format('%9$s')}{file.format('a.pdf')}"
                f"<cac:AccountingSupplierParty><cac:Party>{address.format('%3$s')}<cac:PartyTaxScheme><cbc:CompanyID>DE1</cbc:CompanyID></cac:PartyTaxScheme><cac:Contact><cbc:Name>N</cbc:Name><cbc:Telephone>%4$s</cbc:Telephone><cbc:ElectronicMail>%5$s</cbc:ElectronicMail></cac:Contact></cac:Party></cac:AccountingSupplierParty>"
                f"<cac:AccountingCustomerParty><cac:Party>{address.format('Paris')}</cac:Party></cac:AccountingCustomerParty><cac:PaymentMeans><cbc:PaymentMeansCode>%6$s</cbc:PaymentMeansCode><cac:PayeeFinancialAccount><cbc:ID>%7$s</cbc:ID></cac:PayeeFinancialAccount></cac:PaymentMeans><cac:PaymentTerms><cbc:Note>%8$s</cbc:Note></cac:PaymentTerms>"
                "<cac:TaxTotal><cac:TaxSubtotal><cac:TaxCategory><cbc:Percent>19</cbc:Percent></cac:TaxCategory></cac:TaxSubtotal></cac:TaxTotal><cac:InvoiceLine><cac:Item><cac:ClassifiedTaxCategory><cbc:ID>S</cbc:ID></cac:ClassifiedTaxCategory></cac:Item></cac:InvoiceLine></Invoice>"
            )
        else:
            file = '<ram:AdditionalReferencedDocument><ram:AttachmentBinaryObject filename="{}"/></ram:AdditionalReferencedDocument>'
            address = "<ram:PostalTradeAddress><ram:PostcodeCode>53111</ram:PostcodeCode><ram:CityName>{}</ram:CityName></ram:PostalTradeAddress>"
            text = (
                f"<rsm:CrossIndustryInvoice {_CII}><rsm:ExchangedDocumentContext><ram:GuidelineSpecifiedDocumentContextParameter><ram:ID>{spec}</ram:ID></ram:GuidelineSpecifiedDocumentContextParameter></rsm:ExchangedDocumentContext><rsm:ExchangedDocument><ram:TypeCode>%1$s</ram:TypeCode></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction>"
                "<ram:IncludedSupplyChainTradeLineItem><ram:SpecifiedLineTradeSettlement><ram:ApplicableTradeTax><ram:CategoryCode>S</ram:CategoryCode></ram:ApplicableTradeTax></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem>"
                f"<ram:ApplicableHeaderTradeAgreement><ram:BuyerReference>%2$s</ram:BuyerReference><ram:SellerTradeParty><ram:DefinedTradeContact><ram:PersonName>N</ram:PersonName><ram:TelephoneUniversalCommunication><ram:CompleteNumber>%4$s</ram:CompleteNumber></ram:TelephoneUniversalCommunication><ram:EmailURIUniversalCommunication><ram:URIID>%5$s</ram:URIID></ram:EmailURIUniversalCommunication></ram:DefinedTradeContact>{address.format('%3$s')}<ram:SpecifiedTaxRegistration><ram:ID>DE1</ram:ID></ram:SpecifiedTaxRegistration></ram:SellerTradeParty><ram:BuyerTradeParty>{address.format('Paris')}</ram:BuyerTradeParty>{file.format('%9$s')}{file.format('a.pdf')}</ram:ApplicableHeaderTradeAgreement>"
                "<ram:ApplicableHeaderTradeSettlement><ram:SpecifiedTradeSettlementPaymentMeans><ram:TypeCode>%6$s</ram:TypeCode><ram:PayeePartyCreditorFinancialAccount><ram:IBANID>%7$s</ram:IBANID></ram:PayeePartyCreditorFinancialAccount></ram:SpecifiedTradeSettlementPaymentMeans><ram:ApplicableTradeTax><ram:RateApplicablePercent>19</ram:RateApplicablePercent></ram:ApplicableTradeTax><ram:SpecifiedTradePaymentTerms><ram:Description>%8$s</ram:Description></ram:SpecifiedTradePaymentTerms></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"
            )
        docs = spread(table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), F.format_string(text, *values).alias("xml")))
        shapes, rest = structural.split(national_rules(syntax))
        columns = ["doc_id", "rule_id", "flag"]
        return structural.findings(shred(docs), shapes).select(columns).unionByName(check(docs, [rest]).select(columns))

    run.__doc__ = f"The national rules on {syntax.upper()}: payment, contact, IBAN, cash discounts, file names."
    query(_NATIONAL, f"national_rules_{syntax}")(run)


_national("ubl")
_national("cii")


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AS skonto, c_custkey % 5 <> 0 AS phone, c_custkey % 7 <> 0 AS mail, c_custkey % 11 <> 0 AS url FROM customer""")
def fn_formats(spark, sf_dir):
    """Cash discount lines, telephone numbers, e-mail and web addresses."""
    k = F.col("c_custkey")
    pick = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
    skonto = pick(3, F.when(k % 2 == 0, "#SKONTO#TAGE=14#").otherwise("net\n#SKONTO#TAGE=x#PROZENT=2.00#"), F.when(k % 2 == 0, "pay soon").otherwise("a\n#SKONTO#TAGE=14#PROZENT=2.25#BASISBETRAG=357.93#\r\n#VERZUG#TAGE=30#PROZENT=9.00#\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", xp.skonto_ok(skonto).alias("skonto"), xp.phone_ok(pick(5, "0-1", "+49 (0)30")).alias("phone"), xp.mail_ok(pick(7, F.when(k % 2 == 0, "a b@c.de").otherwise("a@c."), " x.y@z.org ")).alias("mail"), xp.url_ok(pick(11, "no web", "https://example.org/a?b=1#c")).alias("url"))


# ---------------------------------------------------------------- schemas

_X = 'xmlns:xs="http://www.w3.org/2001/XMLSchema" elementFormDefault="qualified"'
CONTACT = f"""<xs:schema {_X} targetNamespace="urn:own" xmlns="urn:own">
<xs:simpleType name="code"><xs:restriction base="xs:token"><xs:pattern value="[A-Z]{{2}}[0-9]+"/></xs:restriction></xs:simpleType>
<xs:simpleType name="kind"><xs:restriction base="xs:string"><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:restriction></xs:simpleType>
<xs:simpleType name="money"><xs:restriction base="xs:decimal"><xs:fractionDigits value="2"/><xs:minInclusive value="0"/></xs:restriction></xs:simpleType>
<xs:complexType name="note" mixed="true"><xs:sequence><xs:element name="b" type="xs:string" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
<xs:element name="c"><xs:complexType><xs:sequence><xs:element name="id" type="code"/><xs:choice><xs:element name="mail" type="xs:string"/><xs:element name="phone" type="xs:string"/></xs:choice><xs:element name="kind" type="kind"/>
<xs:element name="amount" type="money"/><xs:element name="note" type="note" minOccurs="0"/><xs:any namespace="##other" processContents="lax" minOccurs="0"/></xs:sequence>
<xs:attribute name="code" type="xs:string" use="required"/><xs:attribute name="n" type="xs:integer"/><xs:attribute name="version" type="xs:string" fixed="1"/></xs:complexType></xs:element></xs:schema>"""
_FAULTY = ((1, "value", "/c/id"), (2, "content", "/c"), (3, "content", "/c"), (4, "value", "/c/kind"), (5, "value", "/c/amount"), (6, "missing-attribute", "/c"), (7, "unknown-attribute", "/c/@x"), (8, "attribute-value", "/c/@n"), (9, "content", "/c"), (10, "unexpected-element", "/d"), (12, "attribute-value", "/c/@version"), (13, "value", "/c/amount"), (15, "content", "/c/kind"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, kind, location FROM customer JOIN (VALUES {', '.join(map(str, _FAULTY))}) f(k, kind, location) ON c_custkey % 16 = k")
def schema_features_e2e(spark, sf_dir):
    """Choices, patterns, enumerations, facets, mixed content, wildcards, attributes, nil and unknown roots against a schema."""
    from .plans.schema import Schema, check

    k = F.col("c_custkey") % 16
    at = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    choice = F.when(k == 2, "").when(k == 3, "<mail>m</mail><phone>1</phone>").when(F.col("c_custkey") % 2 == 0, "<mail>m</mail>").otherwise("<phone>1</phone>")
    attributes = F.concat(at(6, "", ' code="q"'), at(7, ' x="1"', ""), at(8, ' n="x"', ' n=" 12 "'), at(12, ' version="2"', ' version="1"'))
    kind = F.when(k == 4, "<kind>z</kind>").when(k == 15, '<kind xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="true"/>').otherwise("<kind>a</kind>")
    xml = F.concat(F.lit('<c xmlns="urn:own"'), attributes, F.lit(">"), at(9, "text", ""), F.lit("<id>"), at(1, "x1", "AB7"), F.lit("</id>"), choice, kind, F.lit("<amount>"), F.when(k == 5, "1.234").when(k == 13, "-1").otherwise(" 1.50 "), F.lit("</amount>"), at(11, "<note>some <b>bold</b> text</note>", ""), at(14, '<o:p xmlns:o="urn:other"/>', ""), F.lit("</c>"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.when(k == 10, "<d/>").otherwise(xml).alias("xml"))
    return check(docs, Schema.from_texts({"c.xsd": CONTACT}, "c.xsd")).select("doc_id", "kind", "location")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'gültig' ELSE 'ungültig' END || ' (EN 16931)' || CASE WHEN o_orderkey % 2 = 1 THEN chr(10) || '  Fehler  ODD (Zeile 1): number ' || o_orderkey || ' [/Invoice]' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '  Hinweis THIRD (Zeile 1): third [/Invoice]' ELSE '' END AS text FROM orders""")
def report_e2e(spark, sf_dir):
    """The text report, in German, of a user's rule set whose findings come in the order of reporting."""
    from .api import Options, report, validate
    from .plans.schematron import Ruleset

    rules = Ruleset.from_text('<schema xmlns="http://purl.oclc.org/dsdl/schematron"><ns prefix="cbc" uri="%s"/><pattern><rule context="/*"><assert id="THIRD" flag="info" test="cbc:ID mod 3 != 0">third</assert><assert id="ODD" test="cbc:ID mod 2 = 0">number <value-of select="cbc:ID"/></assert></rule></pattern></schema>' % NS["cbc"], "en16931-ubl")  # noqa: UP031
    key = F.col("o_orderkey")
    docs = as_docs(table(spark, sf_dir, "orders").select(key.cast("string").alias("doc_id"), F.format_string(f"<Invoice {_UBL}><cbc:CustomizationID>urn:cen.eu:en16931:2017</cbc:CustomizationID><cbc:ID>%d</cbc:ID></Invoice>", key).alias("xml")))
    found = validate(docs, [rules], Options(keep_nodes=False))
    return report(found, "de").select(F.col("input_idx").cast("string").alias("doc_id"), F.regexp_replace("text", "^[0-9]+: ", "").alias("text"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % 2 WHEN 0 THEN 'warning' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % 3 = 0")
def severity_layers_e2e(spark, sf_dir):
    """The severities that the national validation puts in place of a rule's flag: of the standard, and of the extension."""
    from .api import Options, validate
    from .plans.schematron import Ruleset

    rules = Ruleset.from_text('<schema xmlns="http://purl.oclc.org/dsdl/schematron"><ns prefix="cbc" uri="%s"/><pattern><rule context="/*"><assert id="BR-CL-21" test="cbc:ID mod 3 != 0">code</assert></rule></pattern></schema>' % NS["cbc"], "xrechnung-ubl")  # noqa: UP031
    key = F.col("o_orderkey")
    spec = F.concat(F.lit("urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0"), F.when(key % 2 == 1, "#conformant#urn:xeinkauf.de:kosit:extension:xrechnung_3.0").otherwise(""))
    docs = as_docs(table(spark, sf_dir, "orders").select(key.cast("string").alias("doc_id"), F.format_string(f"<Invoice {_UBL}><cbc:CustomizationID>%s</cbc:CustomizationID><cbc:ID>%d</cbc:ID></Invoice>", spec, key).alias("xml")))
    return validate(docs, [rules], Options(keep_nodes=False)).findings.filter("rule_id = 'BR-CL-21'").select("doc_id", "severity")
