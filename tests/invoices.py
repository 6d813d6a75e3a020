"""Small invoices of our own and a rule set for them."""

import zlib

NS = 'xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:cac="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2" xmlns:cbc="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"'


def ubl(spec="urn:cen.eu:en16931:2017", number="A-1", reference="04011000-12345-03", total="30.00", lines=("10.00", "20.00"), extra=""):
    body = "\n".join(f'  <cac:InvoiceLine><cbc:ID>{i}</cbc:ID><cbc:LineExtensionAmount currencyID="EUR">{n}</cbc:LineExtensionAmount></cac:InvoiceLine>' for i, n in enumerate(lines, 1))
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<Invoice {NS}>
  <cbc:CustomizationID> {spec} </cbc:CustomizationID>
  <cbc:ID>{number}</cbc:ID>
  <cbc:IssueDate>2024-05-06</cbc:IssueDate>
  <cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode>
  <cbc:BuyerReference>{reference}</cbc:BuyerReference>
  <cac:AccountingSupplierParty><cac:Party><cac:PartyName><cbc:Name>Büro &amp; Söhne</cbc:Name></cac:PartyName></cac:Party></cac:AccountingSupplierParty>
  <cac:TaxTotal><cbc:TaxAmount currencyID="USD">9.99</cbc:TaxAmount><cbc:TaxAmount currencyID="EUR">5.70</cbc:TaxAmount></cac:TaxTotal>
  <cac:LegalMonetaryTotal><cbc:LineExtensionAmount currencyID="EUR">{total}</cbc:LineExtensionAmount></cac:LegalMonetaryTotal>{extra}
{body}
</Invoice>"""


RULES = """<schema xmlns="http://purl.oclc.org/dsdl/schematron" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:f="urn:own" queryBinding="xslt2">
 <ns prefix="cac" uri="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"/>
 <ns prefix="cbc" uri="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"/>
 <ns prefix="f" uri="urn:own"/>
 <let name="late" value="$currency"/>
 <let name="currency" value="/*/cbc:DocumentCurrencyCode"/>
 <xsl:function name="f:twice"><xsl:param name="x"/><xsl:sequence select="xs:decimal($x) * 2"/></xsl:function>
 <pattern>
  <rule context="cac:LegalMonetaryTotal"><let name="sum" value="sum(//cac:InvoiceLine/cbc:LineExtensionAmount/xs:decimal(.))"/>
   <assert id="T-SUM" flag="fatal" test="xs:decimal(cbc:LineExtensionAmount) = $sum">Sum is <value-of select="$sum"/>, not <value-of select="cbc:LineExtensionAmount"/></assert></rule>
  <rule context="//cac:InvoiceLine[cbc:ID = '1']"><assert id="T-FIRST" flag="warning" test="false()">first <name/></assert></rule>
  <rule context="cac:InvoiceLine"><assert id="T-LINE" role="info" test="f:twice(cbc:LineExtensionAmount) &lt; 100">line</assert>
   <report id="T-ERR" test="xs:decimal(cbc:LineExtensionAmount) &lt; 0">negative</report></rule>
 </pattern>
 <pattern><rule context="/*"><assert id="T-CUR" test="$late = 'EUR'">currency</assert></rule></pattern>
</schema>"""


def pdf(xml: str, level="EN 16931", name="factur-x.xml") -> bytes:
    data, meta = zlib.compress(xml.encode()), f"<x><fx:ConformanceLevel>{level}</fx:ConformanceLevel></x>".encode()
    return (
        b"%%PDF-1.7\n1 0 obj\n<< /Type /EmbeddedFile /Subtype /text#2Fxml /Filter /FlateDecode /Length %d >>\nstream\n" % len(data) + data + b"\nendstream\nendobj\n"
        + b"2 0 obj\n<< /Type /Filespec /F (" + name.encode() + b") /UF (" + name.encode() + b") /EF << /F 1 0 R >> >>\nendobj\n"
        + b"3 0 obj\n<< /Type /Metadata /Subtype /XML /Length %d >>\nstream\n" % len(meta) + meta + b"\nendstream\nendobj\n%%EOF"
    )
