"""The built-in national rules of XRechnung, written from their meaning: one table of rules, and places of their terms in UBL and CII."""

from __future__ import annotations

from ..functions import xp
from .core_rules import ROOT as UBL_ROOT
from .detect import NS
from .schematron import Assertion, Function, Rule, Ruleset

_SETTLEMENT = "rsm:SupplyChainTradeTransaction/ram:ApplicableHeaderTradeSettlement"
_AGREEMENT, _DELIVERY = (f"rsm:SupplyChainTradeTransaction/ram:ApplicableHeaderTrade{x}" for x in ("Agreement", "Delivery"))
_SELLER = "cac:AccountingSupplierParty/cac:Party"
#: Where each term stands, from the document's root, or from payment means or tax for those behind the bar.
PLACES = {
    "ubl": {
        "root": UBL_ROOT, "payment": "cac:PaymentMeans", "contact": f"{_SELLER}/cac:Contact", "contact_name": f"{_SELLER}/cac:Contact/cbc:Name", "phone": f"{_SELLER}/cac:Contact/cbc:Telephone", "mail": f"{_SELLER}/cac:Contact/cbc:ElectronicMail",
        "seller_city": f"{_SELLER}/cac:PostalAddress/cbc:CityName", "seller_zone": f"{_SELLER}/cac:PostalAddress/cbc:PostalZone", "buyer_city": "cac:AccountingCustomerParty/cac:Party/cac:PostalAddress/cbc:CityName", "buyer_zone": "cac:AccountingCustomerParty/cac:Party/cac:PostalAddress/cbc:PostalZone",
        "delivery": "cac:Delivery/cac:DeliveryLocation/cac:Address", "delivery_city": "cac:Delivery/cac:DeliveryLocation/cac:Address/cbc:CityName", "delivery_zone": "cac:Delivery/cac:DeliveryLocation/cac:Address/cbc:PostalZone", "tax": "cac:TaxTotal/cac:TaxSubtotal", "rate": "cac:TaxCategory/cbc:Percent",
        "reference": "cbc:BuyerReference", "category": "(cac:InvoiceLine | cac:CreditNoteLine)/cac:Item/cac:ClassifiedTaxCategory/cbc:ID", "seller_tax": f"({_SELLER}/cac:PartyTaxScheme/cbc:CompanyID | cac:TaxRepresentativeParty)", "type": "(cbc:InvoiceTypeCode | cbc:CreditNoteTypeCode)", "terms": "cac:PaymentTerms/cbc:Note",
        "specification": "cbc:CustomizationID", "attached": "cac:AdditionalDocumentReference/cac:Attachment/cbc:EmbeddedDocumentBinaryObject/@filename", "preceding": "cac:BillingReference/cac:InvoiceDocumentReference", "due": "cac:LegalMonetaryTotal/cbc:PayableAmount",
        "code": "cbc:PaymentMeansCode", "account": "cac:PayeeFinancialAccount", "iban": "cac:PayeeFinancialAccount/cbc:ID", "card": "cac:CardAccount", "mandate": "cac:PaymentMandate", "debited": "cac:PaymentMandate/cac:PayerFinancialAccount/cbc:ID",
        "creditor": f"/*/{_SELLER}/cac:PartyIdentification/cbc:ID[@schemeID = 'SEPA']",
    },
    "cii": {
        "root": "/rsm:CrossIndustryInvoice", "payment": f"{_SETTLEMENT}/ram:SpecifiedTradeSettlementPaymentMeans", "contact": f"{_AGREEMENT}/ram:SellerTradeParty/ram:DefinedTradeContact", "contact_name": f"{_AGREEMENT}/ram:SellerTradeParty/ram:DefinedTradeContact/(ram:PersonName | ram:DepartmentName)",
        "phone": f"{_AGREEMENT}/ram:SellerTradeParty/ram:DefinedTradeContact/ram:TelephoneUniversalCommunication/ram:CompleteNumber", "mail": f"{_AGREEMENT}/ram:SellerTradeParty/ram:DefinedTradeContact/ram:EmailURIUniversalCommunication/ram:URIID",
        "seller_city": f"{_AGREEMENT}/ram:SellerTradeParty/ram:PostalTradeAddress/ram:CityName", "seller_zone": f"{_AGREEMENT}/ram:SellerTradeParty/ram:PostalTradeAddress/ram:PostcodeCode", "buyer_city": f"{_AGREEMENT}/ram:BuyerTradeParty/ram:PostalTradeAddress/ram:CityName", "buyer_zone": f"{_AGREEMENT}/ram:BuyerTradeParty/ram:PostalTradeAddress/ram:PostcodeCode",
        "delivery": f"{_DELIVERY}/ram:ShipToTradeParty/ram:PostalTradeAddress", "delivery_city": f"{_DELIVERY}/ram:ShipToTradeParty/ram:PostalTradeAddress/ram:CityName", "delivery_zone": f"{_DELIVERY}/ram:ShipToTradeParty/ram:PostalTradeAddress/ram:PostcodeCode", "tax": f"{_SETTLEMENT}/ram:ApplicableTradeTax", "rate": "ram:RateApplicablePercent",
        "reference": f"{_AGREEMENT}/ram:BuyerReference", "category": "rsm:SupplyChainTradeTransaction/ram:IncludedSupplyChainTradeLineItem/ram:SpecifiedLineTradeSettlement/ram:ApplicableTradeTax/ram:CategoryCode", "seller_tax": f"({_AGREEMENT}/ram:SellerTradeParty/ram:SpecifiedTaxRegistration/ram:ID | {_AGREEMENT}/ram:SellerTaxRepresentativeTradeParty)",
        "type": "rsm:ExchangedDocument/ram:TypeCode", "terms": f"{_SETTLEMENT}/ram:SpecifiedTradePaymentTerms/ram:Description", "specification": "rsm:ExchangedDocumentContext/ram:GuidelineSpecifiedDocumentContextParameter/ram:ID", "attached": f"{_AGREEMENT}/ram:AdditionalReferencedDocument/ram:AttachmentBinaryObject/@filename",
        "preceding": f"{_SETTLEMENT}/ram:InvoiceReferencedDocument", "due": f"{_SETTLEMENT}/ram:SpecifiedTradeSettlementHeaderMonetarySummation/ram:DuePayableAmount", "code": "ram:TypeCode", "account": "ram:PayeePartyCreditorFinancialAccount", "iban": "ram:PayeePartyCreditorFinancialAccount/ram:IBANID",
        "card": "ram:ApplicableTradeSettlementFinancialCard", "mandate": "../ram:SpecifiedTradePaymentTerms/ram:DirectDebitMandateID", "debited": "ram:PayerPartyDebtorFinancialAccount/ram:IBANID", "creditor": "../ram:CreditorReferenceID",
    },
}


def _filled(place: str) -> str:
    return f"normalize-space(({{{place}}})[1]) != ''"


def _means(codes: str, needed: str, *others: str) -> str:
    return f"not({{code}} = ({codes})) or ({needed}{''.join(f' and not({x})' for x in others)})"


#: (id, flag, what the context is, test, message); names in braces are places.
RULES = (
    ("BR-DE-1", "fatal", "root", "{payment}", "There are payment instructions (BG-16)"),
    ("BR-DE-2", "fatal", "root", "{contact}", "The seller has a contact (BG-6)"),
    ("BR-DE-3", "fatal", "root", _filled("seller_city"), "The seller's address has a city (BT-37)"),
    ("BR-DE-4", "fatal", "root", _filled("seller_zone"), "The seller's address has a post code (BT-38)"),
    ("BR-DE-5", "fatal", "root", "not({contact}) or " + _filled("contact_name"), "The seller's contact has a name (BT-41)"),
    ("BR-DE-6", "fatal", "root", "not({contact}) or " + _filled("phone"), "The seller's contact has a telephone number (BT-42)"),
    ("BR-DE-7", "fatal", "root", "not({contact}) or " + _filled("mail"), "The seller's contact has an e-mail address (BT-43)"),
    ("BR-DE-8", "fatal", "root", _filled("buyer_city"), "The buyer's address has a city (BT-52)"),
    ("BR-DE-9", "fatal", "root", _filled("buyer_zone"), "The buyer's address has a post code (BT-53)"),
    ("BR-DE-10", "fatal", "root", "not({delivery}) or " + _filled("delivery_city"), "A delivery address has a city (BT-77)"),
    ("BR-DE-11", "fatal", "root", "not({delivery}) or " + _filled("delivery_zone"), "A delivery address has a post code (BT-78)"),
    ("BR-DE-14", "fatal", "tax", _filled("rate"), "A VAT breakdown has a rate (BT-119)"),
    ("BR-DE-15", "fatal", "root", _filled("reference"), "There is a buyer reference (BT-10)"),
    ("BR-DE-16", "fatal", "root", "not({category} = ('S', 'Z', 'E', 'AE', 'K', 'G', 'L', 'M')) or {seller_tax}", "A seller within VAT has a tax number, a VAT identifier or a representative"),
    ("BR-DE-17", "warning", "root", "{type} = ('326', '380', '381', '384', '389', '875', '876', '877')", "The type code is one of those in use (BT-3)"),
    ("BR-DE-18", "fatal", "root", f"every $l in {{terms}}/tokenize(., '\\r?\\n')[starts-with(normalize-space(.), '#')] satisfies matches(normalize-space($l), '{xp.SKONTO}')", "Lines of payment terms that begin with # are complete cash discounts (BT-20)"),
    ("BR-DE-19", "warning", "payment", "not({code} = '58') or (every $a in {iban} satisfies own:iban($a))", "The account of a SEPA credit transfer is an IBAN (BT-84)"),
    ("BR-DE-20", "warning", "payment", "not({code} = '59') or (every $a in {debited} satisfies own:iban($a))", "The debited account of a SEPA direct debit is an IBAN (BT-91)"),
    ("BR-DE-21", "warning", "root", "starts-with(normalize-space(({specification})[1]), 'urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_')", "The specification identifier is that of the standard (BT-24)"),
    ("BR-DE-22", "fatal", "root", "count({attached}) = count(distinct-values({attached}))", "Attached files differ in name"),
    ("BR-DE-23", "fatal", "payment", _means("'30', '58'", "{account}", "{card}", "{mandate}"), "A credit transfer has an account and no card or mandate"),
    ("BR-DE-24", "fatal", "payment", _means("'48', '54', '55'", "{card}", "{account}", "{mandate}"), "A card payment has a card and no account or mandate"),
    ("BR-DE-25", "fatal", "payment", _means("'59'", "{mandate}", "{account}", "{card}"), "A direct debit has a mandate and no account or card"),
    ("BR-DE-26", "warning", "root", "not({type} = '384') or {preceding}", "A corrected invoice names the one before it (BG-3)"),
    ("BR-DE-27", "warning", "root", f"every $p in {{phone}} satisfies matches($p, '{xp.PHONE}')", "A telephone number has three digits at least (BT-42)"),
    ("BR-DE-28", "warning", "root", f"every $m in {{mail}} satisfies matches(normalize-space($m), '{xp.MAIL}')", "An e-mail address has one @ between parts without blanks or dots at their ends (BT-43)"),
    ("BR-DE-30", "fatal", "payment", "not({mandate}) or {creditor}", "A direct debit has a creditor identifier (BT-90)"),
    ("BR-DE-31", "fatal", "payment", "not({mandate}) or {debited}", "A direct debit has a debited account (BT-91)"),
)
#: An IBAN is letters and digits whose number, the first four characters behind the others and letters as two digits, leaves 1 over 97.
_IBAN = "matches($s, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$') and xs:integer(string-join(for $c in string-to-codepoints(concat(substring($s, 5), substring($s, 1, 4))) return (if ($c > 64) then string($c - 55) else string($c - 48)), '')) mod 97 = 1"


def national_rules(syntax: str, id: str | None = None) -> Ruleset:
    """The rule set for ``ubl`` or ``cii``; every rule is a pattern of its own."""
    places = PLACES[syntax]
    context = lambda what: places["root"] if what == "root" else " | ".join(f"{r.strip()}/{places[what]}" for r in places["root"].split("|"))
    fill = lambda test: _fill(test, places)
    names = ("ubl", "cn", "cac", "cbc") if syntax == "ubl" else ("rsm", "ram", "udt")
    iban = Function(("{urn:billprism}iban", 1), ["x"], [("s", "upper-case(translate($x, ' ', ''))")], _IBAN)
    patterns = [[Rule(context(what), [], [Assertion(name, flag, fill(test), False, [("text", message)], 0)])] for name, flag, what, test, message in RULES]
    return Ruleset(id or f"xrechnung-{syntax}", {k: NS[k] for k in names} | {"own": "urn:billprism"}, [], [iban], patterns)


def _fill(test: str, places: dict[str, str]) -> str:
    for name, place in places.items():
        test = test.replace(f"{{{name}}}", place)
    return test
