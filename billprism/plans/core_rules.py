"""A built-in rule set: the core business rules of EN 16931 on UBL, written from their meaning.

Rules of one kind (amounts of two decimals, VAT categories) come from a table and a pattern. Users who need a complete, official rule
set bring its text to ``Ruleset.from_text``; this one is for validation without any file.
"""

from __future__ import annotations

import re

from .detect import NS
from .schematron import Assertion, Rule, Ruleset

ROOT = "/ubl:Invoice | /cn:CreditNote"
LINE = "cac:InvoiceLine | cac:CreditNoteLine"
_LINES = "(cac:InvoiceLine | cac:CreditNoteLine)"
_SELLER, _BUYER = "cac:AccountingSupplierParty/cac:Party", "cac:AccountingCustomerParty/cac:Party"
_ALLOWANCE, _CHARGE = "cac:AllowanceCharge[cbc:ChargeIndicator = 'false']", "cac:AllowanceCharge[cbc:ChargeIndicator = 'true']"
_TOTAL = "cac:LegalMonetaryTotal"


def _dec(path: str) -> str:
    return f"xs:decimal({path})"


def _opt(path: str) -> str:
    """An amount that counts as zero where it is missing."""
    return f"(if ({path}) then xs:decimal({path}) else 0)"


def _sum(path: str) -> str:
    return f"sum(for $a in {path} return xs:decimal($a))"


def _cents(value: str) -> str:
    return f"(round(({value}) * 100) div 100)"


def _filled(path: str) -> str:
    return f"normalize-space(({path})[1]) != ''"


#: (id, context, test, message)
RULES: list[tuple[str, str, str, str]] = [
    ("BR-01", ROOT, _filled("cbc:CustomizationID"), "An invoice names the specification it follows (BT-24)"),
    ("BR-02", ROOT, _filled("cbc:ID"), "An invoice has a number (BT-1)"),
    ("BR-03", ROOT, _filled("cbc:IssueDate"), "An invoice has an issue date (BT-2)"),
    ("BR-04", ROOT, _filled("cbc:InvoiceTypeCode | cbc:CreditNoteTypeCode"), "An invoice has a type code (BT-3)"),
    ("BR-05", ROOT, _filled("cbc:DocumentCurrencyCode"), "An invoice has a currency (BT-5)"),
    ("BR-06", ROOT, _filled(f"{_SELLER}/cac:PartyLegalEntity/cbc:RegistrationName"), "The seller has a name (BT-27)"),
    ("BR-07", ROOT, _filled(f"{_BUYER}/cac:PartyLegalEntity/cbc:RegistrationName"), "The buyer has a name (BT-44)"),
    ("BR-08", ROOT, f"{_SELLER}/cac:PostalAddress", "The seller has a postal address (BG-5)"),
    ("BR-09", f"{_SELLER}/cac:PostalAddress", _filled("cac:Country/cbc:IdentificationCode"), "The seller's address has a country (BT-40)"),
    ("BR-10", ROOT, f"{_BUYER}/cac:PostalAddress", "The buyer has a postal address (BG-8)"),
    ("BR-11", f"{_BUYER}/cac:PostalAddress", _filled("cac:Country/cbc:IdentificationCode"), "The buyer's address has a country (BT-55)"),
    ("BR-12", _TOTAL, "cbc:LineExtensionAmount", "There is a sum of line net amounts (BT-106)"),
    ("BR-13", _TOTAL, "cbc:TaxExclusiveAmount", "There is a total without VAT (BT-109)"),
    ("BR-14", _TOTAL, "cbc:TaxInclusiveAmount", "There is a total with VAT (BT-112)"),
    ("BR-15", _TOTAL, "cbc:PayableAmount", "There is an amount due (BT-115)"),
    ("BR-16", ROOT, "cac:InvoiceLine or cac:CreditNoteLine", "An invoice has a line (BG-25)"),
    ("BR-17", "cac:PayeeParty", f"cac:PartyName/cbc:Name and not(cac:PartyName/cbc:Name = ../{_SELLER}/cac:PartyName/cbc:Name) and not(cac:PartyIdentification/cbc:ID = ../{_SELLER}/cac:PartyIdentification/cbc:ID)", "A payee other than the seller has a name (BT-59)"),
    ("BR-21", LINE, _filled("cbc:ID"), "A line has an identifier (BT-126)"),
    ("BR-22", LINE, "cbc:InvoicedQuantity or cbc:CreditedQuantity", "A line has a quantity (BT-129)"),
    ("BR-23", LINE, "cbc:InvoicedQuantity/@unitCode or cbc:CreditedQuantity/@unitCode", "A quantity has a unit (BT-130)"),
    ("BR-24", LINE, "cbc:LineExtensionAmount", "A line has a net amount (BT-131)"),
    ("BR-25", LINE, _filled("cac:Item/cbc:Name"), "A line's item has a name (BT-153)"),
    ("BR-26", LINE, "cac:Price/cbc:PriceAmount", "A line has a net price (BT-146)"),
    ("BR-27", LINE, f"not(cac:Price/cbc:PriceAmount) or {_dec('cac:Price/cbc:PriceAmount')} >= 0", "A net price is not negative"),
    ("BR-28", LINE, f"not(cac:Price/cac:AllowanceCharge/cbc:BaseAmount) or {_dec('cac:Price/cac:AllowanceCharge/cbc:BaseAmount')} >= 0", "A gross price is not negative"),
    ("BR-29", "/*/cac:InvoicePeriod", "not(cbc:StartDate and cbc:EndDate) or xs:date(cbc:EndDate) >= xs:date(cbc:StartDate)", "A period ends after it begins"),
    ("BR-30", "cac:InvoiceLine/cac:InvoicePeriod | cac:CreditNoteLine/cac:InvoicePeriod", "not(cbc:StartDate and cbc:EndDate) or xs:date(cbc:EndDate) >= xs:date(cbc:StartDate)", "A line's period ends after it begins"),
    ("BR-45", "cac:TaxTotal/cac:TaxSubtotal", "cbc:TaxableAmount", "A VAT breakdown has a taxable amount (BT-116)"),
    ("BR-46", "cac:TaxTotal/cac:TaxSubtotal", "cbc:TaxAmount", "A VAT breakdown has a tax amount (BT-117)"),
    ("BR-47", "cac:TaxTotal/cac:TaxSubtotal", "cac:TaxCategory[cac:TaxScheme/cbc:ID = 'VAT']/cbc:ID", "A VAT breakdown has a category (BT-118)"),
    ("BR-48", "cac:TaxTotal/cac:TaxSubtotal", "cac:TaxCategory[cac:TaxScheme/cbc:ID = 'VAT']/cbc:Percent or cac:TaxCategory/cbc:ID = 'O'", "A VAT breakdown has a rate (BT-119), unless it is outside VAT"),
    ("BR-49", "cac:PaymentMeans", "cbc:PaymentMeansCode", "Payment means have a code (BT-81)"),
    ("BR-50", "cac:PaymentMeans[cbc:PaymentMeansCode = ('30', '58')]/cac:PayeeFinancialAccount", _filled("cbc:ID"), "A credit transfer's account has an identifier (BT-84)"),
    ("BR-52", "cac:AdditionalDocumentReference", _filled("cbc:ID"), "A supporting document has a reference (BT-122)"),
    ("BR-53", ROOT, "every $c in cbc:TaxCurrencyCode satisfies cac:TaxTotal/cbc:TaxAmount[@currencyID = $c]", "A VAT accounting currency goes with a VAT total in it"),
    ("BR-54", "cac:Item/cac:AdditionalItemProperty", "cbc:Name and cbc:Value", "An item attribute has a name and a value"),
    ("BR-55", "cac:BillingReference", "cac:InvoiceDocumentReference/cbc:ID", "A preceding invoice has a number (BT-25)"),
    ("BR-56", "cac:TaxRepresentativeParty", "cac:PartyTaxScheme[cac:TaxScheme/cbc:ID = 'VAT']/cbc:CompanyID", "A tax representative has a VAT identifier (BT-63)"),
    ("BR-57", "cac:Delivery/cac:DeliveryLocation/cac:Address", "cac:Country/cbc:IdentificationCode", "A delivery address has a country (BT-80)"),
    ("BR-61", "cac:PaymentMeans[cbc:PaymentMeansCode = ('30', '58')]", "cac:PayeeFinancialAccount/cbc:ID", "A credit transfer names an account (BT-84)"),
    ("BR-62", f"{_SELLER}/cbc:EndpointID", "@schemeID", "The seller's electronic address has a scheme"),
    ("BR-63", f"{_BUYER}/cbc:EndpointID", "@schemeID", "The buyer's electronic address has a scheme"),
    ("BR-64", "cac:Item/cac:StandardItemIdentification/cbc:ID", "@schemeID", "An item's standard identifier has a scheme"),
    ("BR-65", "cac:Item/cac:CommodityClassification/cbc:ItemClassificationCode", "@listID", "An item's classification has a scheme"),
    ("BR-CO-03", ROOT, "not(cbc:TaxPointDate and cac:InvoicePeriod/cbc:DescriptionCode)", "A VAT point date and a VAT point code exclude each other"),
    ("BR-CO-04", LINE, "cac:Item/cac:ClassifiedTaxCategory[cac:TaxScheme/cbc:ID = 'VAT']/cbc:ID", "A line has a VAT category (BT-151)"),
    ("BR-CO-10", _TOTAL, f"{_dec('cbc:LineExtensionAmount')} = {_cents(_sum('../' + _LINES + '/cbc:LineExtensionAmount'))}", "The sum of line net amounts is that of the lines"),
    ("BR-CO-11", _TOTAL, f"{_opt('cbc:AllowanceTotalAmount')} = {_cents(_sum(f'../{_ALLOWANCE}/cbc:Amount'))}", "The sum of allowances is that of the allowances"),
    ("BR-CO-12", _TOTAL, f"{_opt('cbc:ChargeTotalAmount')} = {_cents(_sum(f'../{_CHARGE}/cbc:Amount'))}", "The sum of charges is that of the charges"),
    ("BR-CO-13", _TOTAL, f"{_dec('cbc:TaxExclusiveAmount')} = {_cents(_dec('cbc:LineExtensionAmount') + ' - ' + _opt('cbc:AllowanceTotalAmount') + ' + ' + _opt('cbc:ChargeTotalAmount'))}", "The total without VAT is lines less allowances plus charges"),
    ("BR-CO-14", "/*/cac:TaxTotal[cac:TaxSubtotal]", f"{_dec('cbc:TaxAmount')} = {_cents(_sum('cac:TaxSubtotal/cbc:TaxAmount'))}", "The VAT total is the sum of the breakdown"),
    ("BR-CO-15", ROOT, f"every $c in cbc:DocumentCurrencyCode satisfies (count(cac:TaxTotal/cbc:TaxAmount[@currencyID = $c]) = 1 and {_TOTAL}/xs:decimal(cbc:TaxInclusiveAmount) = {_cents(f'{_TOTAL}/xs:decimal(cbc:TaxExclusiveAmount) + cac:TaxTotal/cbc:TaxAmount[@currencyID = $c]/xs:decimal(.)')})", "The total with VAT is the total without plus VAT"),
    ("BR-CO-16", _TOTAL, f"{_dec('cbc:PayableAmount')} = {_cents(_dec('cbc:TaxInclusiveAmount') + ' - ' + _opt('cbc:PrepaidAmount') + ' + ' + _opt('cbc:PayableRoundingAmount'))}", "The amount due is the total with VAT less what is paid, rounded"),
    ("BR-CO-17", "cac:TaxTotal/cac:TaxSubtotal", f"not(cac:TaxCategory/cbc:Percent) or abs({_dec('cbc:TaxAmount')} - {_cents(_dec('cbc:TaxableAmount') + ' * ' + _dec('cac:TaxCategory/cbc:Percent') + ' div 100')}) <= 1", "A VAT amount is taxable amount times rate"),
    ("BR-CO-18", ROOT, "cac:TaxTotal/cac:TaxSubtotal", "There is a VAT breakdown (BG-23)"),
    ("BR-CO-19", "/*/cac:InvoicePeriod", "cbc:StartDate or cbc:EndDate or (cbc:DescriptionCode and not(cbc:StartDate) and not(cbc:EndDate))", "A period has a begin or an end"),
    ("BR-CO-20", "cac:InvoiceLine/cac:InvoicePeriod | cac:CreditNoteLine/cac:InvoicePeriod", "cbc:StartDate or cbc:EndDate", "A line's period has a begin or an end"),
    ("BR-CO-25", "/ubl:Invoice[cac:LegalMonetaryTotal/cbc:PayableAmount > 0]", "cbc:DueDate or cac:PaymentTerms/cbc:Note", "A positive amount due has a due date or payment terms"),
    ("BR-CO-26", ROOT, f"{_SELLER}/cac:PartyIdentification/cbc:ID or {_SELLER}/cac:PartyLegalEntity/cbc:CompanyID or {_SELLER}/cac:PartyTaxScheme[cac:TaxScheme/cbc:ID = 'VAT']/cbc:CompanyID", "The seller can be identified"),
]
for _base, _path, _what in ((31, f"/*/{_ALLOWANCE}", "allowance"), (36, f"/*/{_CHARGE}", "charge")):
    RULES += [
        (f"BR-{_base}", _path, "cbc:Amount", f"A document level {_what} has an amount"),
        (f"BR-{_base + 1}", _path, "cac:TaxCategory[cac:TaxScheme/cbc:ID = 'VAT']/cbc:ID", f"A document level {_what} has a VAT category"),
        (f"BR-{_base + 2}", _path, "cbc:AllowanceChargeReason or cbc:AllowanceChargeReasonCode", f"A document level {_what} has a reason"),
    ]
for _base, _kind, _what in ((41, _ALLOWANCE, "allowance"), (43, _CHARGE, "charge")):
    _path = f"cac:InvoiceLine/{_kind} | cac:CreditNoteLine/{_kind}"
    RULES += [(f"BR-{_base}", _path, "cbc:Amount", f"A line {_what} has an amount"), (f"BR-{_base + 1}", _path, "cbc:AllowanceChargeReason or cbc:AllowanceChargeReasonCode", f"A line {_what} has a reason")]

#: Amounts of two decimals at most: number of the rule, context, element.
TWO_DECIMALS = (
    ("01", f"/*/{_ALLOWANCE}", "cbc:Amount"), ("02", f"/*/{_ALLOWANCE}", "cbc:BaseAmount"), ("05", f"/*/{_CHARGE}", "cbc:Amount"), ("06", f"/*/{_CHARGE}", "cbc:BaseAmount"), ("09", _TOTAL, "cbc:LineExtensionAmount"), ("10", _TOTAL, "cbc:AllowanceTotalAmount"),
    ("11", _TOTAL, "cbc:ChargeTotalAmount"), ("12", _TOTAL, "cbc:TaxExclusiveAmount"), ("14", _TOTAL, "cbc:TaxInclusiveAmount"), ("16", _TOTAL, "cbc:PrepaidAmount"), ("17", _TOTAL, "cbc:PayableRoundingAmount"), ("18", _TOTAL, "cbc:PayableAmount"),
    ("19", "cac:TaxTotal/cac:TaxSubtotal", "cbc:TaxableAmount"), ("20", "cac:TaxTotal/cac:TaxSubtotal", "cbc:TaxAmount"), ("23", LINE, "cbc:LineExtensionAmount"),
)
RULES += [(f"BR-DEC-{n}", c, f"every $a in {e} satisfies string-length(substring-after($a, '.')) <= 2", f"{e[4:]} has two decimals at most") for n, c, e in TWO_DECIMALS]

#: VAT categories: code, letters of their rules, and what is known of their rate: above 0, 0, 0 or more, or none.
CATEGORIES = (("S", "S", "above"), ("Z", "Z", "zero"), ("E", "E", "zero"), ("AE", "AE", "zero"), ("K", "IC", "zero"), ("G", "G", "zero"), ("O", "O", "none"), ("L", "AF", "any"), ("M", "AG", "any"))


def _category(code: str, name: str, rates: str) -> list[tuple[str, str, str, str]]:
    vat = f"cac:TaxCategory[normalize-space(cbc:ID) = '{code}'][cac:TaxScheme/normalize-space(cbc:ID) = 'VAT']"
    item = f"cac:Item/cac:ClassifiedTaxCategory[normalize-space(cbc:ID) = '{code}'][cac:TaxScheme/normalize-space(cbc:ID) = 'VAT']"
    used, broken = f"'{code}' = ($of_lines, $of_allowances, $of_charges)", f"cac:TaxTotal/cac:TaxSubtotal/{vat}"
    by_rate = rates in ("above", "any")
    rate = {"zero": "xs:decimal(cbc:Percent) = 0", "above": "xs:decimal(cbc:Percent) > 0", "any": "xs:decimal(cbc:Percent) >= 0", "none": "not(cbc:Percent)"}[rates]
    amount = f"abs(xs:decimal(../cbc:TaxAmount) - {_cents('xs:decimal(../cbc:TaxableAmount) * xs:decimal(cbc:Percent) div 100')}) < 1" if by_rate else "xs:decimal(../cbc:TaxAmount) = 0"
    reason = "cbc:TaxExemptionReason or cbc:TaxExemptionReasonCode"
    same = "[xs:decimal(cbc:Percent) = $r]" if by_rate else ""
    parts = " + ".join((_sum(f"../../../{_LINES}[{item}{same}]/cbc:LineExtensionAmount"), _sum(f"../../../{_CHARGE}[{vat}{same}]/cbc:Amount")))
    parts += " - " + _sum(f"../../../{_ALLOWANCE}[{vat}{same}]/cbc:Amount")
    whole = f"every $r in xs:decimal(cbc:Percent) satisfies abs(xs:decimal(../cbc:TaxableAmount) - ({parts})) < 1" if by_rate else f"xs:decimal(../cbc:TaxableAmount) = {_cents(parts)}"
    out = [(f"BR-{name}-01", ROOT, f"not({used}) or '{code}' = $of_breakdown" if by_rate else f"count($of_breakdown[. = '{code}']) = (if ({used}) then 1 else 0)", f"Category {code} has its place in the VAT breakdown")]
    if rates != "none":
        out += [(f"BR-{name}-0{k}", ROOT, f"not('{code}' = ${there}) or $seller_taxed", f"A seller who uses category {code} has a tax identifier") for k, there in ((2, "of_lines"), (3, "of_allowances"), (4, "of_charges"))]
    return [
        *out,
        (f"BR-{name}-05", f"cac:InvoiceLine/{item} | cac:CreditNoteLine/{item}", rate, f"The rate of a line of category {code}"),
        *((f"BR-{name}-0{k}", f"/*/{kind}/{vat}", rate, f"The rate of an allowance or charge of category {code}") for k, kind in ((6, _ALLOWANCE), (7, _CHARGE))),
        (f"BR-{name}-08", f"/*/{broken}", whole, f"The taxable amount of category {code} is that of its lines, allowances and charges"),
        (f"BR-{name}-09", f"/*/{broken}", amount, f"The VAT amount of category {code}"),
        (f"BR-{name}-10", f"/*/{broken}", reason if rates in ("zero", "none") and code != "Z" else f"not({reason})", f"Category {code} and the reason of an exemption"),
    ]


_VAT_CODE = "[cac:TaxScheme/normalize-space(cbc:ID) = 'VAT']/cbc:ID/normalize-space(.)"
#: What many rules ask of a document, found once: VAT categories of lines, allowances, charges and the breakdown, and whether the seller has a tax identifier.
LETS = [
    ("of_lines", f"/*/{_LINES}/cac:Item/cac:ClassifiedTaxCategory{_VAT_CODE}"),
    ("of_allowances", f"/*/{_ALLOWANCE}/cac:TaxCategory{_VAT_CODE}"),
    ("of_charges", f"/*/{_CHARGE}/cac:TaxCategory{_VAT_CODE}"),
    ("of_breakdown", f"/*/cac:TaxTotal/cac:TaxSubtotal/cac:TaxCategory{_VAT_CODE}"),
    ("seller_taxed", f"boolean(/*/{_SELLER}/cac:PartyTaxScheme/cbc:CompanyID or /*/cac:TaxRepresentativeParty/cac:PartyTaxScheme[cac:TaxScheme/cbc:ID = 'VAT']/cbc:CompanyID)"),
]

for _row in CATEGORIES:
    RULES += _category(*_row)


RULES += [
    ("BR-O-11", ROOT, "not(cac:TaxTotal/cac:TaxSubtotal/cac:TaxCategory[normalize-space(cbc:ID) = 'O']) or count(cac:TaxTotal/cac:TaxSubtotal) = 1", "An invoice outside VAT has no other VAT breakdown"),
    ("BR-O-12", ROOT, f"not(cac:TaxTotal/cac:TaxSubtotal/cac:TaxCategory[normalize-space(cbc:ID) = 'O']) or not({_LINES}/cac:Item/cac:ClassifiedTaxCategory[normalize-space(cbc:ID) != 'O'])", "An invoice outside VAT has no line within it"),
]

#: Codes that EN 16931 takes from short lists.
CODES = {
    "invoice_type": "71 80 82 84 102 218 219 326 331 380 382 383 384 386 388 389 390 393 394 395 456 457 527 553 575 623 633 751 780 817 870 875 876 877 935",
    "credit_note_type": "81 83 261 262 296 308 381 396 420 458 502 503 532",
    "vat_category": "AE E S Z G O K L M B",
    "vat_point": "3 35 432",
    "payment_means": "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 70 74 75 76 77 78 91 92 93 94 95 96 97 98 ZZZ",
    "allowance_reason": "41 42 60 62 63 64 65 66 67 68 70 71 88 95 100 102 103 104 105",
    "mime": "application/pdf image/png image/jpeg text/csv application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.oasis.opendocument.spreadsheet",
    "currency": "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWL",
}
#: Where codes of a list stand: (rule, list, places); an attribute that is missing is the schema's matter. Lists that are not in CODES are the caller's: country, unit, scheme, endpoint, item_scheme, classification, charge_reason, exemption.
LISTED = (
    ("BR-CL-01", "invoice_type", "cbc:InvoiceTypeCode"), ("BR-CL-01", "credit_note_type", "cbc:CreditNoteTypeCode"), ("BR-CL-03", "currency", "cbc:Amount/@currencyID | cbc:BaseAmount/@currencyID | cbc:PriceAmount/@currencyID | cbc:TaxAmount/@currencyID | cbc:TaxableAmount/@currencyID | cbc:LineExtensionAmount/@currencyID | cbc:TaxExclusiveAmount/@currencyID | cbc:TaxInclusiveAmount/@currencyID | cbc:AllowanceTotalAmount/@currencyID | cbc:ChargeTotalAmount/@currencyID | cbc:PrepaidAmount/@currencyID | cbc:PayableRoundingAmount/@currencyID | cbc:PayableAmount/@currencyID"),
    ("BR-CL-04", "currency", "cbc:DocumentCurrencyCode"), ("BR-CL-05", "currency", "cbc:TaxCurrencyCode"), ("BR-CL-06", "vat_point", "cac:InvoicePeriod/cbc:DescriptionCode"), ("BR-CL-10", "scheme", "cac:PartyIdentification/cbc:ID/@schemeID"), ("BR-CL-11", "scheme", "cac:PartyLegalEntity/cbc:CompanyID/@schemeID"),
    ("BR-CL-13", "classification", "cac:CommodityClassification/cbc:ItemClassificationCode/@listID"), ("BR-CL-14", "country", "cac:Country/cbc:IdentificationCode"), ("BR-CL-15", "country", "cac:OriginCountry/cbc:IdentificationCode"), ("BR-CL-16", "payment_means", "cac:PaymentMeans/cbc:PaymentMeansCode"),
    ("BR-CL-17", "vat_category", "cac:TaxCategory/cbc:ID"), ("BR-CL-18", "vat_category", "cac:ClassifiedTaxCategory/cbc:ID"), ("BR-CL-19", "allowance_reason", "cac:AllowanceCharge[cbc:ChargeIndicator = 'false']/cbc:AllowanceChargeReasonCode"), ("BR-CL-20", "charge_reason", "cac:AllowanceCharge[cbc:ChargeIndicator = 'true']/cbc:AllowanceChargeReasonCode"),
    ("BR-CL-21", "item_scheme", "cac:StandardItemIdentification/cbc:ID/@schemeID"), ("BR-CL-22", "exemption", "cbc:TaxExemptionReasonCode"), ("BR-CL-23", "unit", "cbc:InvoicedQuantity/@unitCode | cbc:CreditedQuantity/@unitCode | cbc:BaseQuantity/@unitCode"), ("BR-CL-24", "mime", "cbc:EmbeddedDocumentBinaryObject/@mimeCode"),
    ("BR-CL-25", "endpoint", "cbc:EndpointID/@schemeID"), ("BR-CL-26", "scheme", "cac:DeliveryLocation/cbc:ID/@schemeID"),
)


def code_list_rules(lists: dict[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """Rules for each list that is known: those of CODES and the caller's, given as codes with blanks between them."""
    known, out = CODES | (lists or {}), []
    for rule, name, context in LISTED:
        if name in known:
            codes, at = ", ".join(f"'{c}'" for c in known[name].split()), re.search("/(@[A-Za-z]+)", context)
            test = f"not({at[1]}) or normalize-space({at[1]}) = ({codes})" if at else f"normalize-space(.) = ({codes})"
            out.append((rule, context.replace(f"/{at[1]}", "") if at else context, test, f"The code is one of the list {name.replace('_', ' ')}"))
    return out


def core_rules(id: str = "en16931-ubl", lists: dict[str, str] | None = None) -> Ruleset:
    """The rule set, with the caller's code lists; every rule is a pattern of its own, so no rule takes nodes from another."""
    namespaces = {k: NS[k] for k in ("ubl", "cn", "cac", "cbc")}
    patterns = [[Rule(context, [], [Assertion(name, "fatal", test, False, [("text", message)], 0)])] for name, context, test, message in RULES + code_list_rules(lists)]
    return Ruleset(id, namespaces, LETS, [], patterns)
