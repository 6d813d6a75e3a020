"""Registered queries of the XPath evaluator: each order as a small invoice, each operator as an expression on it, beside the same value in SQL.

Lines of an invoice stand in the order of their numbers. A row is (doc_id, key, value); values are text, several items joined by ``|``.
"""

from __future__ import annotations

from .catalog import HEADERS, invoices_xml, query
from .plans.detect import NS

#: One row an invoice: ids and amounts (cents) of its lines in document order, and the header's total.
_BASE = f"""WITH {HEADERS}, d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS k, any_value(line_total) AS total, any_value(line_sum) AS s, count(*) AS n, list(line_no ORDER BY line_no) AS ids, list(net ORDER BY line_no, printf('%d.%02d', net // 100, net % 100)) AS nets
FROM l JOIN h USING (doc_id) GROUP BY doc_id)"""
_NS = {k: NS[k] for k in ("ubl", "cac", "cbc")}
_LINE, _AMOUNT = "/ubl:Invoice/cac:InvoiceLine", "cbc:LineExtensionAmount"


def _money(c: str) -> str:
    return f"printf('%d.%02d', ({c}) // 100, ({c}) % 100)"


def _text(test: str) -> str:
    return f"CASE WHEN {test} THEN 'true' ELSE 'false' END"


def _whole(c: str) -> str:
    return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


def _joined(items: str, by: str = ",") -> str:
    return f"coalesce(list_aggregate({items}, 'string_agg', '{by}'), '')"


def _xpath(name: str, expressions: dict[str, tuple[str, str]], variables: dict | None = None) -> None:
    def run(spark, sf_dir):
        from .plans.paths import evaluate

        return evaluate(invoices_xml(spark, sf_dir), {k: e for k, (e, _) in expressions.items()}, _NS, variables)

    run.__doc__ = "; ".join(expressions)
    query(_BASE + " " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, {sql} AS value FROM d" for k, (_, sql) in expressions.items()), f"xpath_{name}")(run)


_xpath("paths", {
    "path": (f"count({_LINE}/cbc:ID)", _whole("n")),
    "name_anywhere": (f"count(//{_AMOUNT})", _whole("n + 1")),
    "attribute_anywhere": ("count(//@currencyID)", _whole("n + 1")),
    "function_step": (f"sum({_LINE}/cbc:ID/string-length(.))", _whole("list_sum(list_transform(ids, lambda x: length(CAST(x AS VARCHAR))))")),
    "any_prefix": ("count(//*:ID)", _whole("n + 1")),
    "any_local": ("count(//cbc:*)", _whole("2 + 2 * n")),
    "text_nodes": ("count(//text())", _whole("2 + 2 * n")),
    "elements": ("count(//*)", _whole("4 + 3 * n")),
    "element_test": ("count(//element(cbc:ID))", _whole("n + 1")),
    "nodes": ("count(//node())", _whole("6 + 5 * n")),
    "no_comments": ("count(//comment()) + count(//processing-instruction())", "'0'"),
    "root": (f"count(root({_LINE}[1])/ubl:Invoice) + count(/)", "'2'"),
    "parent": (f"local-name({_LINE}[1]/cbc:ID/..)", "'InvoiceLine'"),
    "each_node_once_in_order": (f"string-join(({_LINE}[last()] | {_LINE}[1] | {_LINE}[1])/cbc:ID, ',')", "CASE WHEN n = 1 THEN CAST(ids[1] AS VARCHAR) ELSE ids[1] || ',' || ids[n] END"),
})

_xpath("axes", {
    "following_sibling": (f"count({_LINE}[1]/following-sibling::cac:InvoiceLine)", _whole("n - 1")),
    "preceding_sibling": (f"count({_LINE}[last()]/preceding-sibling::*)", _whole("n + 1")),
    "ancestor": (f"string-join({_LINE}[1]/cbc:ID/ancestor::*/local-name(), '/')", "'Invoice/InvoiceLine'"),
    "ancestor_or_self": (f"count({_LINE}[1]/cbc:ID/ancestor-or-self::node())", "'4'"),
    "descendant": ("count(/ubl:Invoice/descendant::cbc:LineExtensionAmount)", _whole("n + 1")),
    "descendant_or_self": ("count(/ubl:Invoice/descendant-or-self::*)", _whole("4 + 3 * n")),
    "following": ("count(/ubl:Invoice/cbc:ID/following::cbc:ID)", _whole("n")),
    "preceding": (f"count({_LINE}[last()]/preceding::cbc:ID)", _whole("n")),
    "self": (f"count({_LINE}/self::cac:InvoiceLine) + count({_LINE}/self::cbc:ID)", _whole("n")),
    "attribute": (f"string-join(distinct-values({_LINE}/{_AMOUNT}/attribute::currencyID), ',')", "'EUR'"),
})

_xpath("predicates", {
    "value": (f"count({_LINE}[xs:decimal({_AMOUNT}) > 20000])", _whole("len(list_filter(nets, lambda x: x > 2000000))")),
    "position": (f"string({_LINE}[2]/cbc:ID)", "coalesce(CAST(ids[2] AS VARCHAR), '')"),
    "last": (f"string({_LINE}[last()]/cbc:ID)", "CAST(ids[n] AS VARCHAR)"),
    "position_function": (f"count({_LINE}[position() > 1])", _whole("n - 1")),
    "last_function": (f"string-join({_LINE}[position() = last() - 1]/cbc:ID, ',')", "coalesce(CAST(CASE WHEN n > 1 THEN ids[n - 1] END AS VARCHAR), '')"),
    "reverse_axis_position": (f"string({_LINE}[last()]/preceding-sibling::cac:InvoiceLine[1]/cbc:ID)", "coalesce(CAST(CASE WHEN n > 1 THEN ids[n - 1] END AS VARCHAR), '')"),
    "context_item": ("count(//cbc:ID[. = '1'])", _whole("len(list_filter(ids, lambda x: x = 1)) + CASE WHEN k = 1 THEN 1 ELSE 0 END")),
    "per_parent": ("count(//cbc:ID[1])", _whole("n + 1")),
    "first_of_all": (f"string((//{_AMOUNT})[1])", _money("total")),
    "nested": (f"count({_LINE}[{_AMOUNT}[@currencyID = 'EUR']])", _whole("n")),
    "two": (f"count({_LINE}[{_AMOUNT} > 100][2])", _whole("CASE WHEN len(list_filter(nets, lambda x: x > 10000)) > 1 THEN 1 ELSE 0 END")),
    "item_of_sequence": ("(10, 20, 30)[2]", "'20'"),
})

_xpath("sequences", {
    "constructor": (f"count((1, 2, {_LINE}, ()))", _whole("n + 2")),
    "if": (f"if (count({_LINE}) > 3) then 'many' else 'few'", "CASE WHEN n > 3 THEN 'many' ELSE 'few' END"),
    "and": (f"count({_LINE}) > 2 and count({_LINE}) < 6", _text("n > 2 AND n < 6")),
    "or": (f"count({_LINE}) = 1 or count({_LINE}) = 7", _text("n = 1 OR n = 7")),
    "range": (f"sum(1 to count({_LINE}))", _whole("n * (n + 1) // 2")),
    "empty_range": ("count(2 to 1)", "'0'"),
    "for": (f"string-join(for $i in 1 to count({_LINE}) return string($i * $i), ',')", _joined("list_transform(range(1, n + 1), lambda i: CAST(i * i AS VARCHAR))")),
    "some": (f"some $a in {_LINE}/{_AMOUNT} satisfies xs:decimal($a) > 50000", _text("list_max(nets) > 5000000")),
    "every": (f"every $a in {_LINE}/{_AMOUNT} satisfies xs:decimal($a) > 5000", _text("list_min(nets) > 500000")),
    "variable": (f"count({_LINE}[xs:decimal({_AMOUNT}) > $limit])", _whole("len(list_filter(nets, lambda x: x > 3000000))")),
    "reverse": (f"string-join(reverse({_LINE}/cbc:ID/string(.)), ',')", _joined("list_transform(list_reverse(ids), lambda x: CAST(x AS VARCHAR))")),
    "subsequence": (f"string-join(subsequence({_LINE}/cbc:ID, 2, 2), ',')", _joined("list_transform(ids[2:3], lambda x: CAST(x AS VARCHAR))")),
    "index_of": (f"string-join(for $i in index-of({_LINE}/cbc:ID/string(.), '3') return string($i), ',')", _joined("list_transform(list_filter(range(1, n + 1), lambda i: ids[i] = 3), lambda i: CAST(i AS VARCHAR))")),
    "distinct": (f"count(distinct-values({_LINE}/cbc:ID))", _whole("list_unique(ids)")),
    "exists_empty": (f"exists({_LINE}[99]) , empty({_LINE}[2]), not({_LINE}[3]), boolean({_LINE}[4])", f"'false|' || {_text('n < 2')} || '|' || {_text('n < 3')} || '|' || {_text('n >= 4')}"),
    "exactly_one": (f"string(exactly-one({_LINE})/cbc:ID)", "CASE WHEN n = 1 THEN CAST(ids[1] AS VARCHAR) ELSE '!FORG0005' END"),
    "zero_or_one": (f"count(zero-or-one({_LINE}[position() > 1]))", "CASE WHEN n <= 2 THEN CAST(n - 1 AS VARCHAR) ELSE '!FORG0003' END"),
    "one_or_more": (f"count(one-or-more({_LINE}[position() > 1]))", "CASE WHEN n > 1 THEN CAST(n - 1 AS VARCHAR) ELSE '!FORG0004' END"),
    "deep_equal": (f"deep-equal({_LINE}/cbc:ID, reverse({_LINE}/cbc:ID))", _text("ids = list_reverse(ids)")),
    "instance_of": (f"1 instance of xs:integer, 1.5 instance of xs:integer, 'a' instance of xs:string, {_LINE}[1] instance of element()", "'true|false|true|true'"),
    "treat_as": (f"count({_LINE} treat as element()+)", _whole("n")),
}, {"limit": [30000]})

_xpath("arithmetic", {
    "plus_minus": (f"xs:integer((sum({_LINE}/{_AMOUNT}/xs:decimal(.)) + 1 - 0.5) * 100)", _whole("s + 50")),
    "exact_decimal": ("0.1 + 0.2 = 0.3", "'true'"),
    "times": (f"xs:integer(xs:decimal({_LINE}[1]/{_AMOUNT}) * 100)", _whole("nets[1]")),
    "div": (f"count({_LINE}) div 4 * 100", _whole("n * 25")),
    "idiv": (f"count({_LINE}) idiv 2", _whole("n // 2")),
    "mod": (f"count({_LINE}) mod 3", _whole("n % 3")),
    "signs": (f"-count({_LINE}) + +1", _whole("1 - n")),
    "div_by_zero": ("1 div 0", "'!FOAR0001'"),
    "empty_operand": (f"count({_LINE}[99]/{_AMOUNT} + 1)", "'0'"),
    "abs": (f"abs(3 - count({_LINE}))", _whole("abs(3 - n)")),
    "floor": (f"floor(xs:decimal({_LINE}[1]/{_AMOUNT}))", _whole("nets[1] // 100")),
    "ceiling": (f"ceiling(xs:decimal({_LINE}[1]/{_AMOUNT}))", _whole("(nets[1] + 99) // 100")),
    "round_half_up": (f"round(xs:decimal({_LINE}[1]/{_AMOUNT}) div 2 * 10 * 10) ", _whole("(nets[1] + 1) // 2")),
    "round_half_even": (f"round-half-to-even(xs:decimal({_LINE}[1]/{_AMOUNT}) * 50)", _whole("CASE WHEN nets[1] % 2 = 0 THEN nets[1] // 2 WHEN (nets[1] // 2) % 2 = 0 THEN nets[1] // 2 ELSE nets[1] // 2 + 1 END")),
    "avg": (f"xs:integer(avg({_LINE}/cbc:ID/xs:integer(.)) * count({_LINE}) + 0.5)", _whole("list_sum(ids)")),
    "min_max": (f"xs:integer(min({_LINE}/{_AMOUNT}/xs:decimal(.)) * 100), xs:integer(max({_LINE}/{_AMOUNT}/xs:decimal(.)) * 100)", f"{_whole('list_min(nets)')} || '|' || {_whole('list_max(nets)')}"),
    "sum_of_none": (f"sum({_LINE}[99]/{_AMOUNT})", "'0'"),
    "number": (f"number({_LINE}[1]/cbc:ID) * 2, number('x')", _whole("ids[1] * 2") + " || '|NaN'"),
})

_xpath("comparisons", {
    "general_over_sequences": (f"{_LINE}/cbc:ID = ('3', '5')", _text("list_contains(ids, 3) OR list_contains(ids, 5)")),
    "general_not_equal": (f"{_LINE}/cbc:ID != '1'", _text("len(list_filter(ids, lambda x: x <> 1)) > 0")),
    "general_with_none": (f"{_LINE}[99]/cbc:ID = {_LINE}/cbc:ID", "'false'"),
    "general_numbers": (f"{_LINE}/{_AMOUNT} > 40000", _text("list_max(nets) > 4000000")),
    "value_eq": (f"string({_LINE}[1]/cbc:ID) eq '1'", _text("ids[1] = 1")),
    "value_of_none": (f"count({_LINE}[99]/cbc:ID eq '1')", "'0'"),
    "value_of_many": (f"{_LINE}/cbc:ID eq '1'", f"CASE WHEN n = 1 THEN {_text('ids[1] = 1')} ELSE '!XPTY0004' END"),
    "value_order": ("2 lt 10, '2' lt '10', xs:date('2024-01-31') lt xs:date('2024-02-01')", "'true|false|true'"),
    "untyped_as_number": ("/ubl:Invoice/cbc:ID > 99", _text("k > 99")),
    "is": (f"({_LINE})[1] is {_LINE}[1], ({_LINE})[1] is ({_LINE})[last()]", f"'true|' || {_text('n = 1')}"),
    "before": (f"{_LINE}[1] << {_LINE}[last()], {_LINE}[1]/cbc:ID >> /ubl:Invoice/cbc:ID", f"{_text('n > 1')} || '|true'"),
    "effective_boolean": (f"boolean('') , boolean('a'), boolean(0), boolean({_LINE})", "'false|true|false|true'"),
    "castable": ("'1e3' castable as xs:decimal, '1.50' castable as xs:decimal, '2024-02-30' castable as xs:date, '2024-02-29' castable as xs:date, 'x' castable as xs:integer", "'false|true|false|true|false'"),
    "cast_error": ("xs:decimal('1e3')", "'!FORG0001'"),
    "intersect_except": (f"count({_LINE} intersect {_LINE}[position() > 2]), count({_LINE} except {_LINE}[1]), count({_LINE}[1] union {_LINE}[last()])", f"{_whole('greatest(n - 2, 0)')} || '|' || {_whole('n - 1')} || '|' || {_whole('least(n, 2)')}"),
})

_ID = "string(/ubl:Invoice/cbc:ID)"
_xpath("strings", {
    "constants": ("true(), false()", "'true|false'"),
    "string_data": (f"string({_LINE}[1]/{_AMOUNT}), data({_LINE}[1]/cbc:ID)", f"{_money('nets[1]')} || '|' || ids[1]"),
    "contains": (f"contains({_ID}, '7'), starts-with({_ID}, '1'), ends-with({_ID}, '5')", f"{_text(chr(39) + '7' + chr(39) + ' <> ' + chr(39) + chr(39) + ' AND contains(doc_id, ' + chr(39) + '7' + chr(39) + ')')} || '|' || {_text('starts_with(doc_id, ' + chr(39) + '1' + chr(39) + ')')} || '|' || {_text('ends_with(doc_id, ' + chr(39) + '5' + chr(39) + ')')}"),
    "concat": (f"concat('INV-', {_ID}, '/', count({_LINE}))", "'INV-' || doc_id || '/' || n"),
    "substring": (f"substring({_ID}, 2), substring({_ID}, 0, 3), substring({_ID}, 1.5, 2.6), substring({_ID}, number('x'))", "substr(doc_id, 2) || '|' || substr(doc_id, 1, 2) || '|' || substr(doc_id, 2, 3) || '|'"),
    "before_after": (f"substring-before({_LINE}[1]/{_AMOUNT}, '.'), substring-after({_LINE}[1]/{_AMOUNT}, '.'), substring-after({_ID}, '.')", "CAST(nets[1] // 100 AS VARCHAR) || '|' || printf('%02d', nets[1] % 100) || '|'"),
    "case": ("upper-case('Straße é'), lower-case('ÀB')", "'STRASSE É|àb'"),
    "translate": (f"translate({_ID}, '0123', 'abc')", "translate(doc_id, '0123', 'abc')"),
    "string_join": (f"string-join({_LINE}/cbc:ID, '+')", _joined("list_transform(ids, lambda x: CAST(x AS VARCHAR))", "+")),
    "codepoints": (f"codepoints-to-string(reverse(string-to-codepoints({_ID})))", "reverse(doc_id)"),
    "compare": ("compare('a', 'b'), compare('b', 'a'), compare('a', 'a')", "'-1|1|0'"),
    "normalize_space": ("normalize-space(concat('  a ', ' b '))", "'a b'"),
    "string_length": (f"string-length({_ID})", "CAST(length(doc_id) AS VARCHAR)"),
    "matches": (f"matches({_ID}, '^[0-9-[13579]]+$'), matches('x:y', '^\\i\\c*$'), matches('9', '^\\I$'), matches('AB', 'ab', 'i')", f"{_text('regexp_full_match(doc_id, ' + chr(39) + '[02468]+' + chr(39) + ')')} || '|true|true|true'"),
    "replace": (f"replace({_ID}, '([0-9])$', '-$1'), replace('a.b', '\\.', '\\$')", "regexp_replace(doc_id, '([0-9])$', '-\\1') || '|a$b'"),
    "bad_replacement": ("replace('a', 'a', '$')", "'!FORX0004'"),
    "tokenize": (f"string-join(tokenize({_LINE}[1]/{_AMOUNT}, '\\.'), ','), count(tokenize('', ','))", "nets[1] // 100 || ',' || printf('%02d', nets[1] % 100) || '|0'"),
    "names": (f"name({_LINE}[1]), local-name({_LINE}[1]), namespace-uri(/*), name(/*)", f"'cac:InvoiceLine|InvoiceLine|{NS['ubl']}|Invoice'"),
    "dates": ("year-from-date(xs:date('2024-02-29')), current-date() instance of xs:date", "'2024|true'"),
    "current": (f"count({_LINE}[count(current()/ubl:Invoice) = 1])", _whole("n")),
    "unknown_function": ("nothing-like-it(1)", "'!XPST0017'"),
    "syntax_error": ("1 +", "'!XPST0003'"),
})
