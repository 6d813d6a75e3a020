"""Column functions with the semantics that invoice rules expect of values: exact decimals, strict lexical forms, half-up rounding.

Each takes and returns Columns and stays inside Catalyst. A missing value is null going in; functions that never miss (``nspace``, ``concat``)
return '' for it, casts return null, and predicates return false, so no null reaches a filter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of XML: space, tab, line feed, carriage return.
BLANKS = r"[ \t\n\r]+"
DECIMAL = r"^[ \t\n\r]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\n\r]*$"
INTEGER = r"^[ \t\n\r]*[+-]?[0-9]+[ \t\n\r]*$"
DOUBLE = r"^[ \t\n\r]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)[ \t\n\r]*$"
DATE = r"^[ \t\n\r]*-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?[ \t\n\r]*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def true(c: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(c, F.lit(False))


def text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def nspace(c) -> Column:
    return F.trim(F.regexp_replace(text(c), BLANKS, " "))


def nonempty(c) -> Column:
    return nspace(c) != ""


def substring_before(c, mark: str) -> Column:
    at = F.instr(text(c), F.lit(mark))
    return F.when(at > 1, F.substring(text(c), F.lit(1), at - 1)).otherwise("")


def substring_after(c, mark: str) -> Column:
    """'' where the mark does not occur."""
    at = F.instr(text(c), F.lit(mark))
    return F.when(at > 0, F.substring(text(c), at + len(mark), F.length(text(c)))).otherwise("")


def substring(c, start, length=None) -> Column:
    """From position ``start``, both numbers (or Columns of doubles) rounded half up; positions before 1 count towards the length, and NaN gives ''."""
    number = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    whole = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x + 0.5).cast("double"))
    end = (F.length(text(c)) + 1).cast("double")
    first = whole(number(start))
    after = end if length is None else first + whole(number(length))
    begin, stop = F.greatest(F.lit(1.0), first), F.least(end, after)
    fits = ~F.isnan(first) & ~F.isnan(after) & (begin < stop)
    return F.when(fits, F.substring(text(c), begin.cast("int"), (stop - begin).cast("int"))).otherwise("")


def translate(c, source: str, target: str) -> Column:
    """Character by character; characters without a counterpart go, and the first mapping of a character wins."""
    first = list(dict.fromkeys(source))
    pairs = [(s, target[source.index(s)] if source.index(s) < len(target) else "") for s in first]
    kept = [p for p in pairs if p[1]] + [p for p in pairs if not p[1]]
    return F.translate(text(c), "".join(s for s, _ in kept), "".join(t for _, t in kept))


_NAME_CLASSES = {"i": "\\p{L}_:", "c": "\\p{L}\\p{M}\\p{Nd}_:.\\-·"}


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The character class at ``pattern[i]`` in Java's dialect, and where it ends. What is subtracted becomes a look ahead."""
    j, body, less = i + 1, "", ""
    negated = pattern[j : j + 1] == "^"
    j += negated
    while j < len(pattern) and pattern[j] != "]":
        if pattern.startswith("-[", j):
            inner, j = _class(pattern, j + 1)
            less += f"(?!{inner})"
        elif pattern[j] == "\\" and j + 1 < len(pattern):
            nxt = pattern[j + 1]
            body += _NAME_CLASSES[nxt] if nxt in "ic" else f"[^{_NAME_CLASSES[nxt.lower()]}]" if nxt in "IC" else pattern[j : j + 2]
            j += 2
        else:
            body += "\\" + pattern[j] if pattern[j] in "[&" else pattern[j]
            j += 1
    base = f"[{'^' * negated}{body}]"
    return (f"(?:{less}{base})" if less else base), j + 1


def regex(pattern: str, flags: str = "", end: str = "\\z") -> str:
    """An XPath pattern in Java's dialect: $ only at the very ``end``, name classes and subtracted classes written out, flags up front."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(f"[{'^' * nxt.isupper()}{_NAME_CLASSES[nxt.lower()]}]" if nxt in "icIC" else ch + nxt)
            i += 2
        elif ch == "[":
            found, i = _class(pattern, i)
            out.append(found)
        else:
            out.append(end if ch == "$" and "m" not in flags else ch)
            i += 1
    return (f"(?{''.join(sorted(set(flags)))})" if flags else "") + "".join(out)


def matches(c, pattern: str, flags: str = "") -> Column:
    return text(c).rlike(regex(pattern, flags))


def replace(c, pattern: str, by: str, flags: str = "") -> Column:
    """ValueError FORX0004, before any job runs, where ``by`` has a $ without a digit or a backslash before anything but these two."""
    if not re.fullmatch(r"(?:[^\\$]|\\[\\$]|\$[0-9])*", by, re.S):
        raise ValueError(f"FORX0004: {by} is no replacement")
    return F.regexp_replace(text(c), F.lit(regex(pattern, flags)), F.lit(by))


def tokenize(c, pattern: str, flags: str = "") -> Column:
    """Parts between matches, empty ones too; no parts of ''."""
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.split(text(c), regex(pattern, flags), -1))


def string_join(items: Column, by: str) -> Column:
    return F.array_join(items, by)


def codepoints(c) -> Column:
    return F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), F.ascii)


def from_codepoints(items: Column) -> Column:
    return F.array_join(F.transform(items, F.chr), "")


def compare(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


# ---------------------------------------------------------------- numbers and dates


def decimal(c, precision: int = 38, scale: int = 10) -> Column:
    """null where the lexical form is not a decimal's (no exponents) or does not fit."""
    return F.when(text(c).rlike(DECIMAL), F.regexp_replace(text(c), BLANKS, "").try_cast(f"decimal({precision},{scale})"))


def integer(c) -> Column:
    return F.when(text(c).rlike(INTEGER), F.regexp_replace(text(c), BLANKS, "").try_cast("decimal(38,0)"))


def number(c) -> Column:
    """double; NaN where the value is none."""
    plain = F.regexp_replace(F.regexp_replace(text(c), BLANKS, ""), "INF", "Infinity")
    return F.when(text(c).rlike(DOUBLE), plain.try_cast("double")).otherwise(F.lit(float("nan")))


def date(c) -> Column:
    """The day, whatever its zone; null where the form is not strictly zero-padded."""
    return F.when(text(c).rlike(DATE), F.regexp_extract(text(c), r"([0-9]{4,}-[0-9]{2}-[0-9]{2})", 1).try_cast("date"))


def castable(c, kind: str) -> Column:
    cast = {"decimal": decimal, "integer": integer, "date": date}[kind]
    return cast(c).isNotNull()


def round_half_up(c, places: int = 0) -> Column:
    """Half goes towards positive infinity."""
    by = 10**places
    return F.floor(col(c) * by + F.lit(0.5).cast("decimal(2,1)")) / by if places else F.floor(col(c) + F.lit(0.5).cast("decimal(2,1)"))


def cents(c) -> Column:
    """Whole cents of a decimal amount, rounded half up."""
    return F.floor(col(c) * F.lit(100) + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def two_decimals(c) -> Column:
    """Whether the lexical form has two decimal places at most."""
    return F.length(substring_after(c, ".")) <= 2


# ---------------------------------------------------------------- sequences


def distinct_values(items: Column) -> Column:
    """By value: numbers that are equal are one, whatever their form."""
    key = F.transform(items, lambda x: F.coalesce(decimal(x).cast("string"), x))
    return F.filter(items, lambda x, i: F.array_position(key, F.element_at(key, i + 1)) == i + 1)


def any_pair(left: Column, right: Column, op) -> Column:
    """General comparison: some item of each side that compare true; false if a side is empty."""
    return true(F.exists(left, lambda a: true(F.exists(right, lambda b: true(op(a, b))))))


def every(items: Column, test) -> Column:
    return true(F.forall(items, lambda x: true(test(x))))


def some(items: Column, test) -> Column:
    return true(F.exists(items, lambda x: true(test(x))))


def index_of(items: Column, value) -> Column:
    found = F.transform(items, lambda x, i: F.when(x == value, i + 1))
    return F.filter(found, lambda x: x.isNotNull())


def subsequence(items: Column, start: int, length: int | None = None) -> Column:
    return F.slice(items, max(1, start), F.lit(length + min(0, start - 1)) if length is not None else F.size(items))


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


# ---------------------------------------------------------------- check digits


def letters_as_digits(c) -> Column:
    """A to Z as 10 to 35, digits as they are, everything else dropped."""
    chars = F.filter(F.split(F.upper(text(c)), ""), lambda x: x.rlike("^[0-9A-Z]$"))
    return F.array_join(F.transform(chars, lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string"))), "")


def mod97(digits: Column) -> Column:
    """Remainder of a digit string of any length, folded digit by digit."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda x: x != ""), F.lit(0), lambda r, d: (r * 10 + d.cast("int")) % 97)


def iban_ok(c) -> Column:
    """Shape and remainder 1 of an IBAN; blanks are ignored."""
    bare = F.regexp_replace(F.upper(text(c)), BLANKS, "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    return bare.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\z") & (mod97(letters_as_digits(turned)) == 1)


#: Coarse part of 2 to 12 digits, optional fine part of up to 30 letters and digits, two check digits.
LEITWEG = r"^([0-9]{2,12})(-([A-Za-z0-9]{1,30}))?-([0-9]{2})\z"


def leitweg_parts(c) -> Column:
    bare = F.regexp_replace(text(c), r"^\s+|\s+\z", "")
    part = lambda n: F.regexp_extract(bare, LEITWEG, n)
    return F.when(bare.rlike(LEITWEG), F.struct(part(1).alias("coarse"), F.nullif(part(3), F.lit("")).alias("fine"), part(4).alias("check")))


def leitweg_check_digits(coarse, fine) -> Column:
    """98 minus the remainder of the digits followed by 00, in two digits."""
    body = F.concat(letters_as_digits(coarse), letters_as_digits(F.coalesce(col(fine), F.lit(""))), F.lit("00"))
    return F.lpad((98 - mod97(body)).cast("string"), 2, "0")


def leitweg_ok(c) -> Column:
    parts = leitweg_parts(c)
    whole = F.concat(parts["coarse"], F.coalesce(parts["fine"], F.lit("")), parts["check"])
    return true(mod97(letters_as_digits(whole)) == 1)


#: A line of payment terms about a cash discount or interest; a telephone number; an e-mail address; a web address.
SKONTO = r"^#(SKONTO|VERZUG)#TAGE=[0-9]+#PROZENT=[0-9]+\.[0-9]{2}(#BASISBETRAG=-?[0-9]+\.[0-9]{2})?#$"
PHONE = r"([^0-9]*[0-9]){3}"
MAIL = r"^[^@\s.]([^@\s]*[^@\s.])?@[^@\s.]([^@\s]*[^@\s.])?$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+([/?#]\S*)?$"


def skonto_ok(c) -> Column:
    """Whether each line that begins with # is a complete one."""
    marked = F.filter(tokenize(c, r"\r?\n"), lambda x: F.startswith(nspace(x), F.lit("#")))
    return every(marked, lambda x: matches(nspace(x), SKONTO))


def phone_ok(c) -> Column:
    return matches(c, PHONE)


def mail_ok(c) -> Column:
    return matches(nspace(c), MAIL)


def url_ok(c) -> Column:
    return matches(nspace(c), URL)


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
