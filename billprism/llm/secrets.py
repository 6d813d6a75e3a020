"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams of lower-cased text: every match needs all of some alternative's
trigrams, for every clause. The index holds a posting (trigram, document) for each trigram that some rule asks for. Postings that meet in
a document are counted by alternative, complete alternatives make clauses, complete clauses candidates, and only candidates are
searched by the expression. A rule without a mandatory trigram has no query, and every text is searched for it.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums, stash, text_or_empty
from .ngram_join import keyed


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Least length of a group; matches below it are dropped after the search.
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules in the order that breaks ties, then the further ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)

#: Strings that one position may stand for before the query is closed there.
EXACT_MOST = 64


def _choices(item) -> set[str] | None:
    """The lower-cased strings that an item of a parsed expression matches, if they are few."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is C.SUBPATTERN:
        return _exact(arg[3])
    if op is C.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        one = _exact(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for n in range(arg[1] + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
        return out if len(out) <= EXACT_MOST else None
    return None


def _exact(items) -> set[str] | None:
    out = {""}
    for item in items:
        own = _choices(item)
        if own is None or len(out) * len(own) > EXACT_MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Clauses, all of which a match needs; a clause is alternatives, of one of which it holds every trigram. Empty: no mandatory trigram."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def walk(items) -> None:
        held = {""}
        for item in items:
            own = _choices(item)
            if own is not None and len(held) * len(own) <= EXACT_MOST:
                held = {a + b for a in held for b in own}
                continue
            close(held)
            held = {""} if own is None else own
            op, arg = item
            if own is None and op is C.SUBPATTERN:
                walk(arg[3])
            elif own is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        close(held)

    walk(P.parse(regex))
    return clauses


def postings(docs: DataFrame, trigrams: list[str], key: str = "__key", text: str = "t") -> DataFrame:
    """The inverted index for the trigrams asked for: (trigram, key), a row for each text that holds it."""
    held = docs.select(key, F.lower(text).alias("_low"))
    hits = F.array_compact(F.array(*(F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return held.select(F.explode(hits).alias("trigram"), key)


def candidates(index: DataFrame, rules=RULES, key: str = "__key") -> DataFrame:
    """(key, rules: bits of the rules whose query the text meets), by intersecting postings; texts that meet none are absent.

    The broadcast plan has a row for each trigram of each alternative of the rules.
    """
    rows = [(r, c, a, t, len(alt)) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.regex)) for a, alt in enumerate(clause) for t in sorted(alt)]
    need = {r: len(trigram_query(rule.regex)) for r, rule in enumerate(rules)}
    plan = index.sparkSession.createDataFrame(rows, "rule int, clause int, alt int, trigram string, n int")
    met = index.join(F.broadcast(plan), "trigram").groupBy(key, "rule", "clause", "alt", "n").agg(F.count("*").alias("k")).filter("k = n")
    met = met.groupBy(key, "rule").agg(F.count_distinct("clause").alias("k"))
    whole = F.array(*(F.lit(need[r]) for r in range(len(rules))))
    return met.filter(F.col("k") == F.element_at(whole, F.col("rule") + 1)).groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rule"))).alias("rules"))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches in code points, end exclusive."""
    pattern = F.lit(rule.regex)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)

    def placed(m):
        starts = running_sums(F.transform(m["all"], lambda _, i: (F.element_at(m["gap"], i + 1) + F.coalesce(F.get(m["all"], i - 1), F.lit(0))).cast("long")))
        at = F.transform(F.arrays_zip(starts.alias("start"), m["all"].alias("n"), m["own"].alias("own")), lambda x: F.struct(x["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), (x["start"] + x["n"]).cast("int").alias("end"), x["own"].alias("own")))
        return F.transform(F.filter(at, lambda x: x["own"] >= rule.least), lambda x: F.struct(x["start"], x["rank"], x["end"]))

    return let(F.struct(lengths(0).alias("all"), lengths(rule.group).alias("own"), gaps.alias("gap")), placed)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Null texts are empty. Matches are leftmost and do not overlap within a kind; spans of different kinds may. A repeated row, or one of
    repeated or null id, is scanned for itself. An empty table gives no rows.
    """
    own = keyed(docs, id_col)
    texts = own.select("__key", F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for alt in clause for t in alt})
    index = stash(postings(texts, trigrams), "postings")
    flags = candidates(index, rules)
    at = texts.join(flags, "__key", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    columns = {}
    for r, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        if query:
            here = F.col("rules").bitwiseAND(F.lit(1 << r)) != 0
        else:
            here = F.col("t").rlike(rule.regex)
        columns[f"_s{r}"] = F.when(here, spans(F.col("t"), rule, r)).otherwise(empty)
    at = at.select("doc_id", *(c.alias(n) for n, c in columns.items()))
    names = F.array(*(F.lit(r.kind) for r in rules))

    def joined(which: list[int]) -> Column:
        every = F.array_sort(F.flatten(F.array(*(F.col(f"_s{r}") for r in which))))
        return F.array_join(F.transform(every, lambda m: F.concat_ws(":", F.element_at(names, m["rank"] + 1), m["start"], m["end"])), ",")

    base = [r for r, rule in enumerate(rules) if rule.base]
    counts = [F.size(f"_s{r}").cast("long").alias(f"n_{rules[r].kind}") for r in base]
    every = joined(list(range(len(rules))))
    return at.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), every.alias("spans"), sum((F.size(f"_s{r}") for r in range(len(rules))), F.lit(0)).cast("long").alias("n_spans"))


def oracle_sql(rules=RULES) -> str:
    """The same spans by plain search, in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for r, rule in enumerate(rules):
        total = lambda a: f"coalesce(list_sum(list_transform({a}, lambda y: length(y))), 0)"
        own = f"regexp_extract_all(t, {quote(rule.regex)}, {rule.group})"
        parts.append(
            f"""SELECT k, {r} AS rank, '{rule.kind}' AS kind, {total("p[1:i]")} + {total("m[1:i-1]")} AS s, {total("p[1:i]")} + {total("m[1:i]")} AS e
FROM (SELECT k, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, {quote(rule.regex)}) AS m, string_split_regex(t, {quote(rule.regex)}) AS p, {own} AS g FROM d)) WHERE length(g[i]) >= {rule.least}"""
        )
    base = ", ".join(str(r) for r, rule in enumerate(rules) if rule.base)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {r}) AS n_{rule.kind}" for r, rule in enumerate(rules) if rule.base)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)})
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans, count(rank) AS n_spans
FROM d LEFT JOIN hits USING (k) GROUP BY d.k"""
