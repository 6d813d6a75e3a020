"""The command line: output, languages and exit codes."""

import json

import pytest
from invoices import pdf, ubl
from pyspark.sql import functions as F

from billprism import catalog_engine, cli

EN, EXTENDED = "urn:cen.eu:en16931:2017", "urn:cen.eu:en16931:2017#conformant#urn:factur-x.eu:1p0:extended"
RULES = """<schema xmlns="http://purl.oclc.org/dsdl/schematron"><ns prefix="cbc" uri="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"/>
<pattern><rule context="/*"><assert id="NUMBER" test="cbc:ID != 'bad'">a good number</assert><assert id="SOON" flag="warning" test="cbc:ID != 'late'">in time</assert></rule></pattern></schema>"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    for name, text in {"good.xml": ubl(spec=EN), "bad.xml": ubl(spec=EN, number="bad"), "late.xml": ubl(spec=EN, number="late"), "own-ubl.sch": RULES, "odd.xml": "<a>\n</b>", "leitweg.xml": ubl(spec=EN, reference="04011000-12345-04")}.items():
        (folder / name).write_text(text, "utf-8")
    (folder / "empty.pdf").write_bytes(b"%PDF-1.7\n")
    (folder / "hybrid.pdf").write_bytes(pdf(ubl(spec=EN)))
    return folder


def run(files, capsys, *words):
    code = cli.main([str(files / w) if "." in w and not w.startswith("-") and "=" not in w else w for w in words])
    return code, capsys.readouterr().out


def test_exit_codes(files, capsys):
    own = ("--rules", "own-ubl.sch", "--rule-sets", "own")
    assert run(files, capsys, "validate", "good.xml", *own)[0] == cli.OK
    assert run(files, capsys, "validate", "good.xml", "bad.xml", *own)[0] == cli.INVALID
    assert run(files, capsys, "validate", "late.xml", *own)[0] == cli.OK
    assert run(files, capsys, "validate", "late.xml", "--warnings-as-errors", *own)[0] == cli.INVALID
    code, out = run(files, capsys, "validate", "missing.xml", "good.xml", *own)
    assert code == cli.ERROR and "cannot be read" in out and "good.xml: valid" in out
    assert run(files, capsys, "validate", "good.xml", "--rules", "own-ubl.sch", "--rule-sets", "nothing")[0] == cli.ERROR
    assert run(files, capsys, "validate")[0] == run(files, capsys, "validate", "good.xml", "--strange")[0] == run(files, capsys, "strange")[0] == run(files, capsys)[0] == cli.ERROR
    assert run(files, capsys, "--version") == (cli.OK, "0.1.0\n")


def test_languages_and_quiet(files, capsys):
    own = ("--rules", "own-ubl.sch", "--rule-sets", "own")
    code, out = run(files, capsys, "validate", "bad.xml", "leitweg.xml", *own)
    assert "  error   NUMBER (line 2): a good number [/Invoice]" in out and "  warning SUM-LEITWEG: The buyer reference" in out
    out = run(files, capsys, "validate", "bad.xml", "leitweg.xml", "--lang", "de", *own)[1]
    assert "ungültig" in out and "  Fehler  NUMBER (Zeile 2)" in out and "  Warnung SUM-LEITWEG: Die Käuferreferenz" in out
    out = run(files, capsys, "validate", "bad.xml", "good.xml", "--quiet", "--no-leitweg", *own)[1]
    assert len(out.splitlines()) == 2 and out.splitlines()[0].endswith("bad.xml: invalid (EN 16931)")
    lines = [json.loads(x) for x in run(files, capsys, "validate", "bad.xml", "odd.xml", "--json", *own)[1].splitlines()]
    assert [x["errors"][0]["rule_id"] for x in lines] == ["NUMBER", "SUM-XML"] and lines[0]["errors"][0]["location"] == "/Invoice"


def test_extract_leitweg_and_rules(files, capsys):
    code, out = run(files, capsys, "extract", "hybrid.pdf")
    assert code == cli.OK and out.strip().startswith("<?xml") and "</Invoice>" in out
    assert run(files, capsys, "extract", "empty.pdf")[0] == run(files, capsys, "extract", "gone.pdf")[0] == cli.ERROR
    assert cli.main(["leitweg", "04011000-12345-03"]) == cli.OK and cli.main(["leitweg", "04011000-12345-04"]) == cli.INVALID
    capsys.readouterr()
    code, out = run(files, capsys, "rules", "--json")
    sets = {json.loads(x)["rule_set"] for x in out.splitlines()}
    assert code == cli.OK and sets == {"en16931-ubl", "en16931-cii", "xrechnung-ubl", "xrechnung-cii"}


def test_schema_option(files, capsys, tmp_path):
    from billprism.catalog import SCHEMAS

    for name, text in SCHEMAS.items():
        (tmp_path / name).write_text(text, "utf-8")
    own = ("--rules", "own-ubl.sch", "--rule-sets", "own", "--no-leitweg")
    assert "SUM-XSD" in run(files, capsys, "validate", "good.xml", "--schema", f"ubl={tmp_path}/main.xsd", *own)[1]
    assert run(files, capsys, "validate", "good.xml", "--schema", f"ubl={tmp_path}/main.xsd", "--no-schema", *own)[0] == cli.OK
    assert run(files, capsys, "validate", "good.xml", "--schema", "main", *own)[0] == cli.ERROR


def test_one_document_that_breaks_a_rule_set_costs_no_other(spark):
    from billprism.plans.schematron import Ruleset, check

    def broken(focus, a):
        if a[0] == "2":
            raise KeyError("own")
        return [True]

    text = """<schema xmlns="http://purl.oclc.org/dsdl/schematron"><ns prefix="f" uri="urn:f"/><pattern><rule context="/a"><assert id="A" test="f:own(string(.))">a</assert><assert id="B" test="false()">b</assert></rule></pattern></schema>"""
    docs = spark.createDataFrame([(str(i), f"<a>{i}</a>") for i in range(4)], "doc_id string, xml string")
    found = check(docs, [Ruleset.from_text(text, "own")], functions={("{urn:f}own", 1): broken}).select("doc_id", "rule_id").collect()
    assert sorted(map(tuple, found)) == [("0", "B"), ("1", "B"), ("2", "SUM-RULESET"), ("3", "B")]


def test_places_among_many_siblings_are_linear():
    import time

    from billprism.sources.shred import location, parse

    def seconds(n):
        doc = parse("<a>" + "<b/>" * n + "</a>")
        began = time.process_time()
        assert location(doc.children[0].children[-1]) == f"/a/b[{n}]"
        for b in doc.children[0].children:
            location(b)
        return time.process_time() - began

    assert seconds(40_000) < 40 * max(seconds(4000), 0.005)


def test_stream_releases_what_it_keeps(spark, tmp_path):
    from billprism.plans.schematron import Ruleset
    from billprism.streaming import validation

    source = tmp_path / "in"
    source.mkdir()
    for i in range(6):
        (source / f"{i}.xml").write_text(ubl(spec=EN, number="bad" if i % 2 else str(i)), "utf-8")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    query = validation.start(validation.stream_files(spark, str(source), 2), [Ruleset.from_text(RULES, "en16931-ubl")], str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert spark.read.parquet(f"{tmp_path}/out/findings").filter("rule_id = 'NUMBER'").count() == 3 and spark.read.parquet(f"{tmp_path}/out/results").count() == 6


def test_results_carry_the_xml_if_asked(spark):
    from billprism.api import Options, validate

    docs = catalog_engine.as_docs(spark.createDataFrame([("1", ubl(spec=EXTENDED))], "doc_id string, xml string"))
    found = validate(docs, [], Options(include_xml=True, lang="de"))
    row = found.results.first()
    assert row["xml"].startswith("<?xml") and "Warnungen" in row["infos"][0]["message"]
    found.close()


def test_replacement_errors_are_told_before_a_job():
    from billprism.functions import xp

    for by in ("$", "a$b", "\\x", "$x"):
        with pytest.raises(ValueError, match="FORX0004"):
            xp.replace(F.lit("a"), "a", by)
