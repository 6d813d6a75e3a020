"""Awkward tables for every operator: repeated and null ids, empty and very long texts, ties, columns that are named like a result's, empty tables."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from billprism.llm import ann, exact_dedup, langid, licenses, mixing, ngram_join, packing, quality, secrets, substr_dedup

#: Columns named like the operators' results and like their inner columns.
CLASH = ["component_id", "piece", "offset", "sequence_id", "score", "rejected", "lang_pred", "predicted", "n_assign", "families", "keep_id", "_src", "__key", "t", "n", "rank", "cell"]


def clashing(spark, rows, empty=False):
    """rows (doc_id, text, lang, source) with the CLASH columns behind them."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("own"))
    return df.filter("false") if empty else df


LONG = "token=abcdef1 " + "word " * 60_000 + "Licensed under the MIT license"
ROWS = [(1, "token=abcdef1 twice here", "en", "a"), (1, "token=abcdef1 twice here", "en", "a"), (1, "another text of the same id", "en", "a"), (None, "an id that is null", "en", "b"), (None, "an id that is null", "en", None), (2, "", "de", "b"), (3, None, None, None), (4, LONG, "en", "a"), (5, LONG, "en", "c"), (6, " \n\t ", "en", "c")]

RUNS = {
    "op1": lambda d: exact_dedup.exact_dedup(d), "op3": lambda d: secrets.scan_secrets(d), "op4": lambda d: licenses.scan_licenses(d), "op5": lambda d: substr_dedup.substring_dedup(d),
    "op6": lambda d: mixing.mix(d, keep=["doc_id"]).select("row.doc_id", "size", "taken"), "op7": lambda d: ngram_join.ngram_components(d), "op8": lambda d: packing.pack(d),
    "op9": lambda d: langid.identify(d, langid.learn(d)), "op10": lambda d: quality.quality(d, d.select("doc_id", F.lit(1).alias("quality")), F.lit(True)),
}


@pytest.fixture(scope="module")
def awkward(spark):
    return clashing(spark, ROWS).repartition(3).cache()


@pytest.mark.parametrize("name", RUNS)
def test_rows_of_awkward_tables(spark, awkward, name):
    got = RUNS[name](awkward).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    assert set(ids) == {1, 2, 3, 4, 5, 6, None}
    if name == "op8":
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and sum(r["piece"] == 0 for r in got) == len(ROWS)
    else:
        assert ids == collections.Counter(r[0] for r in ROWS)
    assert RUNS[name](clashing(spark, ROWS, empty=True)).count() == 0


def test_results_of_awkward_tables(awkward):
    by = lambda rows, *c: sorted((r["doc_id"] or 0, *(r[x] for x in c)) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = by(RUNS["op1"](awkward).collect(), "group_size", "kept")
    assert [x for x in one if x[0] in (4, 5)] == [(4, 2, False), (5, 2, True)] and sum(x[2] for x in one if x[0] == 1) == 2 and [x[2] for x in one if x[0] == 3] == [True]
    three = by(RUNS["op3"](awkward).collect(), "n_assign", "base_sha256")
    assert [x for x in three if x[0] == 1] == sorted([(1, 0, sha("")), (1, 1, sha("assign:0:13")), (1, 1, sha("assign:0:13"))]) and [x[1] for x in three if x[0] == 4] == [1]
    four = by(RUNS["op4"](awkward).collect(), "families")
    assert [x[1] for x in four if x[0] in (4, 5)] == ["MIT", "MIT"] and {x[1] for x in four if x[0] not in (4, 5)} == {""}
    five = by(RUNS["op5"](awkward).collect(), "n_bytes", "n_removed")
    assert all(x[1] == x[2] == len(LONG) for x in five if x[0] in (4, 5)) and all(x[2] == 0 for x in five if x[0] not in (4, 5))
    seven = by(RUNS["op7"](awkward).collect(), "n_shingles", "component_id")
    assert [x for x in seven if x[0] in (4, 5)] == [(4, seven[-3][1], 4), (5, seven[-3][1], 4)] and [x[1] for x in seven if x[0] in (2, 3, 6)] == [0, 0, 0]
    nine = RUNS["op9"](awkward).collect()
    assert {r["lang_pred"] for r in nine if not (r["text"] or "").strip()} == {langid.UNKNOWN} and all(r["rejected"] for r in nine if r["lang_pred"] == langid.UNKNOWN)


def test_equal_dictionaries_tie(spark):
    """Two languages learned from equal texts tie on every text: the commoner one is named, and the row is rejected."""
    texts = [f"the same words again and again in number {i}" for i in range(30)]
    rows = [(i, t, lang, None) for i, t in enumerate(texts) for lang in ("aa", "bb")] + [(900, "one more of these", "bb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = langid.Learned({lang: langid._dictionary(texts) for lang in ("bb", "aa")})
    got = langid.identify(df, known).select("lang_pred", "rejected", "score").distinct().collect()
    assert [(r["lang_pred"], r["rejected"], r["score"]) for r in got] == [("bb", True, 0.0)]


def test_neighbours_of_repeated_ids_and_of_unequal_lengths(spark):
    """Rows of one id are searched each, and neither finds the other; longer vectors are nearer by inner product."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert collections.Counter(r["query_id"] for r in got) == {20: 3} and {r["vec_id"] for r in got} == {1, 2, 3}
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 5.0), (2, 2, 3.0), (3, 3, 1.0)]
    wide = [(i, [math.cos(i) * (1 + i % 7), math.sin(i) * (1 + i % 7), float(i % 3)]) for i in range(200)]
    table = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    hit = 0
    for q, found in collections.Counter((r["query_id"], r["vec_id"]) for r in ann.search(table).collect()):
        want = sorted((i for i, _ in wide if i != q), key=lambda i: (-sum(a * b for a, b in zip(wide[i][1], wide[q][1], strict=True)), i))[:20]
        hit += found in want
    assert hit >= 0.9 * 20 * 10


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i % 40, f"document number {i} has words of its own, such as {i * 7} and {i * 13}, and ends here in plain prose", ["en", "de"][i % 2], ["a", "b", None][i % 3]) for i in range(80)] + ROWS[:3]
    clashing(spark, rows).write.parquet(f"{tmp_path}/full/documents.parquet")
    clashing(spark, ROWS, empty=True).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/full")
        assert docs.columns == ["doc_id", "text", "lang", "source", *CLASH], name
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").columns[:2] == ["doc_id", "piece"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
