"""Counting forms of axes against their pairs."""

import time

from pyspark.sql import functions as F

from billprism import catalog
from billprism.operators import axes

SCHEMA = "doc_id long, pre long, last_pre long, parent_pre long, kind string, local string"


def nodes(spark):
    rows = [(d, 0, 9, None, "element", "r") for d in (1, 2)] + [(d, p, p, 0, "attribute" if p == 1 else "element", "x") for d in (1, 2) for p in range(1, 6 + d)] + [(1, 8, 8, 7, "element", "y"), (1, 9, 9, 7, "element", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def test_count_following_siblings(spark):
    pairs = axes.step(nodes(spark), nodes(spark), "following-sibling").groupBy("n.doc_id", "n.pre").agg(F.count("*").alias("n"), F.min("m.pre").alias("first_pre"))
    got = sorted(map(tuple, axes.count_following_siblings(nodes(spark)).collect()))
    assert got == sorted(map(tuple, pairs.collect())) and len(got) == 10


def test_following_sibling_query_runs_the_operator(spark, monkeypatch):
    monkeypatch.setattr(catalog, "geography", lambda spark, sf_dir: nodes(spark).withColumn("local", F.lit("customer")))
    called = []
    real = axes.count_following_siblings
    monkeypatch.setattr(axes, "count_following_siblings", lambda n: called.append(1) or real(n))
    assert catalog.queries()["axis_following_sibling"](spark, "").count() == 10 and called


def test_ancestors_of_a_wide_document(spark):
    """100,000 siblings of one document: found once a parent, not by pairs of all nodes."""
    n = 100_000
    leaf = spark.range(n).selectExpr("1L as doc_id", "id + 2 as pre", "id + 2 as last_pre", "1L as parent_pre", "'element' as kind", "'x' as local")
    top = spark.createDataFrame([(1, 0, n + 1, None, "document", ""), (1, 1, n + 1, 0, "element", "top")], SCHEMA)
    nodes = leaf.unionByName(top)
    began = time.time()
    for axis, per, least in (("ancestor", 2, 0), ("ancestor-or-self", 3, 0)):
        got = axes.step(nodes.filter("local = 'x'"), nodes, axis).agg(F.count("*").alias("n"), F.min("m.pre").alias("least"), F.count_distinct("n.pre").alias("of")).first()
        assert tuple(got) == (per * n, least, n)
    assert time.time() - began < 60
