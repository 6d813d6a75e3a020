"""Source mixing: reruns, small sources, the tree of shards and awkward tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from billprism.llm import mixing

COLUMNS = ["id", "t", "size", "source_size", "target", "taken"]


def mixed(df, **options):
    out = mixing.mix(df, **options).select(F.col("row.doc_id").alias("id"), F.col("row.text").alias("t"), "size", "source_size", "target", "taken")
    return sorted(map(tuple, out.collect()), key=repr)


def test_reruns_agree_for_repeated_and_null_ids_in_any_partitioning(spark):
    rows = [(7 if i % 2 else None, " ".join(["w"] * (i % 5)) + f" x{i}", "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixed(df.repartition(n)) for n in (1, 2, 5)] + [mixed(df.orderBy(F.desc("text")).coalesce(1))]
    assert all(r == runs[0] for r in runs) and len(runs[0]) == 60


@pytest.mark.parametrize("words", [(1,), (1, 1), (2, 3, 3), (1, 40, 700), (7, 1, 2, 900)])
def test_small_sources_are_not_rounded_away(spark, words):
    rows = [(i, " ".join(["w"] * n), f"s{i}") for i, n in enumerate(words)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sum(g[5] for g in got) == pytest.approx(sum(words), abs=len(words))
    assert all(abs(g[5] - g[4]) <= 1 + 0.02 * g[4] and g[5] <= 3 * g[2] for g in got)


def test_quotas_are_those_of_one_seat_at_a_time():
    rng = np.random.default_rng(8)
    for _ in range(300):
        sizes = {f"s{i}": int(rng.integers(1, 400)) for i in range(rng.integers(1, 7))}
        target = mixing.targets(sizes)
        block = mixing.block_size(target)
        most = {s: -(-3 * n // block) for s, n in sizes.items()}
        want = dict.fromkeys(target, 0)
        for _ in range(min(round(sum(sizes.values()) / block), sum(most.values()))):
            s = max((s for s in sorted(target) if want[s] < most[s]), key=lambda s: target[s] / (2 * want[s] + 1))
            want[s] += 1
        assert mixing.source_blocks(sizes, target, block) == want


def test_tree_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 4)
    monkeypatch.setattr(mixing, "FAN_OUT_BITS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), ["hot", "hot", "rare", None][int(rng.integers(4))]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(df)
    taken, target = collections.Counter(), {}
    for (i, t, size, _, goal, n) in got:
        taken[rows[i][2]] += n
        target[rows[i][2]] = goal
        assert size == len(t.split()) and n <= 3 * size
    assert mixing.shard_bits(300) > 4 and all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target)


def test_long_text_ties_empty_table_and_clashing_columns(spark):
    kind = "doc_id long, text string, source string, size int, taken string, _src string, _shard long, q int, n_chars long"
    rows = [(1, "long " * 50_000, "a", 0, "x", "y", 9, 1, 2), (1, "long " * 50_000, "a", 0, "x", "y", 9, 1, 2), (2, "b", "", 0, "x", "y", 9, 1, 2), (3, None, None, 0, "x", "y", 9, 1, 2), (None, " \t", None, 0, "x", "y", 9, 1, 2)]
    df = spark.createDataFrame(rows, kind)
    got = mixed(df)
    assert [g[2] for g in got if g[0] == 1] == [50_000, 50_000] and all(g[5] == 0 for g in got if g[2] == 0)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {r["n_chars"] == len(r["text"]) for r in out.select("n_chars", "text").collect()} == {True}
    assert mixing.mix(df.filter("false")).count() == 0 and mixing.mixed_documents(df.filter("false")).count() == 0
    other = mixing.mixed_documents(df.withColumnRenamed("text", "body"), text_col="body")
    assert sum(len(r["body"].split()) for r in other.collect()) == sum(g[5] for g in got)
