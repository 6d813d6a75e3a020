"""Tree navigation as joins: every axis is a predicate between a context node n and a target m of one document.

Nodes carry preorder numbers: ``pre``, ``last_pre`` (the highest number in the node's subtree) and ``parent_pre``. All joins have the document as
their equi-key; child, parent, attribute and the sibling axes have the parent as a second one, so only the true range axes compare ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVERSE = {"ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent"}


def predicate(axis: str, n: str = "n", m: str = "m") -> Column:
    c = lambda a, x: F.col(f"{a}.{x}")
    plain = c(m, "kind") != "attribute"
    return {
        "self": c(m, "pre") == c(n, "pre"),
        "child": (c(m, "parent_pre") == c(n, "pre")) & plain,
        "attribute": (c(m, "parent_pre") == c(n, "pre")) & ~plain,
        "parent": c(m, "pre") == c(n, "parent_pre"),
        "descendant": (c(m, "pre") > c(n, "pre")) & (c(m, "pre") <= c(n, "last_pre")) & plain,
        "descendant-or-self": (c(m, "pre") == c(n, "pre")) | ((c(m, "pre") > c(n, "pre")) & (c(m, "pre") <= c(n, "last_pre")) & plain),
        "ancestor": (c(m, "pre") < c(n, "pre")) & (c(m, "last_pre") >= c(n, "last_pre")) & plain,
        "ancestor-or-self": (c(m, "pre") == c(n, "pre")) | ((c(m, "pre") < c(n, "pre")) & (c(m, "last_pre") >= c(n, "last_pre")) & plain),
        "following-sibling": (c(m, "parent_pre") == c(n, "parent_pre")) & (c(m, "pre") > c(n, "pre")) & plain & (c(n, "kind") != "attribute"),
        "preceding-sibling": (c(m, "parent_pre") == c(n, "parent_pre")) & (c(m, "pre") < c(n, "pre")) & plain & (c(n, "kind") != "attribute"),
        "following": (c(m, "pre") > c(n, "last_pre")) & plain,
        "preceding": (c(m, "last_pre") < c(n, "pre")) & plain,
    }[axis]


def _above(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of the ancestor axis, as step has them: what holds a node's parent is found once a parent, as many nodes have one parent and pairs of all nodes grow with the square."""
    up = context.filter("parent_pre IS NOT NULL").select("doc_id", "parent_pre").distinct()
    holds = (F.col("m.pre") <= F.col("u.parent_pre")) & (F.col("m.last_pre") >= F.col("u.parent_pre")) & (F.col("m.kind") != "attribute")
    up = up.alias("u").join(nodes.alias("m"), (F.col("u.doc_id") == F.col("m.doc_id")) & holds).select(F.col("u.doc_id").alias("_doc"), F.col("u.parent_pre").alias("_up"), F.struct("m.*").alias("m"))
    joined = context.alias("n").join(up, (F.col("n.doc_id") == F.col("_doc")) & (F.col("n.parent_pre") == F.col("_up")))
    return joined.select(F.struct("n.*").alias("n"), "m")


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Column | None = None) -> DataFrame:
    """Pairs: the context's columns as struct n, the targets' as struct m. ``test`` is a Column over m, such as F.col("m.local") == "ID"."""
    if axis in ("ancestor", "ancestor-or-self"):
        pairs = _above(context, nodes)
        if axis == "ancestor-or-self":
            pairs = pairs.unionByName(step(context, nodes, "self"))
        return pairs if test is None else pairs.filter(test)
    joined = context.alias("n").join(nodes.alias("m"), (F.col("n.doc_id") == F.col("m.doc_id")) & predicate(axis))
    if test is not None:
        joined = joined.filter(test)
    return joined.select(F.struct("n.*").alias("n"), F.struct("m.*").alias("m"))


def count_following_siblings(nodes: DataFrame) -> DataFrame:
    """Each node that has following siblings among nodes: doc_id, pre, their number n and the first one's first_pre; one sorted pass, as pairs grow with the square.

    Attributes and nodes without a parent have no siblings and are none.
    """
    own = Window.partitionBy("doc_id", "parent_pre").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.filter("kind <> 'attribute' AND parent_pre IS NOT NULL").withColumns({"n": F.count("*").over(own), "first_pre": F.min("pre").over(own)})
    return out.filter("n > 0").select("doc_id", "pre", "n", "first_pre")


def positions(pairs: DataFrame, axis: str) -> DataFrame:
    """Adds ``position`` and ``last`` of each target among its context's; reverse axes count backwards."""
    own = Window.partitionBy("n.doc_id", "n.pre")
    order = F.col("m.pre").desc() if axis in REVERSE else F.col("m.pre").asc()
    return pairs.withColumns({"position": F.row_number().over(own.orderBy(order)), "last": F.count("*").over(own)})


def all_differ(nodes: DataFrame, value: str, within: tuple[str, ...] = ("doc_id", "parent_pre")) -> DataFrame:
    """Whether no node has the value of a sibling before it: ``within`` and all_differ. Grouped by value first, so a value that many nodes share is counted where they are."""
    per = nodes.groupBy(*within, value).agg(F.count("*").alias("n"))
    return per.groupBy(*within).agg((F.max("n") == 1).alias("all_differ"))


def nodes_of(pairs: DataFrame) -> DataFrame:
    """The targets as a node sequence: each node once."""
    return pairs.select("m.*").dropDuplicates(["doc_id", "pre"])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["doc_id", "pre"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi").dropDuplicates(["doc_id", "pre"])


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["doc_id", "pre"], "left_anti").dropDuplicates(["doc_id", "pre"])
