"""Exact dedup by deterministic block naming.

Each text is cut into fixed-size byte blocks. The distinct blocks are sorted and numbered, so a block's name is an
integer that only equal blocks share; then adjacent names are paired and the distinct pairs sorted and numbered, level
by level, until one integer is left for each text. (level, name) is equal exactly where the texts are.

Only the distinct blocks carry text through a shuffle. Everything else moves names: a reference finds its block's name
through the block's 64-bit hash, and where one hash stands for several different blocks, through the block itself.
Joins on names spread each name's rows over many tasks, as a text or block may be that of a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stash, text_or_empty, unstash

#: Bytes of a block; a text of n bytes goes through log2(n / BLOCK_BYTES) levels of pairing.
BLOCK_BYTES = 4096


def _cut(block: int):
    at = F.sequence(F.lit(0), F.greatest(F.octet_length("_text") - 1, F.lit(0)), F.lit(block))
    return F.transform(at, lambda i: F.substring(F.col("_text").cast("binary"), i + 1, F.lit(block)))


def _named(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, each with an integer of its own: its place in its partition's sort order, partitions end to end."""
    return pairs.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each distinct (id, text): id, sha (lowercase hex SHA-256), copies, level, name.

    Null texts count as empty; null and repeated ids are allowed. Rows of equal id and text are one row with ``copies``.
    """
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    cut = source.select("_id", F.sha2("_text", 256).alias("_sha"), F.transform(_cut(block_bytes), lambda b: F.xxhash64(b)).alias("_hs"))
    refs = stash(cut.groupBy("_id", "_sha", "_hs").agg(F.count("*").alias("_copies")), "refs")

    blocks = source.select(F.explode(_cut(block_bytes)).alias("_block")).select(F.xxhash64("_block").alias("_h"), "_block")
    names = stash(_named(blocks, ["_block", "_h"]).select("_h", "name"), "names")
    ambiguous = names.groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h")
    level = refs.select("_id", "_sha", "_copies", F.size("_hs").alias("_left"), F.posexplode("_hs").alias("_at", "_h"))
    parts = [spread_join(level, names.join(ambiguous, "_h", "left_anti"), ["_h"], ["_id", "_at"]).drop("_h")]
    if not ambiguous.isEmpty():
        there = source.select("_id", F.sha2("_text", 256).alias("_sha"), F.posexplode(_cut(block_bytes)).alias("_at", "_block")).withColumn("_h", F.xxhash64("_block")).join(ambiguous, "_h", "left_semi").distinct()
        own = _named(there, ["_block"]).withColumn("name", -1 - F.col("name"))
        there = there.join(own, "_block").select(F.col("_id").alias("i"), F.col("_sha").alias("s"), F.col("_at").alias("a"), "name")
        hit = level.join(ambiguous, "_h", "left_semi")
        parts.append(hit.join(there, hit["_id"].eqNullSafe(there["i"]) & (hit["_sha"] == there["s"]) & (hit["_at"] == there["a"])).drop("_h", "i", "s", "a"))
    level = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    depth, done, pending = 0, [], stash(level, "level")
    unstash(refs, names)
    while True:
        done.append(pending.filter("_left = 1").select("_id", "_sha", "_copies", F.lit(depth).alias("level"), "name"))
        if (pending.agg(F.max("_left")).first()[0] or 1) == 1:
            break
        pair = (
            pending.filter("_left > 1")
            .groupBy("_id", "_sha", "_copies", "_left", F.floor(F.col("_at") / 2).cast("int").alias("_at"))
            .agg(F.max(F.when(F.col("_at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("name"))), F.lit(-(1 << 62))).alias("b"))
        )
        pair = stash(pair, "pairs")
        pending = stash(spread_join(pair, _named(pair, ["a", "b"]), ["a", "b"], ["_id", "_at"]).select("_id", "_sha", "_copies", F.ceil(F.col("_left") / 2).cast("int").alias("_left"), "_at", "name"), "level")
        unstash(pair)
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_id").alias("id"), F.col("_sha").alias("sha"), F.col("_copies").alias("copies"), "level", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (null counts as empty) form a group; the row of the largest id stays, and of rows that repeat that id
    one. Ids may be null: such a row stays only if its group has no other id. An empty table gives no rows; columns
    other than the two named ones are not read.
    """
    named = name_texts(docs, id_col, text_col, block_bytes)
    group = named.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = spread_join(named, group, ["level", "name"], ["id"])
    return rows.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        F.col("sha").alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``exact_dedup`` keeps, with all their columns."""
    result = stash(exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256"), "kept")
    own = docs.withColumn("__sha", F.sha2(text_or_empty(text_col), 256))
    out = own.join(result, own[id_col].eqNullSafe(result["doc_id"]) & (own["__sha"] == result["text_sha256"]), "left_semi")
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__sha"])
    return out.drop("__sha")
