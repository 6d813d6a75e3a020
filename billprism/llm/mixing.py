"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of equally many words. Blocks go to sources, then within a source down a tree of shards, FAN_OUT to a
node, by the highest quotients target / (2 * blocks + 1). In a shard the documents stand in a seeded order, end to end; the shard's
blocks are whole passes over that line and then a run of blocks from a seeded start, so a document yields whole
copies and at most one part.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: A word: anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks that the smallest target holds at least, for which blocks are made smaller.
BLOCK_WORDS, LEAST_BLOCKS = 16, 64
#: A shard has about so many documents at most; shards of one node of the tree, whose quotas one task apportions, as bits of the shard's number.
SHARD_DOCS, FAN_OUT_BITS = 512, 10
MOST_REPEATS = 3


def targets(sizes: dict, weights=(1, 2, 3), most: int = MOST_REPEATS) -> dict:
    """Each source's share of all words by weight, at most ``most`` times its size, the excess reshared by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, per = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / per for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(x) for s, x in {**capped, **share}.items()}
        capped |= {s: most * sizes[s] for s in over}


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats for each entry by the highest quotients vote / (2 * seats + 1), none above its own most; ties to the earlier one."""
    seats = min(seats, sum(most))
    got = lambda d: [min(m, max(0, math.ceil((v / d - 1) / 2))) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    low, high = 0.0, 2.0 * (max(votes, default=0.0) or 1.0) + 1.0  # at d = high nobody has a seat
    for _ in range(200):
        mid = (low + high) / 2
        if sum(got(mid)) <= seats:
            high = mid
        else:
            low = mid
    out = got(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, m) in enumerate(zip(votes, out, most, strict=True)) if n < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def shard_bits(n: int) -> int:
    """Bits of the shard numbers of n documents."""
    return max(0, math.ceil(math.log2(max(1, n / SHARD_DOCS))))


def block_size(target: dict, most: int = BLOCK_WORDS) -> int:
    """Words of a block: ``most``, or so few that LEAST_BLOCKS fit into the smallest target that is not 0, so that no source is rounded away."""
    filled = [t for t in target.values() if t > 0]
    return max(1, min(most, int(min(filled) // LEAST_BLOCKS))) if filled else most


def source_blocks(sizes: dict, target: dict, block: int) -> dict:
    """Blocks of each source by Sainte-Laguë; no source gets more than MOST_REPEATS times its size, its last block then being a part."""
    order = sorted(target, key=lambda s: (s is None, (s or "").encode()))
    seats = round(sum(sizes.values()) / block)
    return dict(zip(order, sainte_lague([target[s] for s in order], seats, [math.ceil(MOST_REPEATS * sizes[s] / block) for s in order]), strict=True))


_SOURCE = ["_src", "_null"]


def _shard_quotas(shards: DataFrame, quotas: DataFrame, bits: int, block: int) -> DataFrame:
    """shards (source, _shard, n words), quotas (source, q blocks) -> source, _shard, n, q: down the tree, each node's blocks are apportioned to its children."""

    def apportion(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_node")
        got = sainte_lague(rows["n"].tolist(), int(rows["q"].iloc[0]), [-(-MOST_REPEATS * n // block) for n in rows["n"].tolist()])
        return rows.assign(q=got)[[*_SOURCE, "_node", "n", "q"]]

    above, depth = quotas.withColumn("_parent", F.lit(0).cast("long")), 0
    while True:
        step = min(FAN_OUT_BITS, bits - depth)
        depth += step
        node = F.shiftright("_shard", bits - depth).cast("long")
        level = shards.groupBy(*_SOURCE, node.alias("_node")).agg(F.sum("n").alias("n")).withColumn("_parent", F.shiftright("_node", step).cast("long"))
        found = level.join(above, [*_SOURCE, "_parent"]).groupBy(*_SOURCE, "_parent").applyInPandas(apportion, "_src string, _null boolean, _node long, n long, q long")
        if depth == bits:
            return found.withColumnRenamed("_node", "_shard")
        above = found.select(*_SOURCE, F.col("_node").alias("_parent"), "q")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """A row per document: row (its columns, or those named in ``keep``), size, source_size, target, taken, part_from, part_words.

    ``taken`` counts words, repeats included, and is ``copies * size + part_words``; the part begins at word
    ``part_from``. No document gives more than three times its size. Null or blank texts have size 0 and give nothing; null is a
    source of its own, last in order. An empty table gives no rows. One row a source is the only thing the driver sees. Ids may be null or repeat: order and shard
    come from id and text, so rows that agree in id, source and text are interchangeable, and reruns agree however the table is partitioned.
    """
    spark = docs.sparkSession
    bits = shard_bits(docs.count())
    sized = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        F.col(source_col).isNull().alias("_null"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_order"),
        F.xxhash64(F.lit(seed + 1), F.col(text_col), F.col(id_col)).alias("_next"),
    ).withColumn("_shard", F.pmod(F.col("_order"), F.lit(1 << bits)).cast("long"))
    shards = stash(sized.groupBy(*_SOURCE, "_shard").agg(F.sum("size").alias("n")), "shards")
    sizes = {None if r["_null"] else r["_src"]: r["n"] for r in shards.groupBy(*_SOURCE).agg(F.sum("n").alias("n")).collect()}
    target = targets(sizes) if sizes else {}
    block = block_size(target, block_words)
    blocks = source_blocks(sizes, target, block)
    by_source = spark.createDataFrame([(s or "", s is None, sizes[s], target[s], blocks[s]) for s in target], "_src string, _null boolean, source_size long, target double, q long")
    quotas = _shard_quotas(shards, by_source.select(*_SOURCE, "q"), bits, block).join(by_source.select(*_SOURCE, "source_size", "target"), _SOURCE)
    quotas = quotas.select(*_SOURCE, "_shard", "source_size", "target", F.col("n").alias("_line"), F.least(F.col("q") * block, F.col("n") * MOST_REPEATS).alias("_words"))
    line = Window.partitionBy(*_SOURCE, "_shard").orderBy("_order", "_next", "size")
    placed = sized.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = placed.join(quotas, [*_SOURCE, "_shard"])
    begin, size, full = F.col("_end") - F.col("size"), F.col("size"), F.col("_full")
    at = at.withColumn("_full", F.when(F.col("_line") > 0, F.floor(F.col("_words") / F.greatest("_line", F.lit(1)))).otherwise(0).cast("long")).withColumn("_rest", F.col("_words") - F.col("_full") * F.col("_line"))
    n_blocks = F.greatest(F.floor(F.col("_line") / block), F.lit(1))
    at = at.withColumn("_from", (F.pmod(F.xxhash64("_src", "_shard", F.lit(seed)), n_blocks) * block).cast("long")).withColumn("_to", F.col("_from") + F.col("_rest"))
    ahead = F.greatest(F.lit(0), F.least("_end", F.col("_to")) - F.greatest(begin, F.col("_from")))
    around = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_to") - F.col("_line")) - begin)
    # Where a document holds both ends of the run, its two parts are one count; the part starts at the later one.
    at = at.withColumn("part_words", (ahead + around).cast("long")).withColumn("part_from", F.when(ahead > 0, F.greatest(F.lit(0), F.col("_from") - begin)).otherwise(0).cast("long"))
    return at.select("row", "size", "source_size", "target", (full * size + F.col("part_words")).cast("long").alias("taken"), F.col("_full").alias("copies"), "part_from", "part_words")


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as rows of docs: whole copies, and for a part a row whose text is the words of that part.

    A column ``n_chars`` follows the text. Documents that give no words, null and blank ones among them, give no row.
    """
    got = mix(docs, text_col=text_col, **options).filter("taken > 0")
    whole_text = F.col("row").getField(text_col)
    words = F.regexp_extract_all(whole_text, F.lit(f"({WORD})"), F.lit(1))
    whole = F.array_repeat(F.struct(F.lit(-1).cast("long").alias("from"), F.lit(0).cast("long").alias("n")), F.col("copies").cast("int"))
    part = F.when(F.col("part_words") > 0, F.array(F.struct(F.col("part_from").alias("from"), F.col("part_words").alias("n")))).otherwise(F.array())
    out = got.select("row", F.explode(F.concat(whole, part)).alias("piece"))
    # words are taken cyclically, which covers a document that holds both ends of its shard's run
    cyclic = F.concat(F.slice(words, (F.col("piece.from") + 1).cast("int"), F.col("piece.n").cast("int")), F.slice(words, F.lit(1), F.greatest(F.lit(0), F.col("piece.from") + F.col("piece.n") - F.size(words)).cast("int")))
    text = F.when((F.col("piece.from") < 0) | (F.col("piece.n") == F.size(words)), whole_text).otherwise(F.array_join(cyclic, " "))
    fields = []
    for name in docs.columns:
        if name == text_col:
            fields.append(text.alias(name))
        elif name == "n_chars":
            fields.append(F.length(text).cast(docs.schema[name].dataType).alias("n_chars"))
        else:
            fields.append(F.col("row").getField(name).alias(name))
    return out.select(*fields)
