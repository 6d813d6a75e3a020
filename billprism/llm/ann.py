"""Nearest neighbours by inner product over an inverted multi-index.

A codebook of K centroids is fitted for each half of the vectors on a bounded sample; a vector's cell is its pair of nearest centroids,
and every vector is indexed. A query visits cells in order of the summed squared distance of its halves to the two centroids, with a heap over
pairs (the multi-sequence walk), until the cells visited hold SHARE of all vectors. Entries of visited cells are ranked by
the inner product in double precision. The first half has one component more, which gives all vectors the length of the longest
and queries 0, so that the nearest by distance are those of the largest inner product, whatever the vectors' lengths.

On unit vectors in 64 dimensions without clusters a true neighbour's halves tell little, so 0.9 of the neighbours take about
half of the entries; SHARE is set by that measurement. Cells are dealt out in blocks of bounded size, and so are queries, neighbours by cell
together. A block of vectors travels to the blocks of queries that visit one of its cells, and only visited cells are multiplied.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Centroids of a half, vectors that a codebook is fitted on at most, and passes of the fit.
CENTROIDS, SAMPLE, PASSES = 32, 16_384, 10
#: Share of all vectors that a query's visited cells hold at least.
SHARE = 0.62
NEIGHBOURS = 20
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512


def fit_half(x: np.ndarray, k: int = CENTROIDS, passes: int = PASSES, seed: int = 1) -> np.ndarray:
    """k-means centroids; fewer where x has fewer different rows."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:k]].astype(np.float64)
    for _ in range(passes):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1)[None] - 2 * (x @ c.T), 1)


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, need: int) -> np.ndarray:
    """Cells (i * K2 + j) in order of one[i] + two[j], until their counts come to ``need``."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    d1, d2, k2 = one[a].tolist(), two[b].tolist(), len(two)
    rows, cols, count = a.tolist(), b.tolist(), counts
    heap, out, got = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and got < need:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * k2 + cols[j]
        out.append(cell)
        got += count[cell]
        if j + 1 < k2:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(d1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return np.array(out, np.int64)


def deal(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and the number of its blocks: cells in order, cut where a block is full; a cell larger than a block has several to itself."""
    first, parts, block, fill = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c in np.flatnonzero(counts).tolist():
        if fill and fill + counts[c] > size:
            block, fill = block + 1, 0
        first[c], parts[c] = block, -(-int(counts[c]) // size)
        block, fill = block + int(parts[c]) - 1, (fill + int(counts[c]) if parts[c] == 1 else size)
    return first, parts


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v: array<double>) that take part: finite, not zero, of the commonest dimension, with an id."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & good)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (dims["d"] if dims else 1))


def search(vectors: DataFrame, is_query=None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all rows of another id.

    Queries are the rows that ``is_query`` (a Column over ``id``) tells; by default ids divisible by 20. Ties go to the smaller
    id. Vectors that are null, zero, of another dimension or hold null or non-finite numbers take no part, nor do null ids. A row that
    repeats an id is searched with it, and neither finds the other. Fewer than k candidates are all returned.
    """
    rows = usable(vectors, id_col, vector_col)
    found = rows.select(F.xxhash64("id", "v").alias("h"), "v").orderBy("h").limit(SAMPLE).toArrow()
    if not found.num_rows:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    sample = _matrix(found["v"])
    half = sample.shape[1] // 2

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = np.sqrt(np.maximum(0, longest - (x * x).sum(1))) if math.isfinite(longest) else np.zeros(len(x))
        return np.column_stack([x[:, :half], more]), x[:, half:]

    book = [fit_half(x) for x in halves(sample)]
    k2 = len(book[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                one, two = halves(x)
                yield pa.record_batch({"id": b.column(0), "v": b.column(1), "cell": pa.array((nearest(one, book[0]) * k2 + nearest(two, book[1])).astype(np.int32))})

    index = stash(rows.mapInArrow(cells, "id long, v array<double>, cell int"), "cells")
    asks = F.col("id") % 20 == 0 if is_query is None else is_query
    counts, asking_counts = np.zeros(len(book[0]) * k2, np.int64), np.zeros(len(book[0]) * k2, np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).collect():
        counts[r["cell"]], asking_counts[r["cell"]] = r["n"], r["q"]
    total = int(counts.sum())
    need = max(math.ceil(share * total), min(total, 50 * k))
    (block_of, parts_of), asking_blocks = deal(counts, VECTOR_BLOCK), deal(asking_counts, QUERY_BLOCK)
    blocks_of = [np.arange(b, b + p) for b, p in zip(block_of, parts_of, strict=True)]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, seen, blocks = _matrix(b.column(1)), [], []
            for q in x:
                there = walk(((book[0] - np.append(q[:half], 0)) ** 2).sum(1), ((book[1] - q[half:]) ** 2).sum(1), counts, need)
                mask = np.zeros(len(counts), bool)
                mask[there] = True
                seen.append(np.packbits(mask).tobytes())
                blocks.append(np.unique(np.concatenate([blocks_of[c] for c in there if counts[c]])))
            if len(x):
                yield pa.record_batch({"id": b.column(0), "v": b.column(1), "cell": b.column(2), "visited": pa.array(seen, pa.binary()), "blocks": pa.array(blocks, pa.list_(pa.int64()))})

    queries = stash(index.filter(asks).mapInArrow(visits, "id long, v array<double>, cell int, visited binary, blocks array<long>"), "queries")

    def block(block_of: np.ndarray, parts_of: np.ndarray, seed: int):
        of = lambda a: F.element_at(F.array(*(F.lit(int(x)) for x in a)), F.col("cell") + 1)
        return of(block_of) + F.pmod(F.xxhash64("id", F.lit(seed)), of(parts_of))

    right = queries.select(F.explode("blocks").alias("vb"), block(*asking_blocks, 5).alias("qb"), "id", "v", "visited")
    pairs = right.select("vb", "qb").distinct().toDF("vb", "to").withColumnRenamed("to", "qb")
    left = index.select(block(block_of, parts_of, 3).alias("vb"), "id", "v", "cell").join(pairs, "vb")

    def rank(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and asking.num_rows:
            ids, cell, x = own["id"].to_numpy(), own["cell"].to_numpy(), _matrix(own["v"])
            # of equal vectors only the k + 1 smallest ids can be among any query's k nearest
            order = np.lexsort((ids, *x.T[::-1]))
            ids, cell, x = ids[order], cell[order], x[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
            nth = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            keep = nth <= k
            ids, cell, x = ids[keep], cell[keep], x[keep]
            q = _matrix(asking["v"])
            seen = np.stack([np.unpackbits(np.frombuffer(s, np.uint8))[: len(counts)].astype(bool) for s in asking["visited"].to_pylist()])
            visited = seen.any(0)[cell]
            ids, cell, x = ids[visited], cell[visited], x[visited]
            rough = q @ x.T
            for r, me in enumerate(asking["id"].to_pylist()):
                here = np.flatnonzero(seen[r][cell] & (ids != me))
                if not len(here):
                    continue
                s = rough[r, here]
                if len(here) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    here = here[s >= least - 1e-9 * (1 + abs(least))]
                exact = (q[r][None] * x[here]).sum(1)
                best = np.lexsort((ids[here], -exact))[:k]
                out[0] += [me] * len(best)
                out[1] += ids[here][best].tolist()
                out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    near = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(rank, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
