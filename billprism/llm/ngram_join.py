"""N-gram Jaccard join by signature trees.

A document is its set of distinct 5-word shingles. Two documents link where intersection / union is 0.8 or more.

1. Each task counts its shingles in a table of fixed size. Ordered by these counts, rarest first, two linked documents share one of
   the first n - ceil(0.8 n) + 1 shingles. The first one they share has i others before it in one of them, of n shingles, and leaves an
   overlap of n - i at most, so the other one has 9 / 4 (n - i) - n shingles at most. Other documents need no comparison.
2. What shares such a shingle at such sizes, directly or over others, is a family. Documents of equal sets are one member of it: each task first
   lets the smallest of its own copies stand for them, so a set that many documents have is a key of as many rows as there are tasks.
3. In a family a signature tree holds for each node the token bitmaps of all below it, combined by OR (with the largest count of
   each bit), and the range of their sizes. A dual traversal leaves out node pairs whose largest possible overlap is too small
   for 0.8, and pairs that are already in one component; what remains is compared exactly.
4. The members of families too large for a task meet again, by shingles that are rare among them alone: where the table of counts is small for the
   whole input, shingles of a dozen documents pass for rare and chain families, and fewer texts tell them apart. This ends once it helps no more.
5. A family that is still too large is cut into blocks. Blocks are joined with themselves, then the components' leaders, and last
   whatever lies outside the family's largest component with all blocks, so every pair that may still matter is compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_table, mix64, release, small_batches, spans_of, stash, text_buffers, text_or_empty, trim, unstash, words_of
from .graph import components

SHINGLE = 5
#: Slots of the table of shingle counts; members of a family that one task compares, and shingles that these have about at most.
SLOT_BITS, BLOCK, SHINGLES_MOST = 22, 2000, 4_000_000
#: Times that the members of large families meet again.
RECOUNTS = 4
#: Different sets that a task remembers to find copies among its own documents.
SEEN_MOST = 200_000
#: Slots that travel together; bytes of text and prefix shingles that one numpy pass holds.
SLOT_BLOCK, PASS_BYTES, PREFIX_MOST = 4096, 2 << 20, 200_000
#: Slots of the filter that keeps texts from a shuffle for the few documents that are compared again or dropped; 64 are a row of what is broadcast.
KEY_SLOTS = 1 << 24
#: Bits of a signature, children of a tree node.
BITS, FANOUT = 512, 8

_TABLE = byte_table(7)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of the texts, repeats included, and where each text's begin and end (n + 1 offsets)."""
    starts, ends, per = words_of(raw, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.ones(int(lens.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    word = mix64(np.add.reduceat(_TABLE[LOWER[raw[~SPACE[raw]]]] * powers[at], first) + lens.astype(np.uint64) * _STEP)
    ends_of = np.cumsum(per)
    begin = ends_of - per
    n = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(int(out_offs[-1])) - np.repeat(out_offs[:-1] - begin, n)
    width = np.repeat(np.minimum(per, k), n)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    acc = np.zeros(len(pos), np.uint64)
    for t in range(k):
        acc = acc * _STEP + np.where(width > t, padded[pos + t], np.uint64(t + 1))
    return mix64(acc), out_offs


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and sorted set of shingles."""
    raw, offs = text_buffers(column)
    for i, j in spans_of(offs, PASS_BYTES):
        hashes, at = shingle_hashes(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for r in range(i, j):
            yield r, np.unique(hashes[at[r - i] : at[r - i + 1]])


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, up to 255 each, in compressed blocks of SLOT_BLOCK slots."""
    total = np.zeros(1 << SLOT_BITS, np.uint32)
    for b in batches:
        raw, offs = text_buffers(b.column(0))
        for i, j in spans_of(offs, PASS_BYTES):
            h, _ = shingle_hashes(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            np.add.at(total, h >> np.uint64(64 - SLOT_BITS), 1)
    if total.any():
        blocks = np.minimum(total, 255).astype(np.uint8).reshape(-1, SLOT_BLOCK)
        yield pa.record_batch({"block": pa.array(np.arange(len(blocks), dtype=np.int32)), "n": pa.array([zlib.compress(x.tobytes(), 1) for x in blocks], pa.binary())})


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total.setdefault(k, np.zeros(SLOT_BLOCK, np.int64))
            total[k] += np.frombuffer(zlib.decompress(n), np.uint8)
    if total:
        yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "n": pa.array([np.minimum(x, 1 << 30).astype(np.int32).tobytes() for x in total.values()], pa.binary())})


def slot_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Shingles of the whole table by slot; the table has 2 ** SLOT_BITS entries whatever the input."""
    kind = "block int, n binary"
    with small_batches(docs.sparkSession):
        t = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(_count_slots, kind).repartition("block").mapInArrow(_add_slots, kind).toArrow()
    out = np.zeros((1 << SLOT_BITS) // SLOT_BLOCK * SLOT_BLOCK, np.int32).reshape(-1, SLOT_BLOCK)
    for k, n in zip(t["block"].to_pylist(), t["n"].to_pylist(), strict=True):
        out[k] = np.frombuffer(n, np.int32)
    return out.ravel()


#: Rows of the shared shuffle: n >= 0 the smallest of a task's documents of a set (tok, other: the set's hash); -1 a prefix shingle, or several of a
#: cluster, with their least size and greatest partner's size in ``other``; -2 an edge to ``other``; -3 a task's copy of the document ``other``.
_FLOW = "tok long, doc long, other long, n long"
_LOW = np.int64((1 << 31) - 1)


def _clusters(tok: np.ndarray, low: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rows sorted by (tok, low): whether each begins a cluster, as no earlier row of its shingle reaches its size."""
    new = np.concatenate([[True], tok[1:] != tok[:-1]])
    upto = np.maximum.accumulate((np.cumsum(new) << 32) + reach)
    new[1:] |= low[1:] > (upto[:-1] & 0xFFFFFFFF)
    return new


def _prefixes(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, least, copies = counts.value, {}, [], []  # set -> its number; by number (first document, smallest); (document, number)
        for b in batches:
            keys, held, n_held = b.column(0).to_numpy(), [], 0
            for r, s in _sets(b.column(1)):
                n, key = len(s), int(keys[r])
                if not n:
                    yield _flow(*(np.array([x], np.int64) for x in (int(mix64(np.array([key]).astype(np.uint64)).view(np.int64)[0]), key, 0, 0)))
                    continue
                h = (int(mix64(s).sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ _BASE).sum(dtype=np.uint64).view(np.int64)), n)
                k = seen.setdefault(h, len(least))
                if k < len(least):
                    least[k][1] = min(least[k][1], key)
                    copies.append((key, k))
                    continue
                least.append([key, key])
                p = n - -(-4 * n // 5) + 1
                rare = np.argsort(order[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")[:p]
                held.append((s[rare], np.full(p, key), np.full(p, n), 9 * (n - np.arange(p)) // 4 - n))
                n_held += p
                if n_held >= PREFIX_MOST:
                    yield from merged(held)
                    held, n_held = [], 0
            if held:
                yield from merged(held)
            if len(seen) >= SEEN_MOST:
                yield from found(seen, least, copies)
                seen, least, copies = {}, [], []
        yield from found(seen, least, copies)
        del seen, least, copies
        trim()

    def found(seen: dict, least: list, copies: list) -> Iterator[pa.RecordBatch]:
        if not seen:
            return
        h1, h2, n = (np.array(c, np.int64) for c in zip(*seen, strict=True))
        first, low = (np.array(c, np.int64) for c in zip(*least, strict=True))
        yield _flow(h1, low, h2, n)
        yield from _edges(first, low)
        doc, k = np.array([*copies, *((f, i) for i, (f, l) in enumerate(least) if f != l)], np.int64).reshape(-1, 2).T
        doc, k = doc[doc != low[k]], k[doc != low[k]]
        if len(doc):
            yield _flow(mix64(doc.astype(np.uint64)).view(np.int64), doc, low[k], np.full(len(doc), -3))

    def merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tok, doc, low, reach = (np.concatenate(x) for x in zip(*held, strict=True))
        tok = tok.view(np.int64)
        at = np.lexsort((doc, low, tok))
        tok, doc, low, reach = tok[at], doc[at], low[at], reach[at]
        new = _clusters(tok, low, reach)
        begin = np.flatnonzero(new)
        lead = doc[begin][np.cumsum(new) - 1]
        yield _flow(tok[new], doc[new], low[new] << 32 | np.maximum.reduceat(reach, begin), np.full(len(begin), -1))
        yield from _edges(doc[~new], lead[~new])

    return run


def _flow(tok, doc, other, n) -> pa.RecordBatch:
    return pa.record_batch({"tok": pa.array(tok), "doc": pa.array(doc), "other": pa.array(other), "n": pa.array(n)})


def _edges(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    keep = u != v
    if keep.any():
        e = np.unique(np.stack([u[keep], v[keep]], 1), axis=0)
        yield _flow(mix64(e[:, 0].astype(np.uint64)).view(np.int64), e[:, 0], e[:, 1], np.full(len(e), -2))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tok, other): each document's edge to the first of its cluster; other rows pass."""
    held = None  # tok, doc, low and reach of the cluster that the last batch ended in
    for b in batches:
        tok, doc, other, n = (c.to_numpy() for c in b.columns)
        if (n != -1).any():
            keep = n != -1
            yield _flow(tok[keep], doc[keep], other[keep], n[keep])
        tok, doc, other = tok[n == -1], doc[n == -1], other[n == -1]
        if not len(tok):
            continue
        low, reach = other >> 32, other & _LOW
        if held:
            tok, doc, low, reach = (np.concatenate([[h], x]) for h, x in zip(held, (tok, doc, low, reach), strict=True))
        new = _clusters(tok, low, reach)
        begin = np.flatnonzero(new)
        lead = doc[begin][np.cumsum(new) - 1]
        same = tok == tok[-1]
        held = (tok[-1], lead[-1], low[-1], reach[same].max())
        yield from _edges(doc, lead)


# ---------------------------------------------------------------- signature trees


class SignatureTree:
    """Sets in a tree of FANOUT: each node has the largest count of every signature bit below it and the range of set sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, n = sets, len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        counts = np.zeros((n, BITS), np.uint16)
        for i, s in enumerate(sets):
            counts[i] = np.minimum(np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS), 65535)
        #: from the leaves up: (counts, smallest size, largest size)
        self.levels = [(counts, size, size)]
        while len(self.levels[-1][0]) > FANOUT:
            c, lo, hi = self.levels[-1]
            at = np.arange(0, len(c), FANOUT)
            self.levels.append((np.maximum.reduceat(c, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def range_of(self, level: int, node: int) -> slice:
        width = FANOUT**level
        return slice(node * width, min((node + 1) * width, len(self.sets)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs a x b of nodes of a level: whether members could reach the threshold."""
        c, lo, hi = self.levels[level]
        fits = (5 * hi[a][:, None] >= 4 * lo[b][None]) & (5 * hi[b][None] >= 4 * lo[a][:, None])
        if not fits.any():
            return fits
        most = np.minimum(c[a][:, None, :], c[b][None]).sum(2, dtype=np.int64)
        return fits & (9 * most >= 4 * (lo[a][:, None] + lo[b][None]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted sets of 0.8 or more."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def join_sets(sets: list[np.ndarray], comp: np.ndarray) -> np.ndarray:
    """A label for each set, equal where sets are connected by links or had equal ``comp``; labels are set numbers."""
    n = len(sets)
    _, label = np.unique(comp, return_inverse=True)
    if n < 2 or (label == label[0]).all():
        return np.zeros(n, np.int64) if n else label

    def union(x: int, y: int) -> None:
        a, b = label[x], label[y]
        if a != b:
            label[label == b] = a

    # likely links first: neighbours by smallest shingle, then by size
    low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    size = np.array([len(s) for s in sets])
    for order in (np.lexsort((size, low)), np.lexsort((low, size))):
        for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            if label[x] != label[y] and linked(sets[x], sets[y]):
                union(x, y)
        if (label == label[0]).all():
            return label
    order = np.lexsort((low, size))
    label = label[order]
    tree = SignatureTree([sets[i] for i in order])
    top = len(tree.levels) - 1
    roots = np.arange(len(tree.levels[top][0]))
    stack = [(top, x, y) for x, y in zip(*np.nonzero(np.triu(tree.may_link(top, roots, roots))), strict=True)]
    while stack:
        level, x, y = stack.pop()
        if level == 0:
            if x != y and label[x] != label[y] and linked(tree.sets[x], tree.sets[y]):
                union(x, y)
            continue
        one, two = label[tree.range_of(level, x)], label[tree.range_of(level, y)]
        if (one == one[0]).all() and (two == one[0]).all():
            continue
        a, b = tree.children(level, x), tree.children(level, y)
        fits = tree.may_link(level - 1, a, b)
        if x == y:
            fits = np.triu(fits)
        stack += [(level - 1, a[i], b[j]) for i, j in zip(*np.nonzero(fits), strict=True)]
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc, comp, t) sorted by block: an edge (u, v) from each linked document to one of its links' component."""
    key, docs, comps, sets = None, [], [], []
    out_u, out_v = [], []

    def close():
        if len(sets) > 1:
            label = join_sets(sets, np.array(comps))
            d = np.array(docs)
            order = np.lexsort((d, label))
            lead = label[order]
            new = np.concatenate([[True], lead[1:] != lead[:-1]])
            first = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            out_u.append(d[order][~new])
            out_v.append(first[~new])

    for b in batches:
        blocks, ids, known = (b.column(i).to_pylist() for i in range(3))
        for r, s in _sets(b.column(3)):
            if blocks[r] != key:
                close()
                key, docs, comps, sets = blocks[r], [], [], []
            docs.append(ids[r])
            comps.append(known[r])
            sets.append(s)
        if out_u:
            yield pa.record_batch({"u": pa.array(np.concatenate(out_u)), "v": pa.array(np.concatenate(out_v))})
            out_u, out_v = [], []
    close()
    if out_u:
        yield pa.record_batch({"u": pa.array(np.concatenate(out_u)), "v": pa.array(np.concatenate(out_v))})


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with ``__seen``: true where ``keys`` has the row's key, and for few others. Nothing but a bit for each slot moves, KEY_SLOTS / 64 rows at most."""
    slot = F.pmod(F.xxhash64(key), F.lit(KEY_SLOTS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    bits = keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return marked.withColumn("__seen", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def _texts_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the texts ``t`` of their ``doc``; texts whose slot no row has stay where they are."""
    return rows.join(_marked(texts, rows, "doc").filter("__seen").drop("__seen"), "doc")


def _links(blocks: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """blocks: (block string, doc, comp); the links found inside the blocks."""
    rows = _texts_of(blocks, texts).select("block", "doc", "comp", "t")
    found = stash(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_join_blocks, "u long, v long"), tag)
    del rows
    release(texts.sparkSession)
    return found


def _meeting(texts: DataFrame) -> DataFrame:
    """The rows of _FLOW of (doc, t), which meet by shingles that are rare among these texts."""
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, "t"))
    flow = texts.mapInArrow(_prefixes(counts), _FLOW)
    flow = stash(flow.repartition("tok").sortWithinPartitions("tok", "other").mapInArrow(_meet, _FLOW), "meet")
    counts.unpersist()
    release(texts.sparkSession)
    return flow


def _families(docs: DataFrame, flow: DataFrame, block: int) -> DataFrame:
    """docs (doc, n) in families of two or more -> family, doc, n, size, load, parts: the tasks that the family needs."""
    family = components(flow.filter("n = -2").select(F.col("doc").alias("u"), F.col("other").alias("v")))
    members = docs.join(family.select(F.col("node").alias("doc"), F.col("comp").alias("family")), "doc")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("load")).filter("size > 1").select("family", _parts("size", "load", block).alias("parts"))
    return stash(members.join(sizes, "family"), "members")


def _parts(size: str, load: str, block: int):
    return F.ceil(F.greatest(F.col(size) / block, F.col(load) / SHINGLES_MOST))


def _with_comp(members: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).withColumnRenamed("node", "doc")
    return members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def classes(keyed: DataFrame, text_col: str = "text", key_col: str = "__key", block: int = BLOCK) -> DataFrame:
    """keyed documents (unique long keys) -> key, n_shingles, comp: the smallest key reachable by links."""
    texts = keyed.select(F.col(key_col).cast("long").alias("doc"), text_or_empty(text_col).alias("t"))
    flow = _meeting(texts)
    info = flow.filter("n >= 0")
    rep = info.groupBy("tok", "other", "n").agg(F.min("doc").alias("rep"))
    reps = stash(info.join(rep, ["tok", "other", "n"]).select("doc", "rep", "n"), "reps")
    stashed = [_families(reps.filter("doc = rep").select("doc", "n"), flow, block)]
    members, large = stashed[0], stashed[0].filter("parts > 1")
    n_large = large.count()
    for _ in range(RECOUNTS):
        if not n_large:
            break
        own = stash(_texts_of(large.select("doc"), texts), "again")
        met = _meeting(own)
        stashed.append(_families(large.select("doc", "n"), met, block))
        unstash(own, met)
        members, large = members.filter("parts = 1").unionByName(stashed[-1]), stashed[-1].filter("parts > 1")
        before, n_large = n_large, large.count()
        if 10 * n_large > 9 * before:
            break
    cut = F.pmod(F.xxhash64("doc"), F.col("parts"))
    links = [_links(members.select(F.concat_ws(".", "family", cut).alias("block"), "doc", F.col("doc").alias("comp")), texts, "links1")]
    if n_large:
        now = stash(_with_comp(large, links[0]), "comps")
        lead = now.filter("doc = comp")
        n_lead = lead.groupBy("family").agg(F.count("*").alias("leads"), F.sum("n").alias("load")).filter("leads > 1").select("family", _parts("leads", "load", block).alias("cuts"))
        lead = lead.join(n_lead, "family")
        cut = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("cuts"))
        links.append(_links(lead.select(F.concat_ws(".", "family", cut).alias("block"), "doc", "comp"), texts, "links2"))
        now = stash(_with_comp(large, links[0].unionByName(links[1])), "comps")
        of = now.groupBy("family", "comp").agg(F.count("*").alias("k"))
        rank = Window.partitionBy("family").orderBy(F.desc("k"), "comp")
        main = of.withColumn("r", F.row_number().over(rank)).filter("r = 1").select("family", F.col("comp").alias("main"))
        rest = now.join(main, "family").filter("comp <> main").withColumn("cut", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("parts")))
        cuts = rest.select("family", "cut").distinct()
        pairs = now.withColumn("j", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts"))).join(cuts, "family")
        against = pairs.select(F.concat_ws(".", "family", "cut", "j").alias("block"), "doc", "comp")
        own = rest.select("family", "doc", "comp", "cut", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("j"))
        both = against.unionByName(own.select(F.concat_ws(".", "family", "cut", "j").alias("block"), "doc", "comp")).distinct()
        links.append(_links(both, texts, "links3"))
        links.append(now.filter("doc <> comp").select(F.col("doc").alias("u"), F.col("comp").alias("v")))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    comp = components(found)
    reps = reps.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("comp"))
    copies = flow.filter("n = -3").select(F.col("doc").alias("key"), F.col("other").alias("doc")).join(reps, "doc").select("key", "n_shingles", "comp")
    unstash(*stashed)
    return reps.withColumnRenamed("doc", "key").unionByName(copies)


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with ``__key``: the id where ids are whole numbers, unique and not null, else a number of its own in a stashed copy."""
    if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        odd = docs.groupBy(F.col(id_col).alias("i")).count().filter("i is null or count > 1")
        if odd.isEmpty():
            return docs.withColumn("__key", F.col(id_col).cast("long"))
    return stash(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer than five words have one. Rows
    of repeated or null ids are documents of their own; a component whose ids are all null has a null id.
    """
    own = keyed(docs, id_col)
    found = classes(own, text_col)
    if not hasattr(own, "_stash_path"):
        return found.select(F.col("key").cast(docs.schema[id_col].dataType).alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("comp").cast(docs.schema[id_col].dataType).alias("component_id"))
    rows = stash(found.join(own.select(F.col("__key").alias("key"), F.col(id_col).alias("doc_id")), "key"), "rows")
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that link to a row of smaller key; only rows that may be such go through a shuffle."""
    own = keyed(docs, id_col)
    drop = stash(classes(own, text_col).filter("key <> comp").select(F.col("key").alias("__key")), "near")
    release(docs.sparkSession)
    marked = _marked(own, drop, "__key")
    clear, some = marked.filter("not __seen"), marked.filter("__seen").join(drop, "__key", "left_anti")
    return clear.select(*docs.columns).unionByName(some.select(*docs.columns))
