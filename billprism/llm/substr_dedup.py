"""Suffix-array dedup by a depth-limited radix sort.

Every byte position begins a suffix of which only the first 200 bytes, its window, matter. The windows are radix-sorted by digits,
most significant first, and a window leaves as soon as its group is itself alone; groups that are equal through all 200
bytes are exactly the repeated windows. Two things make the passes small:

* The first digit is a 64-byte gram of the window: the one of least hash (equal windows have it at the same place). It stands for all
  windows around it, so the first pass moves one row for about 70 bytes.
* The second digit is the whole surroundings of that gram, 136 bytes before to 200 after it. Where these are equal, every
  window in them is repeated and none has to be moved.
* Where a gram occurs in different surroundings, at the ends of passages and around edits, its windows go on in blocks of 24 neighbours:
  the third digit is the core that all of a block have in common, the fourth the whole of the block. The fifth and last, the
  window itself, is left for blocks that share the core only.

Equality of surroundings, blocks and windows is that of two 64-bit hashes; grams and cores choose candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, mix64, spans_of, stash, text_buffers, text_or_empty, unstash
from .ngram_join import keyed

WINDOW, GRAM = 200, 64
#: Gram positions in a window; bytes before and after a gram's start that its windows reach.
REACH = WINDOW - GRAM + 1
BEFORE, AFTER = REACH - 1, WINDOW
#: Bytes that one numpy pass hashes, and surroundings of one gram that a batch sends before its other ones wait for the third digit.
PASS_BYTES, SENT_MOST = 1 << 20, 64
#: Offsets of a window's start before its gram, in blocks; a block's number takes three bits.
BLOCK = 24
_FIRST = np.arange(0, REACH, BLOCK)
_LAST = np.minimum(_FIRST + BLOCK - 1, REACH - 1)
#: Slots of the filter that keeps other texts from a shuffle.
KEY_SLOTS = 1 << 18

_LANES = (byte_table(11), byte_table(13))
_ODD = np.random.default_rng(17).integers(0, 1 << 63, (2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(raw: np.ndarray, lane: int) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h, m = _LANES[lane][raw], 1
    for level in range(GRAM.bit_length() - 1):
        h = h[: len(h) - m] * _ODD[lane, level] + h[m:]
        h ^= h >> np.uint64(29)
        m *= 2
    return mix64(h)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours: len(x) - width + 1 values."""
    ufunc, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = -(-len(x) // width) * width
    padded = np.concatenate([x, np.full(n - len(x), fill, np.uint64)]).reshape(-1, width)
    ahead = ufunc.accumulate(padded, axis=1).ravel()
    back = ufunc.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def _anchors(gram: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions whose gram is the least of some window; ``inside``: the gram does not span two texts."""
    g = np.where(inside, gram, np.iinfo(np.uint64).max)
    if len(g) < REACH:
        return np.zeros(0, np.int64)
    least = _slide(g, REACH, True)
    pad = np.zeros(REACH - 1, np.uint64)
    return np.flatnonzero((_slide(np.concatenate([pad, least, pad]), REACH, False) == g) & inside)


def _join_hash(h: np.ndarray, start: np.ndarray, length: np.ndarray, lane: int, seed: np.ndarray) -> np.ndarray:
    acc = seed
    for off in range(0, BEFORE + AFTER, GRAM):
        acc = mix64(acc * _ODD[lane, 6] + h[start + np.minimum(off, length - GRAM)])
    return acc


class _Pass:
    """Hashes of some long enough texts laid end to end."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.offs, self.h = offs, [_gram_hashes(raw, lane) for lane in (0, 1)]
        self.n = len(self.h[0])

    def row_of(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))[: self.n]
        return row, np.arange(self.n) + GRAM <= self.offs[1:][row]

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Text, position, gram and surroundings of each anchor."""
        row, inside = self.row_of()
        p = _anchors(self.h[0], inside)
        row, begin, end = row[p], self.offs[:-1][row[p]], self.offs[1:][row[p]]
        return row, p - begin, self.h[0][p], self.around(p, np.minimum(p - begin, BEFORE), np.minimum(end - p, AFTER))

    def around(self, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _join_hash(self.h[1], p - left, left + right, 1, mix64((left * 1024 + right).astype(np.uint64)))

    def own_windows(self, p: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """anchors x offsets: whether the window that starts so far before the anchor is in its text and has it as its least gram."""
        _, inside = self.row_of()
        least = _slide(np.where(inside, self.h[0], np.iinfo(np.uint64).max), REACH, True)
        s = p[:, None] - offsets
        valid = (s >= begin[:, None]) & (s + WINDOW <= end[:, None])
        return valid & (least[np.where(valid, s, 0)] == self.h[0][p][:, None])

    def blocks(self, p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each block that holds a window of its anchor: the anchor's number, the block's, its core and its whole."""
        which, block = np.nonzero(np.logical_or.reduceat(self.own_windows(p, begin, end, np.arange(REACH)), _FIRST, axis=1))
        p, begin, end, first, last = p[which], begin[which], end[which], _FIRST[block], _LAST[block]
        core = _join_hash(self.h[0], p - first, WINDOW - last + first, 0, mix64(block.astype(np.uint64)))
        return which, block, core, self.around(p, np.minimum(last, p - begin), np.minimum(WINDOW - first, end - p))

    def windows(self, starts: np.ndarray) -> list[np.ndarray]:
        length = np.full(len(starts), WINDOW)
        return [_join_hash(self.h[k], starts, length, k, np.full(len(starts), k + 1, np.uint64)) for k in (0, 1)]


def _passes(column: pa.Array) -> Iterator[tuple[np.ndarray, _Pass]]:
    raw, offs = text_buffers(column)
    for i, j in spans_of(offs, PASS_BYTES):
        rows = np.arange(i, j)[np.diff(offs[i : j + 1]) >= WINDOW]
        if len(rows):
            own = np.concatenate([raw[offs[r] : offs[r + 1]] for r in rows])
            yield rows, _Pass(own, np.concatenate([[0], np.cumsum(offs[rows + 1] - offs[rows])]))


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.record_batch(dict(zip(names.split(), (pa.array(np.ascontiguousarray(c)) for c in cols), strict=True)))


#: state: 0 an anchor or block to place (n occurrences of c seen), 1 its c is repeated, 2 it must be looked at further, 3 both: it stands
#: for its c among others of its g.
_FLOW, _NAMES = "g long, c long, doc long, pos long, n int, state int", "g c doc pos n state"


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Number of each row's run of equal values in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.cumsum(new) - 1


def _send(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (g, c, doc, pos) of a batch: one for each g and c is placed among all, the others are known to be repeated."""
    g, c, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.lexsort((pos, doc, c, g))
    g, c, doc, pos = g[at], c[at], doc[at], pos[at]
    run = _runs(g, c)
    first = np.concatenate([[True], run[1:] != run[:-1]])
    many = np.bincount(run)[run]
    group = _runs(g)
    per = np.bincount(group, weights=first).astype(np.int64)
    nth = np.cumsum(first) - (np.cumsum(per) - per)[group]
    send = first & ((per[group] <= SENT_MOST) | (nth <= 2))
    wait = first & ~send
    n = np.minimum(many, 2).astype(np.int32)
    zero = np.zeros(len(g), np.int32)
    aside = lambda d: mix64(d.astype(np.uint64)).view(np.int64)
    yield _batch(_NAMES, *(x[send] for x in (g, c, doc, pos, n, zero)))
    if wait.any():
        yield _batch(_NAMES, *(x[wait] for x in (aside(doc), zero.astype(np.int64), doc, pos, n, np.where(n > 1, 3, 2).astype(np.int32))))
    if (~first).any():
        yield _batch(_NAMES, *(x[~first] for x in (aside(doc), zero.astype(np.int64), doc, pos, n, zero + 1)))


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, found = b.column(0).to_numpy(), []
        for rows, p in _passes(b.column(1)):
            row, pos, g, c = p.anchors()
            found.append((g.view(np.int64), c.view(np.int64), keys[rows[row]], pos))
        if found:
            yield from _send(found)


def _place(g, c, doc, pos, n) -> pa.RecordBatch:
    """All rows of some g, sorted by g and c: those that are repeated or may be in part."""
    run, group = _runs(g, c), _runs(g)
    first = np.concatenate([[True], run[1:] != run[:-1]])
    twice = np.bincount(run, weights=n)[run] > 1
    mixed = np.bincount(group, weights=first)[group] > 1
    state = np.where(twice, np.where(mixed & first, 3, 1), np.where(mixed, 2, 0)).astype(np.int32)
    keep = state > 0
    return _batch("doc pos state", doc[keep], pos[keep], state[keep])


def _second_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g, c -> doc, pos, state."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        known = cols[5] > 0
        if known.any():
            yield _batch("doc pos state", *(cols[i][known] for i in (2, 3, 5)))
        cols = [x[~known] for x in cols[:5]]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            head = [*held, [x[:cut] for x in cols]]
            yield _place(*(np.concatenate(x) for x in zip(*head, strict=True)))
            held = []
        held.append([x[cut:] for x in cols])
    if held:
        yield _place(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _listed(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, end to end, and n + 1 offsets; null is empty."""
    col = b.column(column)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _with_positions(b: pa.RecordBatch) -> Iterator[tuple[_Pass, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (doc, t, at) -> a pass, and of its listed values: value, doc, begin and end of the text in the pass."""
    keys, (flat, upto) = b.column(0).to_numpy(), _listed(b, 2)
    for rows, p in _passes(b.column(1)):
        n = upto[rows + 1] - upto[rows]
        pick = np.repeat(upto[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if len(pick):
            yield p, flat[pick], np.repeat(keys[rows], n), np.repeat(p.offs[:-1], n), np.repeat(p.offs[1:], n)


def _third_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, t, at: positions of anchors) -> their blocks, numbered 8 * position + block."""
    for b in batches:
        found = []
        for p, pos, doc, begin, end in _with_positions(b):
            which, block, core, whole = p.blocks(pos + begin, begin, end)
            found.append((core.view(np.int64), whole.view(np.int64), doc[which], pos[which] * 8 + block))
        if found:
            yield from _send(found)


def _last_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, t, at: block numbers) -> w, x, doc, pos, n of their windows; n 0: known to be repeated."""
    for b in batches:
        found = []
        for p, number, doc, begin, end in _with_positions(b):
            pos, block = (number >> 3) + begin, number & 7
            offsets = _FIRST[block][:, None] + np.arange(BLOCK)
            s = pos[:, None] - offsets
            _, inside = p.row_of()
            least = _slide(np.where(inside, p.h[0], np.iinfo(np.uint64).max), REACH, True)
            valid = (offsets <= _LAST[block][:, None]) & (s >= begin[:, None]) & (s + WINDOW <= end[:, None])
            valid &= least[np.where(valid, s, 0)] == p.h[0][pos][:, None]
            start, one = np.unique(s[valid], return_index=True)
            row = np.nonzero(valid)[0][one]
            w, x = p.windows(start)
            found.append((w.view(np.int64), x.view(np.int64), doc[row], (start - begin[row]).astype(np.int32)))
        if not found:
            continue
        w, x, doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
        at = np.lexsort((x, w))
        w, x, doc, pos = w[at], x[at], doc[at], pos[at]
        run = _runs(w, x)
        first = np.concatenate([[True], run[1:] != run[:-1]])
        many = np.bincount(run)[run]
        yield _batch("w x doc pos n", *(c[first] for c in (w, x, doc, pos, np.minimum(many, 2).astype(np.int32))))
        if (~first).any():
            yield _batch("w x doc pos n", *(c[~first] for c in (mix64(doc.astype(np.uint64)).view(np.int64), x, doc, pos, np.zeros(len(w), np.int32))))


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by w, x -> doc, pos of repeated windows."""
    held: list[list[np.ndarray]] = []

    def close(parts):
        w, x, doc, pos, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = np.bincount(r := _runs(w, x), weights=n)[r] > 1
        return _batch("doc pos", doc[keep], pos[keep])

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        known = cols[4] == 0
        if known.any():
            yield _batch("doc pos", cols[2][known], cols[3][known])
        cols = [c[~known] for c in cols]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            yield close([*held, [c[:cut] for c in cols]])
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield close(held)


_RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            out: list[list] = [[], [], [], [], []]
            lists = [_listed(b, i) for i in (2, 3, 4)]
            for r in range(b.num_rows):
                text, size = raw[offs[r] : offs[r + 1]], int(offs[r + 1] - offs[r])
                near, blocks, own = (x[u[r] : u[r + 1]].astype(np.int64) for x, u in lists)
                removed = spans = 0
                if len(near) or len(blocks) or len(own):
                    pos, k = blocks >> 3, blocks & 7
                    edge = np.zeros(size + 1, np.int32)
                    np.add.at(edge, np.maximum(0, np.concatenate([near - BEFORE, pos - _LAST[k], own])), 1)
                    np.add.at(edge, np.minimum(size, np.concatenate([near + AFTER, pos - _FIRST[k] + WINDOW, own + WINDOW])), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                left = text.tobytes()
                for c, x in zip(out, (size, removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None), strict=True):
                    c.append(x)
            yield pa.record_batch({"key": b.column(0), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "kept": pa.array(out[4], pa.string())})

    return run


def _slot():
    return F.pmod(F.xxhash64("doc"), F.lit(KEY_SLOTS))


def _some(texts: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """texts whose slot one of rows has (or has not), without moving them; the broadcast side has KEY_SLOTS rows at most."""
    return texts.join(F.broadcast(rows.select(_slot().alias("_slot")).distinct()), _slot() == F.col("_slot"), how)


def _further(texts: DataFrame, placed: DataFrame) -> DataFrame:
    look = placed.filter("state >= 2")
    return _some(texts, look).join(look.groupBy("doc").agg(F.collect_list("pos").alias("at")), "doc").select("doc", "t", "at")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept, the remaining text.

    Each byte that lies in a 200-byte string which also begins elsewhere, in this or another text, is removed. Null texts
    are empty; texts under 200 bytes stay whole. Rows of repeated or null ids are texts of their own, so a repeated row
    is removed with its copy. Where removal cuts a character, ``kept`` shows the rest as U+FFFD; the digest is of the bytes.
    """
    own = keyed(docs, id_col)
    texts = own.select(F.col("__key").alias("doc"), text_or_empty(text_col).alias("t"))
    found = "doc long, pos long, state int"
    place = lambda flow: flow.repartition("g").sortWithinPartitions("g", "c").mapInArrow(_second_digits, found)
    anchors = stash(place(texts.mapInArrow(_first_digits, _FLOW)), "anchors")
    blocks = stash(place(_further(texts, anchors).mapInArrow(_third_digits, _FLOW)), "blocks")
    last = _further(texts, blocks).mapInArrow(_last_digits, "w long, x long, doc long, pos int, n int")
    windows = stash(last.repartition("w").sortWithinPartitions("w", "x").mapInArrow(_equal_windows, "doc long, pos int"), "windows")
    known = "state in (1, 3)"
    marks = anchors.filter(known).select("doc", F.lit(0).alias("k"), "pos").unionByName(blocks.filter(known).select("doc", F.lit(1).alias("k"), "pos"))
    marks = stash(marks.unionByName(windows.select("doc", F.lit(2).alias("k"), F.col("pos").cast("long").alias("pos"))), "marks")
    unstash(anchors, blocks, windows)
    lists = [F.collect_list(F.when(F.col("k") == k, F.col("pos"))).alias(n) for k, n in enumerate(("near", "inner", "own"))]
    none = F.array().cast("array<long>")
    hit = _some(texts, marks).join(marks.groupBy("doc").agg(*lists), "doc", "left").select("doc", "t", *(F.coalesce(n, none).alias(n) for n in ("near", "inner", "own")))
    rest = _some(texts, marks, "left_anti").select("doc", "t", none.alias("near"), none.alias("inner"), none.alias("own"))
    out = hit.unionByName(rest).mapInArrow(_cut_out(with_text), _RESULT)
    kind = docs.schema[id_col].dataType
    if hasattr(own, "_stash_path"):
        out = out.join(own.select(F.col("__key").alias("key"), F.col(id_col).alias("doc_id")), "key")
    else:
        out = out.withColumn("doc_id", F.col("key").cast(kind))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
