"""Quality classifier: a generalised additive model with pairwise interactions.

Trees of two cuts are boosted one feature at a time, in cycles, on that feature's bins; the trees of a feature add up to one lookup table.
Pairs that lower the loss most are then boosted in the same way with quadrant trees into two-dimensional tables. A score is
the logistic function of an intercept and one table entry per feature and pair, so scoring is additions over whole batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_table, mix64, spans_of, stash, text_buffers, text_or_empty, words_of

#: Labelled rows that the model learns from at most, bins of a feature and of a pair's side, cycles, step, pairs.
SAMPLE, BINS, PAIR_BINS, CYCLES, PAIR_CYCLES, STEP, PAIRS = 20_000, 48, 8, 60, 30, 0.15, 8
#: Scores from here on are predicted 1.
THRESHOLD = 0.3

FEATURES = (
    "bytes", "words", "word_bytes", "long_words", "upper", "digits", "marks", "odd_marks", "not_ascii", "lines", "line_bytes", "distinct_words",
    "top_word", "same_next", "same_pair", "repeated_pairs", "repeated_lines", "line_start_same", "double_marks", "upper_words", "bars", "sentences",
)

_TABLE, _STEP = byte_table(23), np.uint64(0xD1342543DE82EF95)
_UPPER, _DIGIT, _LETTER, _HIGH = np.zeros((4, 256), bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_HIGH[128:] = True
_MARK = ~(_UPPER | _DIGIT | _LETTER | _HIGH | SPACE)
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"?-()"]] = True


def _repeats(x: np.ndarray) -> tuple[float, float, float]:
    """Share of distinct values, share of the commonest, share of values that occur again."""
    if not len(x):
        return 1.0, 0.0, 0.0
    _, n = np.unique(x, return_counts=True)
    return len(n) / len(x), n.max() / len(x), 1 - (n == 1).sum() / len(x)


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, from whole texts."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offs).astype(np.float64)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    starts, ends, words = words_of(raw, offs)
    lens = ends - starts
    total = np.concatenate([[0], np.cumsum(lens)])
    upto = np.concatenate([[0], np.cumsum(words)])
    safe, safe_words = np.maximum(size, 1), np.maximum(words, 1)
    first_word = np.add.reduceat(_TABLE[LOWER[raw]][: len(raw)] * _powers(raw, starts, ends), starts) if len(starts) else np.zeros(0, np.uint64)
    word = mix64(first_word + lens.astype(np.uint64) * _STEP)
    of = np.repeat(np.arange(n), words)
    mark, odd = _MARK[raw], _MARK[raw] & ~_COMMON[raw]
    double = mark.copy()
    double[1:] &= mark[:-1]
    double[:1] = False
    newline = raw == 10
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    all_upper = (upper[ends] - upper[starts]) * 2 > lens if len(starts) else np.zeros(0, bool)
    per_word = lambda flags: np.bincount(of, weights=flags, minlength=n)
    lines = per(newline) + 1
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = (total[upto[1:]] - total[upto[:-1]]) / safe_words
    out[:, 3] = per_word(lens > 14) / safe_words
    for k, flags in ((4, _UPPER[raw]), (5, _DIGIT[raw]), (6, mark), (7, odd), (8, _HIGH[raw]), (18, double), (20, raw == ord("|"))):
        out[:, k] = per(flags) / safe
    out[:, 9], out[:, 10] = np.log1p(lines), np.log1p(size / lines)
    out[:, 19] = per_word(all_upper) / safe_words
    out[:, 21] = per((raw == ord(".")) | (raw == ord("?"))) / safe_words
    line_sum = np.concatenate([[0], np.cumsum(_TABLE[raw], dtype=np.uint64)]).astype(np.uint64)
    breaks = np.flatnonzero(newline)
    for i in range(n):
        w = word[upto[i] : upto[i + 1]]
        out[i, 11], out[i, 12], _ = _repeats(w)
        if len(w) > 1:
            out[i, 13] = (w[1:] == w[:-1]).mean()
            pairs = w[1:] * _STEP + w[:-1]
            out[i, 15] = _repeats(pairs)[2]
            out[i, 14] = (w[2:] == w[:-2]).mean() if len(w) > 2 else 0
        a, b = offs[i], offs[i + 1]
        cut = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        if len(cut):
            edge = np.concatenate([[a], cut + 1, [b + 1]])
            sums = line_sum[np.minimum(edge[1:] - 1, b)] - line_sum[edge[:-1]]
            out[i, 16] = _repeats(sums)[2]
            head = np.searchsorted(starts, edge[:-1])
            head = head[head < upto[i + 1]]
            out[i, 17] = _repeats(word[head])[2]
    return out


def _powers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of a word an odd factor for its place in the word; 0 elsewhere."""
    out = np.zeros(len(raw), np.uint64)
    lens = ends - starts
    inside = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    place = inside - np.repeat(starts, lens)
    out[inside] = mix64(place.astype(np.uint64)) | np.uint64(1)
    return out


# ---------------------------------------------------------------- model


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, cut in enumerate(self.cuts):
            z += self.tables[k][np.searchsorted(cut, x[:, k], "right")]
        if self.pairs:
            side = [np.searchsorted(cut, x[:, k], "right") for k, cut in enumerate(self.pair_cuts)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                z += table[side[a], side[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 2, smooth: float = 1.0) -> np.ndarray:
    """Leaf values by bin of the tree with so many cuts, greedily the best, for gradients and curvatures summed by bin."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in itertools.pairwise(edges):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gl, hl, gt, ht = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(k[i]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(edges):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a pair of features once each."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    best, at, rows, cols = -1.0, (1, 1), *g.shape
    i, j = np.arange(1, rows)[:, None], np.arange(1, cols)[None]
    parts = lambda c: (c[i, j], c[i, cols] - c[i, j], c[rows, j] - c[i, j], c[rows, cols] - c[i, cols] - c[rows, j] + c[i, j])
    gain = sum(a**2 / (b + smooth) for a, b in zip(parts(cg), parts(ch), strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    k = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best, at = float(gain[k]), (k[0] + 1, k[1] + 1)
    out = np.zeros_like(g)
    for r in (slice(0, at[0]), slice(at[0], rows)):
        for c in (slice(0, at[1]), slice(at[1], cols)):
            out[r, c] = g[r, c].sum() / (h[r, c].sum() + smooth)
    return best - float(g.sum() ** 2 / (h.sum() + smooth)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts on rows x, labels y in {0, 1}; without rows or with one label only, a constant near that label's share."""
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * width, np.zeros((width, BINS)), [np.zeros(0)] * width)
    if n < 20 or y.min() == y.max():
        return model
    model.cuts, model.pair_cuts = [_cuts(x[:, k], BINS) for k in range(width)], [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    z = np.full(n, model.intercept)
    for _ in range(CYCLES):
        for k in range(width):
            size = len(model.cuts[k]) + 1
            p = 1 / (1 + np.exp(-z))
            tree = STEP * _shallow_tree(np.bincount(bins[k], y - p, size), np.bincount(bins[k], p * (1 - p), size))
            model.tables[k, :size] += tree
            z += tree[bins[k]]
    side = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.pair_cuts)]
    sums = lambda a, b, v: np.bincount(side[a] * (len(model.pair_cuts[b]) + 1) + side[b], v, (len(model.pair_cuts[a]) + 1) * (len(model.pair_cuts[b]) + 1)).reshape(len(model.pair_cuts[a]) + 1, -1)
    p = 1 / (1 + np.exp(-z))
    gains = sorted(((-_quadrants(sums(a, b, y - p), sums(a, b, p * (1 - p)))[0], a, b) for a, b in itertools.combinations(range(width), 2)))
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain < -1e-9]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_CYCLES):
        for t, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            tree = STEP * _quadrants(sums(a, b, y - p), sums(a, b, p * (1 - p)))[1]
            model.pair_tables[t] += tree
            z += tree[side[a], side[b]]
    return model


# ---------------------------------------------------------------- Spark


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offs = text_buffers(b.column(1))
        for i, j in spans_of(offs, 2 << 20):
            x = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch({"doc_id": b.column(0)[i:j], "x": values})


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stashed features: doc_id, x."""
    kind = docs.schema[id_col].dataType.simpleString()
    return stash(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(_measure, f"doc_id {kind}, x array<float>"), "features")


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """rows: measured documents allowed for learning. SAMPLE rows by hash of their features at most reach the driver."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("y")).filter("y in (0, 1)")
    sample = rows.join(known, rows["doc_id"] == known["l_id"]).select("x", "y", F.xxhash64("doc_id", "x").alias("h")).orderBy("h", "y").limit(SAMPLE).toArrow()
    x = np.array(sample["x"].combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy().astype(np.float64))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each measured row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1))
                yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted.

    ``learn_from`` is a Column over doc_id that tells which rows may teach. Null texts are scored as empty ones. Ids may be null or repeat;
    labels other than 0 and 1 are left out, and without both labels every score is the smoothed share of the one that is
    there. An empty table gives no rows.
    """
    rows = measured(docs, id_col, text_col)
    return score(rows, learn(rows.filter(learn_from), labels, id_col))
