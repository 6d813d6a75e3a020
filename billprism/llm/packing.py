"""Hierarchical residual packing of tokenised documents into sequences of at most 4096 tokens.

Each task tokenises its documents, cuts only those longer than a sequence, and packs its pieces best-fit, longest
first. Nearly full bins are final. Underfull bins become items of the next round: partitions merge eight to one and pack
again, until one partition is left or a round saves little. From then on only bins at most half full travel, as no two others
fit together: a task leaves one of them at most, and as many of the emptiest others go with them as there are, so one task
packs them in the end and no two underfull bins are left that fit together. A bin's members travel with it as an array (at most one per
token), so places need no joins.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, text_or_empty, trim

SEQUENCE, END_ID = 4096, 1
#: A bin with at most so many free tokens is final; merge fan-in; items one task packs; words one task remembers.
SLACK, FAN_IN, ITEMS_MOST, CACHE_MOST = 8, 8, 200_000, 300_000
#: Signs that the tokenizer cuts off the letters before them; the apostrophe, which begins English endings, is none of them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are encoded together.
PASS_BYTES = 3 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts through a bounded memory of the ids of their space-separated parts.

    Valid for byte-level BPE tokenizers whose tokens never span white space, that lower-case, and that cut between letters and the signs
    behind them, as word_bpe does. A part of letters, alone or before signs of MARKS, goes to the BPE model at once; any other part goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        """Forgets all parts."""
        self.at: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {"": []}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        found, hard, cores = [], [], {}
        for i, w in enumerate(words):
            core = w.rstrip(MARKS)
            name = _letters(core)
            if name is None:
                hard.append(i)
                found.append(None)
                continue
            ids = cores.get(name)
            if ids is None:
                ids = cores[name] = [t.id for t in self.bpe.tokenize(name)]
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = self.whole([tail])[0]
                ids = ids + self.tails[tail]
            found.append(ids)
        for i, ids in zip(hard, self.whole([words[i] for i in hard]), strict=True):
            found[i] = ids
        lens = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.at), int(lens.sum())
        self.flat = _room(self.flat, self.used, total)
        self.start, self.length = _room(self.start, n, len(words)), _room(self.length, n, len(words))
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        self.start[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.length[n : n + len(words)] = lens
        self.used += total
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and the number of each text's ids."""
        split = pc.ascii_split_whitespace(texts)
        parts = split.flatten().dictionary_encode()
        n = len(parts.dictionary)
        words = pc.binary_join(pa.ListArray.from_arrays([0, n], parts.dictionary), "\n")[0].as_py().split("\n") if n else []
        rows = list(map(self.at.get, words))
        new = [w for w, r in zip(words, rows, strict=True) if r is None]
        if new and len(self.at) + len(new) > CACHE_MOST:
            self.clear()
            new = words
        if new:
            self.learn(new)
            rows = list(map(self.at.__getitem__, words))
        which = np.array(rows, np.int64)[parts.indices.to_numpy()]
        lens = self.length[which]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.start[which] - ends[:-1], lens) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, np.diff(ends[offsets - offsets[0]])


def _letters(core: str) -> str | None:
    """The name in the BPE model of a part of letters only; None if it needs the whole tokenizer."""
    if not core.isalpha():
        return None
    if core.isascii():
        return core.lower()
    if "\u03a3" in core or "\u0130" in core or not unicodedata.is_normalized("NFC", core):
        return None
    return core.lower().encode().decode("latin-1").translate(_BYTE_NAMES)


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """a, or a copy of at least twice its size where ``more`` entries behind ``used`` do not fit."""
    if used + more <= len(a):
        return a
    out = np.zeros(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out


def _byte_names() -> dict[int, str]:
    """Characters that stand for bytes in byte-level BPE: printable Latin-1 itself, the other bytes U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_BYTE_NAMES = _byte_names()


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing: the bins as lists of item numbers; ties to the earlier item."""
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        free[room - n].append(b)
        mask |= 1 << (room - n)
    return bins


def _members(id_type: pa.DataType) -> pa.StructType:
    return pa.struct([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _emit(fills: np.ndarray, members: pa.ListArray, size: int) -> pa.RecordBatch:
    """Packs items, each with its members, and returns the bins."""
    bins = best_fit(fills, size)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(fills))
    own = np.diff(members.offsets.to_numpy())
    begin = members.offsets.to_numpy()[:-1]
    lens = own[order]
    ends = np.cumsum(lens)
    take = np.repeat(begin[order] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
    per_bin = np.array([len(b) for b in bins], np.int64)
    upto = np.concatenate([[0], np.cumsum(per_bin)])
    offsets = np.concatenate([[0], ends])[upto].astype(np.int32)
    sums = np.add.reduceat(fills[order], upto[:-1]) if len(bins) else np.zeros(0, np.int64)
    return pa.record_batch({"fill": pa.array(sums.astype(np.int32)), "members": pa.ListArray.from_arrays(pa.array(offsets), members.values.take(pa.array(take)))})


def pack_round(size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ITEMS_MOST:
                yield merged(held)
                held, n = [], 0
        if n:
            yield merged(held)

    def merged(held):
        t = pa.Table.from_batches(held).combine_chunks()
        m = t["members"].combine_chunks()
        m = pa.ListArray.from_arrays(pa.array(m.offsets.to_numpy() - m.offsets[0].as_py()), m.flatten().cast(_members(id_type)))
        return _emit(t["fill"].to_numpy().astype(np.int64), m, size)

    return run


def tokenise_and_pack(path: str, size: int, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n = WordEncoder(path), [], 0
        for batch in batches:
            texts = batch.column(1)
            step = max(1, int(batch.num_rows * PASS_BYTES / max(1, texts.nbytes)))
            for i in range(0, batch.num_rows, step):
                held.append(pieces(encoder, batch.column(0)[i : i + step], texts[i : i + step]))
                n += held[-1].num_rows
                if n >= ITEMS_MOST:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)
        del encoder, held
        trim()

    def pieces(encoder, ids, texts):
        tokens, counts = encoder.encode(texts)
        ends = np.cumsum(counts + 1)
        own = np.full(int(ends[-1]), end_id, "<u4")
        inner = np.ones(len(own), bool)
        inner[ends - 1] = False
        own[inner] = tokens
        raw, begin = memoryview(own.tobytes()), ends - counts - 1
        per = counts // size + 1
        row = np.repeat(np.arange(len(counts)), per)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        start = piece * size
        length = np.minimum(size, (counts + 1)[row] - start)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (begin[row] + start)).tolist(), (4 * (begin[row] + start + length)).tolist(), strict=True)]
        return pa.record_batch({"doc_id": ids.take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    def packed(held):
        t = pa.Table.from_batches(held).combine_chunks()
        rows = pa.StructArray.from_arrays([t[c].combine_chunks().cast(f.type) for c, f in zip(t.column_names, _members(id_type), strict=True)], fields=list(_members(id_type)))
        return _emit(t["length"].to_numpy(), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), rows), size)

    return run


def _lightest(under: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """The bins at most half full with as many of the emptiest others; the rest; and the number of the first.

    What fits with any of the rest fits with one of the emptiest that has got nothing else.
    """
    under = stash(under.withColumn("bin", F.monotonically_increasing_id()), "under")
    place, light = F.struct("fill", "bin"), F.col("fill") <= size // 2
    k = under.filter(light).count()
    if not k:
        return under.filter("false").drop("bin"), under.drop("bin"), 0
    last = under.select("fill", "bin").orderBy("fill", "bin").limit(2 * k).agg(F.max(place).alias("p"), F.count("*").alias("n")).first()
    upto = (F.col("fill") < last["p"]["fill"]) | ((F.col("fill") == last["p"]["fill"]) & (F.col("bin") <= last["p"]["bin"]))
    return under.filter(upto).drop("bin"), under.filter(~upto).drop("bin"), last["n"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``, so a null or empty text is one token. Ids may be null or repeat; each row is packed.
    An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    bins_type = T.StructType([T.StructField("fill", T.IntegerType()), T.StructField("members", T.ArrayType(T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])))])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    bins = stash(rows.mapInArrow(tokenise_and_pack(path or tokenizer_path(), size, end_id, id_type), bins_type), "bins")
    done, parts, few = [bins.filter(F.col("fill") >= size - SLACK)], None, False
    under = bins.filter(F.col("fill") < size - SLACK)
    while True:
        n = under.count()
        if n < 2:
            break
        if few:
            under, rest, n = _lightest(under, size)
            done.append(rest)
            if n < 2:
                break
            parts = -(-n // ITEMS_MOST)
        else:
            parts = -(-max(1, parts or rows.rdd.getNumPartitions()) // FAN_IN)
            parts = max(parts, -(-n // ITEMS_MOST))
        bins = stash(under.repartition(parts).mapInArrow(pack_round(size, id_type), bins_type), "bins")
        done.append(bins.filter(F.col("fill") >= size - SLACK))
        under = bins.filter(F.col("fill") < size - SLACK)
        if parts == 1:
            break
        few = few or bins.count() > 0.99 * n
    done.append(under)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    upto = F.transform(F.sequence(F.lit(1), F.size("members")), lambda i: F.aggregate(F.slice("members", F.lit(1), i - 1), F.lit(0).cast("long"), lambda s, m: s + m["length"]))
    return out.select("sequence_id", F.explode(F.arrays_zip("members", upto.alias("offset"))).alias("m")).select("m.members.*", "sequence_id", F.col("m.offset").alias("offset"))
