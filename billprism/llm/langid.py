"""Language ID by compression: the language whose raw-content zstandard dictionary packs a text smallest.

A language's dictionary is plain text of that language, whole texts from a bounded sample of labelled documents. A text is encoded once with each
dictionary; the saving of the best over the second best is the margin, and a narrow one makes a rejection. How narrow is calibrated, by
length of text, on labelled documents that no dictionary has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trim

#: The sample: documents of each language in hash order, those of at most SHORT bytes first; its shortest whole texts make a dictionary of at most
#: DICTIONARY_BYTES (or of one text). Languages learned at most, the commonest first, and documents of each that are drawn by hash for the sample to be
#: ranked among, so that no task ranks more, however many there are.
SAMPLE_DOCS, SHORT, DICTIONARY_BYTES, LANGUAGES_MOST, DRAWN = 200, 8 << 10, 64 << 10, 256, 2000
#: The level from which zstandard looks one byte ahead for a longer match; below it a short match in the right dictionary can cost more than none in a wrong one.
LEVEL = 6
#: A text is encoded in pieces of so many bytes, so that the dictionary tells all along a long text.
PIECE = 4096
#: Margins below this are always rejected: in effect ties, as one byte of a piece is more.
REJECT_BELOW = 0.0002
#: Bytes of the calibrated texts, each for texts up to twice as long, the last for all longer ones; shorter texts than the first are rejected for ties only.
LENGTHS = (64, 128, 256, 512, 1024, 2048, PIECE)
#: Calibrated documents of each language and of all at most; rejected are margins under HALF of what all but LOW of them reach.
CALIBRATE_DOCS, CALIBRATE_ALL, HALF, LOW = 100, 800, 0.5, 0.02
UNKNOWN = "und"
#: Everything between letters is one space to the encoder, and case is dropped.
BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return BETWEEN.sub(" ", text.lower()).encode("utf-8", "replace")


def _dictionary(texts: list[str]) -> bytes:
    """The shortest texts, whole, while they fit; one at least."""
    out, size = [], 0
    for raw in sorted(dict.fromkeys(map(letters, texts)), key=lambda r: (len(r), r)):
        size += len(raw) + 1
        if out and size > DICTIONARY_BYTES:
            break
        out.append(raw)
    return b" ".join(reversed(out))


class Learned(dict):
    """A dictionary for each language; ``below`` has the margins under which texts of each of LENGTHS are rejected."""

    below: tuple[float, ...] = (REJECT_BELOW,) * len(LENGTHS)


def _calibrated(dictionaries: dict[str, bytes], texts: list[tuple[str, str]]) -> tuple[float, ...]:
    """texts: (language, text). A wrong prediction has no margin. A length that no text has takes half the margin of the length before it."""
    one, out = classifier(dictionaries), []
    for n in LENGTHS:
        cut = [(l, letters(t)[:n].decode("utf-8", "ignore")) for l, t in texts]
        margins = [m if name == l else 0.0 for l, (name, m) in ((l, one(t)) for l, t in cut if len(t.encode()) > n - 8)]
        out.append(max(REJECT_BELOW, HALF * sorted(margins)[int(LOW * len(margins))]) if margins else max(REJECT_BELOW, out[-1] / 2) if out else REJECT_BELOW)
    return tuple(out)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Learned:
    """Each language's dictionary, the commonest language first, and the margins; rows without text or language teach nothing.

    At most SAMPLE_DOCS documents of a language make its dictionary and CALIBRATE_DOCS others, a fifth where there are few, calibrate the margins; no more
    reach the driver.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("t is not null and l is not null")
    often = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES_MOST).collect()}
    rank = Window.partitionBy("l").orderBy("long", "h")
    if not often:
        return Learned()
    share = F.create_map(*(F.lit(x) for l, n in often.items() for x in (l, int(min(1.0, DRAWN / n) * (1 << 30)))))
    drawn = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.coalesce(share[F.col("l")], F.lit(0)))
    named = drawn.select("l", "h", (F.octet_length("t") > SHORT).alias("long"))
    which = named.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= SAMPLE_DOCS + CALIBRATE_DOCS).select("l", "h", "k").collect()
    chosen = docs.sparkSession.createDataFrame(which, "l string, h long, k int")
    found: dict[str, dict[int, str]] = {}
    for r in drawn.join(F.broadcast(chosen), ["l", "h"]).dropDuplicates(["l", "h"]).collect():  # as many as were chosen
        found.setdefault(r["l"], {})[r["k"]] = r["t"]
    found = {l: [t for _, t in sorted(x.items())] for l, x in found.items()}
    taught = {l: min(SAMPLE_DOCS, len(x) - len(x) // 5) for l, x in found.items()}
    out = Learned({l: _dictionary(found[l][: taught[l]]) for l in sorted(found, key=lambda l: (-often[l], l))})
    most = max(4, CALIBRATE_ALL // max(1, len(out)))
    seen = {t for l, x in found.items() for t in x[: taught[l]]}
    out.below = _calibrated(out, [(l, t) for l in out for t in found[l][taught[l] :][:most] if t not in seen])
    return out


def classifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """texts -> (language or None, margin) for each."""
    import zstandard as z

    names, coders = list(dictionaries), []
    for name in names:
        d = z.ZstdCompressionDict(dictionaries[name] or b"\n" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = letters(text)
        parts = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), n) for n, c in enumerate(coders))
        best = sizes[0]
        return names[best[1]], 1.0 if len(sizes) == 1 else (sizes[1][0] - best[0]) / sizes[1][0]

    return one


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: margin, 0 for ``und``) and rejected added; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Languages that tie go to the commoner one and are
    rejected, as are margins narrower than calibrated for the text's length. Every text is encoded whole.
    """
    sent, below = dict(dictionaries), getattr(dictionaries, "below", Learned.below)

    def narrow(text: str | None, name: str, margin: float) -> bool:
        if name == UNKNOWN or margin < REJECT_BELOW or margin >= max(below):
            return margin < REJECT_BELOW
        n = len(letters(text))
        return n >= LENGTHS[0] and margin < below[min(n // LENGTHS[0], 1 << len(LENGTHS) - 1).bit_length() - 1]

    @F.pandas_udf("lang_pred string, score double, narrow boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = classifier(sent)
        for texts in batches:
            yield pd.DataFrame([(*p, narrow(t, *p)) for t, p in ((t, one(t)) for t in texts)], columns=["lang_pred", "score", "narrow"], index=texts.index).astype({"score": "float64", "narrow": "bool"})
        del one
        trim()

    out = docs.withColumn("__p", predict(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score"), "rejected": (F.col("__p.lang_pred") == UNKNOWN) | F.col("__p.narrow")}).drop("__p")
