"""License scans with a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams tells a paragraph's licence family or ``unknown``. It is trained here on the
notices below, on deterministic variants of them, and on sentences that use the same words for other things; a temperature and a
least probability are calibrated on variants held out of the fit. A prediction counts once enough of a template's
trigrams stand in the paragraph. Scanning uses DataFrame functions only; the n-gram tables are as large as the notices and broadcast.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let
from .ngram_join import keyed

#: Common notices of each family.
TEMPLATES = {
    "MIT": ("Released under the MIT License", "Licensed under the MIT license", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Distributed under the Apache 2.0 license", "This project is licensed under the Apache License 2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3", "Released under the GNU GPL version 2 or later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL v3"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "Released under the LGPL v3"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3", "Released under the AGPL v3", "under the terms of the GNU Affero General Public License"),
    "BSD": ("Licensed under the BSD 3-Clause License", "Released under the 2-clause BSD license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "Released under the MPL 2.0 license"),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under the CC BY 3.0 license"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under the CC BY-NC 3.0 license"),
    "CC0": ("Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work", "This work is dedicated to the public domain"),
    "Proprietary": ("All rights reserved", "Copyright. All rights reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission", "This software is proprietary and confidential. Unauthorized copying is strictly prohibited"),
}
#: Sentences with the notices' words that are no notices.
OTHERS = (
    "The driver had no license and paid a fine", "She got her license to practise medicine in version two of the exam", "The album was released under the name of the band", "He was released under the terms of the agreement",
    "The general public was not under any risk", "Students of MIT released the results of their work", "Apache helicopters were distributed under the plan", "The public library is free for all citizens", "A creative mind is common to all artists",
    "The permission to use the hall was granted by the city", "This file is subject to change", "Commercial licences are sold by the council", "The attribution of the painting to the master is not certain", "All members reserved a seat in the hall",
    "The copyright debate in parliament went on", "You may not use this door", "The software is used by the general staff", "The foundation is free of charge for any person", "This work is under way in the north", "It is licensed to the state by the ministry",
    "The terms of the contract are as follows", "The source of the river is in the public domain", "Version 3 of the plan was released", "The notice was published by the foundation", "The following conditions were met by the team", "The work was dedicated to the public",
)
UNKNOWN = "unknown"
#: A run without any of these as a substring holds less than CONFIRM of each template's trigrams, so it needs no score. Those that the property rests on lie
#: within one token each, so that no hyphen or double space parts them.
CUES = (
    "licen", "copyright", "copying", "rights", "permi", "redistribut", "domain", "gpl", "cc by", "cc0", "mpl", "software", "waived", "compliance", "released", "3.0", "4.0", "commons", "apache", "affero", "clause", "binary",
    "modification", "mozilla", "subject", "dedicated", "publication", "reproduced", "obtaining", "documentation", "except",
)
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
GRAMS = (1, 2, 3)
#: Share of a template's trigrams that a paragraph holds to confirm it, and passes and weight decay of the fit.
CONFIRM, PASSES, DECAY = 0.6, 400, 1e-3
#: Trigrams that make two overlapping runs readings of the same words (LGPL headers hold most of the GPL's).
SISTER = 3
#: Words of the longest template; a notice may be wrapped over lines that hold so many between its first and last.
WIDE = max(len(re.findall(TOKEN, t.lower())) for texts in TEMPLATES.values() for t in texts)


def grams(text: str) -> list[tuple[str, ...]]:
    words = re.findall(TOKEN, text.lower())
    return [tuple(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)]


def _variants(text: str, rng: np.random.Generator) -> list[str]:
    """The notice between other words, without a word, and without its end."""
    words, filler = text.split(), "and the a of in it was for on by with that from".split()
    pad = lambda: " ".join(rng.choice(filler, rng.integers(0, 8)))
    out = [text, f"{pad()} {text} {pad()}"]
    for _ in range(3):
        k = int(rng.integers(0, len(words)))
        out.append(f"{pad()} {' '.join(words[:k] + words[k + 1 :])}" if len(words) > 5 else f"{text} {pad()}")
    return out


@cache
def model() -> tuple[list[str], dict[tuple[str, ...], np.ndarray], np.ndarray, float, float]:
    """Families, weights of each n-gram, intercepts, temperature and least probability."""
    rng, families = np.random.default_rng(5), [UNKNOWN, *TEMPLATES]
    rows: list[tuple[str, int, bool]] = []
    for k, family in enumerate(families[1:], 1):
        for t in TEMPLATES[family]:
            rows += [(v, k, i < 4) for i, v in enumerate(_variants(t, rng))]
    for i, t in enumerate(OTHERS):
        rows += [(v, 0, i % 5 != 4) for v in _variants(t, rng)]
    vocabulary = {g: i for i, g in enumerate(sorted({g for t, _, _ in rows for g in grams(t)}))}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([k for _, k, _ in rows])
    for r, (t, _, _) in enumerate(rows):
        x[r, [vocabulary[g] for g in grams(t)]] = 1
    fit = np.array([f for _, _, f in rows])
    w, b, goal = np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), np.eye(len(families))[y[fit]]
    softmax = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(PASSES):
        d = (softmax(x[fit] @ w + b) - goal) / fit.sum()
        w -= 2.0 * (x[fit].T @ d + DECAY * w)
        b -= 2.0 * d.sum(0)
    z, own = x[~fit] @ w + b, y[~fit]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean()
    temperature = float(min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss))
    p = softmax(z / temperature)
    others = p[own == 0][:, 1:].max(1)
    least = float(np.clip(others.max() + 0.02 if len(others) else 0.5, 0.3, 0.6))
    return families, {g: w[i] for g, i in vocabulary.items()}, b, temperature, least


def _runs(low, cue):
    """The runs of lines to score: structs of first and last line, words, and whether a line has a cue.

    A run begins at any line and goes on while the lines between its first and last hold fewer than WIDE words and each has one, so a notice wrapped
    over lines has a run of just its lines. Of the first and last of several lines only the WIDE words next to the others count.
    """

    def of_line(rows, i):
        ahead = F.aggregate(
            F.slice(rows, i + 1, F.lit(WIDE)), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda s, r: let(s["open"] & (s["used"] < WIDE) & (F.size(r["w"]) > 0), lambda go: F.struct((s["used"] + F.when(go, F.size(r["w"])).otherwise(0)).alias("used"), (s["n"] + go.cast("int")).alias("n"), go.alias("open"))),
        )["n"]

        def run(d):
            first, last = F.element_at(rows, i)["w"], F.element_at(rows, i + d)["w"]
            within = F.flatten(F.transform(F.slice(rows, i + 1, F.greatest(d - 1, F.lit(0))), lambda r: r["w"]))
            several = F.concat(F.slice(first, F.greatest(F.size(first) - WIDE + 1, F.lit(1)), F.lit(WIDE)), within, F.slice(last, F.lit(1), F.lit(WIDE)))
            return F.struct((i - 1).alias("line"), (i - 1 + d).alias("last"), F.when(d == 0, first).otherwise(several).alias("w"), F.exists(F.slice(rows, i, d + 1), lambda r: r["cue"]).alias("cue"))

        return F.filter(F.transform(F.sequence(F.lit(0), ahead), run), lambda r: r["cue"])

    def of_text(rows):
        starts = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (F.size(F.element_at(rows, i)["w"]) > 0) & F.exists(F.slice(rows, i, F.lit(WIDE + 1)), lambda r: r["cue"]))
        return F.flatten(F.transform(starts, lambda i: of_line(rows, i)))

    return let(F.transform(F.split(low, r"\n"), lambda p: F.struct(F.regexp_extract_all(p, F.lit(f"({TOKEN})"), F.lit(1)).alias("w"), cue(p).alias("cue"))), of_text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_notices, families (sorted, comma-joined), top_family, top_score, n_unconfirmed.

    Paragraphs are single lines and runs of lines (see _runs). Of a family's confirmed runs those count that hold no narrower one; of two that
    overlap, are of different families and rest on SISTER trigrams in common, the one with the smaller share of its template does not; n_notices is the
    most that do not overlap within a family. n_unconfirmed counts lines with a cue and a prediction that are in no notice. Null and empty texts have no notice: families is
    empty, top_family ``unknown``, top_score 0. Ties go to the family that comes first by name. Rows of repeated or null ids are scanned for
    themselves; an empty table gives no rows.
    """
    spark = docs.sparkSession
    families, weights, bias, temperature, least = model()
    own = keyed(docs, id_col)
    low = F.lower(F.col(text_col))
    cue = lambda c: F.greatest(*(F.contains(c, F.lit(x)) for x in CUES))
    words = own.select("__key", low.alias("_low")).filter(cue(F.col("_low"))).select("__key", F.explode(_runs(F.col("_low"), cue)).alias("r")).select("__key", "r.line", "r.last", "r.w")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    each = words.select("__key", "line", "last", F.explode(F.array_distinct(F.concat(*(F.when(F.size("w") >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in GRAMS)))).alias("gram"))
    templates = [(family, {g for g in grams(text) if len(g) == 3}) for family, texts in TEMPLATES.items() for text in texts]
    held = lambda g: [t for t, (_, own_grams) in enumerate(templates) if g in own_grams]
    table = spark.createDataFrame([(" ".join(g), [float(v) for v in w], i, held(g)) for i, (g, w) in enumerate(weights.items())], "gram string, w array<double>, g int, t array<int>")
    sums = [F.sum(F.element_at("w", k + 1)).alias(f"z{k}") for k in range(len(families))]
    scored = each.join(F.broadcast(table), "gram").groupBy("__key", "line", "last").agg(*sums, F.collect_list(F.when(F.size("t") > 0, F.struct("g", "t"))).alias("hits"))
    z = F.array(*((F.col(f"z{k}") + float(bias[k])) / temperature for k in range(len(families))))
    scored = scored.select("__key", "line", "last", "hits", z.alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("z")))
    scored = scored.withColumn("b", F.array_max(F.transform(F.slice("z", F.lit(2), F.lit(len(families) - 1)), lambda v, i: F.struct(v.alias("z"), (-i).alias("order")))))
    p = F.exp(F.col("b.z") - F.array_max("z")) / total
    sizes = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("t"), F.lit(len(g)).alias("n")) for t, (f, g) in enumerate(templates)))
    best = scored.select("__key", "line", "last", "hits", p.alias("p"), F.element_at(F.array(*(F.lit(f) for f in families[1:])), 1 - F.col("b.order")).alias("family")).filter(F.col("p") >= least)
    of_template = lambda t: F.filter("hits", lambda h: F.array_contains(h["t"], t))
    most = F.array_max(F.transform(F.filter(sizes, lambda s: s["family"] == F.col("family")), lambda s: F.struct((F.size(of_template(s["t"])) / s["n"]).alias("share"), (-s["t"]).alias("t"))))
    found = best.withColumn("most", most).withColumns({"share": F.col("most.share"), "held": of_template(-F.col("most.t"))["g"]}).drop("hits")
    found = found.withColumn("ok", F.col("share") >= CONFIRM).filter((F.col("line") == F.col("last")) | F.col("ok"))
    about = Window.partitionBy("__key").orderBy("line").rangeBetween(-WIDE, WIDE)
    near = lambda c: F.collect_list(F.when(F.col(c), F.struct("line", "last", "family", "share", "held"))).over(about)
    inside = lambda a, b: (a["line"] >= b["line"]) & (a["last"] <= b["last"])
    me = {c: F.col(c) for c in ("line", "last", "family", "share", "held")}
    narrower = lambda o: (o["family"] == me["family"]) & inside(o, me) & ((o["line"] != me["line"]) | (o["last"] != me["last"]))
    better = lambda o: (o["family"] != me["family"]) & (o["share"] > me["share"]) & (o["line"] <= me["last"]) & (me["line"] <= o["last"]) & (F.size(F.array_intersect(o["held"], me["held"])) >= SISTER)
    found = found.withColumn("near", near("ok")).withColumn("least", F.col("ok") & ~F.exists("near", narrower))
    found = found.withColumn("near", near("least")).withColumn("kept", F.col("least") & ~F.exists("near", better))
    found = found.withColumn("near", near("kept")).withColumn("alone", ~F.col("ok") & ~F.exists("near", lambda o: inside(me, o)))
    apart = F.aggregate(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("last", "line")))), F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), lambda s, r: F.when(r["line"] > s["end"], F.struct(r["last"].alias("end"), (s["n"] + 1).alias("n"))).otherwise(s))
    per = found.groupBy("__key", "family").agg(apart["n"].alias("n"), F.max(F.when(F.col("kept"), F.col("p"))).alias("p"), F.count_if("alone").alias("alone"))
    top = F.min(F.when(F.col("n") > 0, F.struct((-F.col("p")).alias("p"), F.col("family"))))
    per = per.groupBy("__key").agg(F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("family")))), ",").alias("families"), top["family"].alias("top_family"), (-top["p"]).alias("top_score"), F.sum("alone").alias("n_unconfirmed"))
    out = own.select("__key", F.col(id_col).alias("doc_id")).join(per, "__key", "left")
    return out.select("doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("top_family", F.lit(UNKNOWN)).alias("top_family"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"))
