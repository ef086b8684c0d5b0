"""License scan by diagonal voting.

Every rolling word k-gram of a document is joined, by hash, to the positions where license templates hold it. Hits of one
template on one diagonal (document position less template position) form runs; runs of neighbouring diagonals merge, so that a few
inserted or missing words do not break a span; merged spans are verified by the words they share with the template.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import words
from touchline.session import stage

#: Words of a k-gram: no longer than the shortest template.
GRAM = 2
#: Template positions that may be broadcast; with more the join is left to Spark.
BROADCAST_POSITIONS = 200_000
#: Diagonals of one span lie at most so far apart, and so many words may pass between its hits.
SHIFT = 3
GAP = 12


@dataclass(frozen=True)
class Template:
    """A phrase is found where all its words stand in a row; other templates by the share of their words in a span."""

    name: str
    label: str
    text: str
    phrase: bool = False
    share: float = 0.6


#: Fixed values of the contract: base phrases and their labels.
PHRASES = (
    Template("mit license", "mit", "mit license", True),
    Template("apache license", "apache", "apache license", True),
    Template("general public license", "gpl", "general public license", True),
)

#: Opening sentences of public licenses, in their published wording.
NOTICES = (
    Template("mit permission", "mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache notice", "apache", "you may not use this file except in compliance with the License You may obtain a copy of the License at"),
    Template("gpl notice", "gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd notice", "bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    Template("isc notice", "isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc by-nc", "cc-by-nc", "cc by nc 4 0", True),
    Template("cc by-sa", "cc-by-sa", "cc by sa 4 0", True),
    Template("cc by", "cc-by", "cc by 4 0", True),
    Template("cc0", "cc0", "cc0 1 0", True),
    Template("all rights reserved", "reserved", "all rights reserved", True),
    Template("creative commons", "cc", "creative commons attribution", True),
)


def gram_hash(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def template_positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``g, t_pos, w0, w1, template, label, phrase, share, t_words`` for every k-gram of every template."""
    rows = [(t.name, t.label, t.text, t.phrase, float(t.share)) for t in templates]
    df = spark.createDataFrame(rows, "template string, label string, text string, phrase boolean, share double")
    df = df.withColumn("w", words("text")).withColumn("t_words", F.size("w"))
    df = df.filter(F.col("t_words") >= GRAM).select("*", F.explode(F.sequence(F.lit(0), F.col("t_words") - GRAM)).alias("t_pos"))
    w0, w1 = F.element_at("w", F.col("t_pos") + 1), F.element_at("w", F.col("t_pos") + 2)
    return df.select(gram_hash(w0, w1).alias("g"), "t_pos", w0.alias("w0"), w1.alias("w1"), "template", "label", "phrase", "share", "t_words")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hits(documents: DataFrame, positions: DataFrame) -> DataFrame:
    """``doc_id, key, template ..., d_pos, t_pos``: a document's k-gram that a template holds, once for repeated rows.

    Equal hashes are confirmed on the words, so a hit is never a collision.
    """
    small = positions.count() <= BROADCAST_POSITIONS
    positions = F.broadcast(positions) if small else positions
    docs = documents.select("doc_id", text_key().alias("key"), words("text").alias("w")).filter(F.size("w") >= GRAM)
    # The last word pairs with itself; no template is found there because positions end one earlier.
    pair = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    grams = docs.select("doc_id", "key", F.posexplode(pair).alias("d_pos", "p")).select("doc_id", "key", "d_pos", F.col("p.a").alias("a"), F.col("p.b").alias("b")).filter(F.col("b").isNotNull())
    met = grams.withColumn("g", gram_hash(F.col("a"), F.col("b"))).join(positions, "g").filter((F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")))
    return met.select("doc_id", "key", "template", "label", "phrase", "share", "t_words", "d_pos", "t_pos").distinct()


def merged_runs(hits_: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Hits ``(d_pos, t_pos)`` in document order, split into merged runs.

    A hit continues the run of its own diagonal, and merges it with those of diagonals at most SHIFT away, where their last
    hit is at most GAP back. Hits of other diagonals in between, as of a pair of words that a template has twice, part nothing.
    """
    up, last = list(range(len(hits_))), {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (d, t) in enumerate(hits_):
        for diagonal in range(d - t - SHIFT, d - t + SHIFT + 1):
            j = last.get(diagonal)
            if j is not None and d - hits_[j][0] <= GAP:
                one, two = root(i), root(j)
                up[max(one, two)] = min(one, two)
        last[d - t] = i
    out: dict[int, list[tuple[int, int]]] = {}
    for i, hit in enumerate(hits_):
        out.setdefault(root(i), []).append(hit)
    return list(out.values())


def _windows(run: Sequence[tuple[int, int]], t_words: int, least: float) -> list[tuple[int, int, int]]:
    """``-covered, words, start`` of the tightest window up to every hit that is short enough and covers enough."""
    count, covered, left, out = [0] * (t_words + 1), 0, 0, []
    for d, t in run:
        for x in range(t, t + GRAM):
            covered += not count[x]
            count[x] += 1
        while d + GRAM - run[left][0] > 2 * t_words or all(count[x] > 1 for x in range(run[left][1], run[left][1] + GRAM)):
            for x in range(run[left][1], run[left][1] + GRAM):
                count[x] -= 1
                covered -= not count[x]
            left += 1
        if covered / t_words >= least:
            out.append((-covered, d + GRAM - run[left][0], run[left][0]))
    return out


def verified(run: Sequence[tuple[int, int]], t_words: int, least: float) -> list[tuple[int, int, float]]:
    """``start, end, share`` of the spans of a merged run that cover ``least`` of the template's words, each word once.

    A span has at most twice the template's words. A longer run, as of a text that repeats parts of a template, gives its
    best windows that do not meet, and those of what they leave.
    """
    start, end = run[0][0], run[-1][0] + GRAM
    if end - start <= 2 * t_words:
        share = len({x for _, t in run for x in range(t, t + GRAM)}) / t_words
        return [(start, end, share)] if share >= least else []
    out, rest = [], [list(run)]
    while rest:
        run, taken = rest.pop(), []
        for covered, words_, at in sorted(_windows(run, t_words, least)):
            i = bisect_left(taken, (at, at))
            if (i == 0 or taken[i - 1][1] <= at) and (i == len(taken) or taken[i][0] >= at + words_):
                insort(taken, (at, at + words_))
                out.append((at, at + words_, -covered / t_words))
        if taken:
            places, i = [d for d, _ in run], 0
            for at, to in [*taken, (places[-1] + GRAM, 0)]:
                part = run[i : bisect_left(places, at - GRAM + 1)]
                rest += [part] if part else []
                i = bisect_left(places, to)
    return sorted(out)


LONG_SPANS = "doc_id string, key long, template string, label string, start int, end int, share_found double"


def spans(hits_: DataFrame) -> DataFrame:
    """``doc_id, key, template, label, start, end, share_found``: verified spans, word positions, end exclusive."""
    who = ["doc_id", "key", "template"]
    what = ["label", "phrase", "share", "t_words"]
    diagonal = hits_.withColumn("diagonal", F.col("d_pos") - F.col("t_pos"))
    # Votes: a phrase needs every one of its k-grams on one diagonal.
    votes = diagonal.filter("phrase").groupBy(*who, *what, "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    phrases = votes.filter(F.col("votes") == F.col("t_words") - (GRAM - 1))
    phrases = phrases.select(*who, "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("t_words")).alias("end"), F.lit(1.0).alias("share_found"))
    # Longer templates: one row per document and template, bounded by the document's length. Where all hits together cover
    # too few of the template's words, no span of them can do.
    places = F.sort_array(F.collect_list(F.struct("d_pos", "t_pos")))
    met = hits_.filter("not phrase").groupBy(*who, *what).agg(places.alias("at"), F.collect_set("t_pos").alias("t"))
    met = met.filter(F.size(F.array_distinct(F.flatten(F.transform("t", lambda t: F.array(*[t + i for i in range(GRAM)]))))) / F.col("t_words") >= F.col("share"))
    met = met.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "template", "label", "share", "t_words", F.col("at.d_pos").alias("d"), F.col("at.t_pos").alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [
                (r.doc_id, r.key, r.template, r.label, *span)
                for r in pdf.itertuples()
                for part in merged_runs(list(zip(r.d.tolist(), r.t.tolist(), strict=True)))
                for span in verified(part, r.t_words, r.share)
            ]
            yield pd.DataFrame(out, columns=[*who, "label", "start", "end", "share_found"])

    long = met.mapInPandas(run, LONG_SPANS).withColumn("doc_id", F.col("doc_id").cast("long"))
    return phrases.unionByName(long)


def report(documents: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, base: tuple[Template, ...] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans`` per document row.

    ``n_base`` counts every place of a base phrase, ``score`` is the largest share of a template found (0 to 1). A null text
    is empty; repeated rows each get the same answer; rows with one doc_id and different texts are judged apart. Only hits
    are shuffled, never texts: a document without hits costs its words and one row of the last join. The hits are written
    once to the shared folder, as phrases and longer templates both read them.
    """
    positions = template_positions(documents.sparkSession, templates)
    found = spans(stage(hits(documents, positions)))
    is_base = F.col("template").isin([t.name for t in base])
    # A document's spans are bounded by its own length; labels by the templates.
    per_doc = found.groupBy("doc_id", "key").agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share_found").alias("score"), F.count(F.lit(1)).alias("n_spans"),
    )
    docs = documents.select("doc_id", text_key().alias("key"), F.size(words("text")).cast("long").alias("n_words"))
    met = docs.alias("d").join(per_doc.alias("p"), (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.col("d.key") == F.col("p.key")), "left")
    zero = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return met.select(
        "d.doc_id", "d.n_words", zero("n_base"), "p.first_word", "p.last_word", text("base_labels"), text("labels"),
        F.least(F.lit(1.0), F.coalesce("p.score", F.lit(0.0))).alias("score"), zero("n_spans"),
    )
