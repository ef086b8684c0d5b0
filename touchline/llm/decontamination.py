"""Benchmark decontamination with a generalised suffix automaton.

The normalised items are inserted into one automaton. Training tokens stream through it: after every token the automaton
knows the longest suffix that stands somewhere in an item, so a window of ``window`` words ends wherever that length
reaches ``window``; an item shorter than the window ends wherever its own state lies on the suffix path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import UPPER, WORD, in_chunks, texts_of
from touchline.session import stage

#: Words of items in one automaton. Larger benchmarks are matched in blocks of this size, each in a pass of its own.
BLOCK_WORDS = 200_000

_WORD = re.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


@dataclass
class Automaton:
    """Suffix automaton over word numbers; state 0 is the root."""

    window: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items whose window is the string of ``window`` words that a state ends with, or the whole short item.
    full: dict[int, frozenset[str]] = field(default_factory=dict)
    short: dict[int, tuple[int, frozenset[str]]] = field(default_factory=dict)
    #: State -> state on its suffix path that stands for the last ``window`` words.
    anchor: list[int] = field(default_factory=list)
    #: State -> short items on its suffix path, as (state) chain.
    shorts: list[tuple[int, ...]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[str, list[str]]], window: int) -> Automaton:
        a = cls(window)
        paths = [(item, [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, path in paths:
            last = 0
            for c in path:
                last = a._extend(last, c)
        a._mark(paths)
        return a

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:  # another item has been here
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _mark(self, paths: list[tuple[str, list[int]]]) -> None:
        n, window, full, short = len(self.length), self.window, {}, {}
        self.anchor = [-1] * n
        self.shorts = [()] * n
        ordered = sorted(range(1, n), key=self.length.__getitem__)
        for s in ordered:
            if self.length[s] >= window:
                self.anchor[s] = s if self.length[self.link[s]] < window else self.anchor[self.link[s]]
        for item, path in paths:
            s = 0
            for c in path:
                s = self.next[s][c]  # the whole prefix is a string of the automaton
                if self.length[s] >= window and self.anchor[s] >= 0:
                    full.setdefault(self.anchor[s], set()).add(item)
            if len(path) < window:
                short.setdefault(s, (len(path), set()))[1].add(item)
        self.full = {s: frozenset(x) for s, x in full.items()}
        self.short = {s: (k, frozenset(x)) for s, (k, x) in short.items()}
        for s in ordered:
            self.shorts[s] = self.shorts[self.link[s]] + ((s,) if s in short else ())

    def scan(self, tokens: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items with windows here."""
        move, link, length, anchor, shorts, window = self.next, self.link, self.length, self.anchor, self.shorts, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for i, c in enumerate(map(self.vocabulary.get, tokens)):
            if c is None:
                state = matched = 0
                continue
            to = move[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = move[state].get(c)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            back = 0
            if matched >= window:
                back = window
                # The state holds strings of several lengths; the anchor stands for the one of ``window`` words.
                found.add(anchor[state])
            for s in shorts[state]:
                if length[s] <= matched:
                    back = max(back, self.short[s][0])
                    found.add(-s - 1)
            if back:
                a = i + 1 - back
                if spans and a <= spans[-1][1]:
                    a = min(a, spans[-1][0])
                    spans[-1] = (a, i + 1)
                else:
                    spans.append((a, i + 1))
        items: set[str] = set()
        for s in found:
            items |= self.full.get(s, frozenset()) if s >= 0 else self.short[-s - 1][1]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


MATCHES = "doc_id string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Items in blocks of bounded size. They arrive partition by partition; the driver holds one block."""
    block, size = [], 0
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for row in rows.toLocalIterator():
        tokens = normal_words(row.text)
        if not tokens:
            continue
        if block and size + len(tokens) > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, tokens))
        size += len(tokens)
    yield block


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document ``doc_id, n_words, spans, items``: merged spans of hit words and the ids of the items found, sorted.

    Words are those of ``common.WORD`` after A-Z are lower-cased. A null text has no words; a null item text is no item
    and a null item id counts as ''. One row comes out for every row that goes in, repeated rows included. The benchmark is
    cut into blocks of ``block_words`` words (one longer item is a block of its own); with one block nothing is shuffled,
    with more, the documents are read once for each block and their spans meet by row.
    """
    spark = documents.sparkSession
    found, several = None, False
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, pandas keeps nulls and digits
    for block in _blocks(benchmark, block_words):
        automaton = spark.sparkContext.broadcast(Automaton.of(block, window))

        def run(frames: Iterator[pd.DataFrame], automaton=automaton) -> Iterator[pd.DataFrame]:
            a = automaton.value
            for pdf in in_chunks(frames):
                out = []
                for doc_id, text in zip(pdf["doc_id"], texts_of(pdf["text"]), strict=True):
                    tokens = normal_words(text)
                    spans, items = a.scan(tokens)
                    out.append((doc_id, len(tokens), [{"start": s, "end": e} for s, e in spans], sorted(items)))
                rows = pd.DataFrame(out, columns=["doc_id", "n_words", "spans", "items"])
                if "row" in pdf:
                    rows["row"] = pdf["row"].to_numpy()
                yield rows

        if found is None:
            found = docs.mapInPandas(run, MATCHES)
            first = run
            continue
        if not several:  # a key of its own for every row, written once so that all blocks see the same
            several = True
            docs = stage(docs.withColumn("row", F.monotonically_increasing_id()))
            found = docs.mapInPandas(first, MATCHES + ", row long")
        found = found.unionByName(docs.mapInPandas(run, MATCHES + ", row long"))
    if not several:
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))
    gathered = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    join = (
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) -> case "
        "when size(acc) > 0 and s.start <= element_at(acc, -1).end then concat(slice(acc, 1, size(acc) - 1), array(named_struct("
        "'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) else concat(acc, array(s)) end)"
    )
    return gathered.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.expr(join).alias("spans"), "items")


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", parts: int = 20) -> Column:
    """At least one hit word, and at least one word in ``parts`` hit."""
    return (F.col(n_hit) > 0) & (F.lit(parts) * F.col(n_hit) >= F.col(n_words))


def report(documents: DataFrame, benchmark: DataFrame, window: int = 13, parts: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` per document."""
    return matches(documents, benchmark, window).select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "spans",
    ).withColumn("contaminated", contaminated(parts=parts))


def _spans_function(automaton: Broadcast):  # noqa: ANN202
    @F.pandas_udf("array<struct<start:long,end:long>>")
    def spans_of(text: pd.Series) -> pd.Series:
        a = automaton.value
        return pd.Series([[{"start": s, "end": e} for s, e in a.scan(normal_words(t))[0]] for t in texts_of(text)])

    return spans_of


def _judge(automaton: Broadcast, parts: int, cut_words: int | None):  # noqa: ANN202
    """Text as it goes on, and whether it goes at all; ``spans`` are those of other blocks."""

    @F.pandas_udf("text string, dirty boolean")
    def judged(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        a, out = automaton.value, []
        for t, more in zip(text, spans, strict=True):
            if not isinstance(t, str):
                out.append((None, False))
                continue
            tokens = normal_words(t)
            joined = merged(a.scan(tokens)[0] + [(x["start"], x["end"]) for x in more])
            hit, left, last = sum(e - s for s, e in joined), [], 0
            if cut_words is not None and joined:
                at = [m.span() for m in _WORD.finditer(t.translate(_LOWER))]
                for s, e in joined:
                    if e - s >= cut_words:
                        left.append(t[last : at[s][0]])
                        last = at[e - 1][1]
            out.append(("".join([*left, t[last:]]) if left else t, hit > 0 and parts * hit >= len(tokens)))
        return pd.DataFrame(out, columns=["text", "dirty"])

    return judged


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 13, parts: int = 20, cut_words: int | None = None) -> DataFrame:
    """The documents without contaminated ones, columns as they came. With ``cut_words``, hit spans of at least that many
    words are cut from the texts that stay (``n_chars`` follows if the column is there).

    Rows are judged on their own, inside their partition: nothing is joined back and repeated rows share their fate. A null
    text is clean.
    """
    spark, fields = documents.sparkSession, documents.schema
    kept, automaton = documents, None
    for block in _blocks(benchmark, BLOCK_WORDS):
        if automaton is not None:
            kept = kept.withColumn(f"__spans_{len(kept.columns)}", _spans_function(automaton)("text"))
        automaton = spark.sparkContext.broadcast(Automaton.of(block, window))
    names = [c for c in kept.columns if c not in documents.columns]
    others = F.flatten(F.array(*names)) if names else F.array().cast("array<struct<start:bigint,end:bigint>>")
    kept = kept.withColumn("__judged", _judge(automaton, parts, cut_words)("text", others)).filter(~F.col("__judged.dirty"))
    changed = {}
    if cut_words is not None:
        changed["text"] = F.col("__judged.text")
        if "n_chars" in documents.columns:
            changed["n_chars"] = F.when(F.col("__judged.text") != F.col("text"), F.length("__judged.text")).otherwise(F.col("n_chars"))
    return kept.select(*[changed.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in fields])
