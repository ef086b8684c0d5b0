"""Personal data by exact patterns and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table by maximum likelihood and decoded by Viterbi, many segments at a time. A
decoded span is added if it passes the exact check of its kind and meets no pattern's span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import in_chunks, texts_of
from touchline.llm.secret_scan import span_text

#: Fixed values of the contract, in its order of kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behind only spares the search the inside of a run of digits; a match always ends with its run.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds the field adds; they come after the base ones.
ADDED = ("crf_email", "crf_phone", "crf_card", "crf_id")
KINDS = BASE_KINDS + ADDED


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(map(int, digits[-1::-2])) + sum(double[int(c)] for c in digits[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping. From each sign the local part runs back to the last match, so no run is read twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain and at >= last:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return out


DIGIT = re.compile(r"[0-9]")
#: Every span the field may add holds a digit or the sign; other segments are not decoded.
TELLING = re.compile(r"[0-9@]")
SEGMENT = re.compile(r"(?:[^\n.!?;]|[.!?;](?!\s))+")
TOKEN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^\sA-Za-z0-9\u0080-\U0010ffff]")

CUES = frozenset(("tel", "phone", "call", "fax", "mobile", "cell", "card", "visa", "ssn", "social", "id", "no", "number", "mail", "email", "contact"))
SIGNS = {c: i for i, c in enumerate("@.-+()/:_%,#")}
N_SHAPES = 5 + 8 + len(SIGNS) + 2
#: Shape and whether a blank stands before; the last one stands for the ends of a segment.
N_FEATURES = 2 * N_SHAPES + 1
LABELS = ("o", "crf_email", "crf_phone", "crf_card", "crf_id")
#: Neighbours whose shapes a label's score looks at.
WINDOW = (-2, -1, 0, 1, 2)


def shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return 5 + (n - 1 if n <= 4 else 4 if n <= 8 else 5 if n <= 13 else 6 if n <= 19 else 7)
    if c.isalpha() or c > "\x7f":
        if token.lower() in CUES:
            return N_SHAPES - 1
        if token.islower():
            return 0 if len(token) <= 3 else 1
        return 3 if token.isupper() and len(token) > 1 else 2 if token[:1].isupper() and token[1:].islower() else 4
    return 13 + SIGNS.get(c, len(SIGNS))


def tokens_of(text: str, start: int = 0, end: int | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    features, spans, last = [], [], start
    for m in TOKEN.finditer(text, start, len(text) if end is None else end):
        features.append(2 * shape(m.group()) + (m.start() > last))
        spans.append(m.span())
        last = m.end()
    return features, spans


#: The labelled table: marked spans of each kind in short lines, and lines without any.
TABLE = (
    "call <crf_phone>(377) 555-0271</crf_phone> today", "phone: <crf_phone>555-123-4567</crf_phone>", "tel <crf_phone>020 7946 0958</crf_phone> or write",
    "reach me at <crf_phone>(212) 555-0199</crf_phone>, please", "fax <crf_phone>415.555.0132</crf_phone>", "mobile <crf_phone>07700 900123</crf_phone> after six",
    "her number is <crf_phone>(030) 901-820</crf_phone> in town", "contact <crf_phone>650-555-0100</crf_phone> ext 4", "Tel. <crf_phone>555-867-5309</crf_phone>",
    "write to <crf_email>mary.smith@example</crf_email> soon", "mail <crf_email>j.doe@localhost</crf_email> for more", "email: <crf_email>admin@intranet</crf_email>",
    "from <crf_email>bob_jones@mailhost</crf_email> on friday", "send it to <crf_email>ann-lee@office</crf_email>, thanks",
    "card <crf_card>4111 1111 1111 1</crf_card> expires", "visa <crf_card>4222-2222-2222-2</crf_card>", "paid with card <crf_card>4222222222222</crf_card> yesterday", "card no <crf_card>4917 6100 0000 0</crf_card>",
    "ssn <crf_id>078-05-1120</crf_id> on file", "social number <crf_id>219-09-9999</crf_id>", "his id is <crf_id>457-55-5462</crf_id>, he said", "SSN: <crf_id>123-45-6789</crf_id>",
    "we sold 12 of 340 units in 2019", "chapter 4, page 217 of the book", "in 1998 - 2004 the price rose 3.5 %", "the score was 21-17 at half time", "version 2.0.1 was released on 2021-03-04",
    "meet @ noon in room 12", "see figure 3 and table 14", "about 1,250,000 people live there", "order 66 has 3 items", "it costs 19.99 in total", "at 10:30 on 05/06/2020 we left",
    "Therou haesst anderin 42 whha", "the @ sign is a letter", "build 20190812 passed", "serial 839201748592 is old", "from 100-200 to 300-400 units", "ratio 3:2 and 16:9", "isbn 978 in print", "(see 1) and (2)",
    "lines 10-20 and 30-40", "a 4 x 4 grid of 16 cells", "year 2020, month 12, day 31", "size 12 3 45 fits",
)
_MARK = re.compile(r"<(/?)(\w+)>")


def labelled(row: str) -> tuple[list[int], list[int]]:
    """Features and labels of a marked line."""
    text, at, spans, opened = "", 0, [], 0
    for m in _MARK.finditer(row):
        text += row[at : m.start()]
        at = m.end()
        if m[1]:
            spans.append((opened, len(text), LABELS.index(m[2])))
        else:
            opened = len(text)
    text += row[at:]
    features, where = tokens_of(text)
    return features, [next((k for s, e, k in spans if s <= a and b <= e), 0) for a, b in where]


@dataclass
class Field:
    """Scores: shape of each neighbour by label, and label to label."""

    emit: np.ndarray  # (len(WINDOW), N_FEATURES, n labels)
    move: np.ndarray  # (n labels, n labels)

    def scores(self, features: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Label scores of all tokens of many segments that stand one after another."""
        n = len(features)
        segment = np.repeat(np.arange(len(length)), length)
        out = np.zeros((n, len(LABELS)))
        for w, offset in enumerate(WINDOW):
            at = np.arange(n) + offset
            inside = (at >= start[segment]) & (at < (start + length)[segment])
            out += self.emit[w][np.where(inside, features[np.clip(at, 0, n - 1)], N_FEATURES - 1)]
        return out

    def decode(self, segments: list[list[int]]) -> list[np.ndarray]:
        """Best labels of every segment. All segments that are long enough take each step together."""
        if not segments:
            return []
        length = np.array([len(s) for s in segments])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        scores = self.scores(np.concatenate([np.array(s, np.int64) for s in segments]), start, length)
        order = np.argsort(-length, kind="stable")
        first, n_at = start[order], length[order]
        best = scores[first].copy()
        back = np.zeros((int(length.sum()), len(LABELS)), np.int8)
        live = len(order)
        for t in range(1, int(n_at[0])):
            live = int(np.searchsorted(-n_at, -t, side="left"))
            path = best[:live, :, None] + self.move
            back[first[:live] + t] = path.argmax(axis=1)
            best[:live] = path.max(axis=1) + scores[first[:live] + t]
        labels = np.zeros(int(length.sum()), np.int8)
        state = best.argmax(axis=1)
        for t in range(int(n_at[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n_at, -t, side="left"))
            at = first[:live] + t
            labels[at] = state[:live]
            if t:
                state[:live] = back[at, state[:live]]
        return [labels[s : s + n] for s, n in zip(start, length, strict=True)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: tuple[str, ...] = TABLE, steps: int = 150, rate: float = 0.5, decay: float = 0.01) -> Field:
    """Maximum likelihood by gradient ascent: observed less expected counts, the latter by forward and backward sums."""
    rows = [labelled(r) for r in table]
    n_labels = len(LABELS)
    field = Field(np.zeros((len(WINDOW), N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)))
    for _ in range(steps):
        g_emit, g_move = np.zeros_like(field.emit), np.zeros_like(field.move)
        for features, labels in rows:
            f, y, n = np.array(features), np.array(labels), len(features)
            e = field.scores(f, np.array([0]), np.array([n]))
            ahead, behind = e.copy(), np.zeros_like(e)
            for t in range(1, n):
                ahead[t] += _logsum(ahead[t - 1][:, None] + field.move, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = _logsum(field.move + e[t + 1] + behind[t + 1], 1)
            z = _logsum(ahead[-1], 0)
            d = -np.exp(ahead + behind - z)
            d[np.arange(n), y] += 1
            for w, offset in enumerate(WINDOW):
                at = np.arange(n) + offset
                np.add.at(g_emit[w], np.where((at >= 0) & (at < n), f[np.clip(at, 0, n - 1)], N_FEATURES - 1), d)
            if n > 1:
                g_move -= np.exp(ahead[:-1, :, None] + field.move + (e + behind)[1:, None, :] - z).sum(axis=0)
                np.add.at(g_move, (y[:-1], y[1:]), 1)
        field.emit += rate * (g_emit / len(rows) * 4 - decay * field.emit)
        field.move += rate * (g_move / len(rows) * 4 - decay * field.move)
    return field


def holds(kind: str, s: str) -> bool:
    """The exact check of a decoded span."""
    d = digits_of(s)
    if kind == "crf_email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]", s) is not None
    if kind == "crf_phone":
        return 7 <= len(d) <= 15 and re.fullmatch(r"\(?[0-9]{2,5}\)?(?:[\x20.-]{1,2}[0-9]{2,6})+", s) is not None
    if kind == "crf_card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9][0-9\x20-]+[0-9]", s) is not None
    return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) is not None


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the field adds to each text. Segments of all texts are decoded together."""
    segments, where = [], []
    for i, text in enumerate(texts):
        if not TELLING.search(text):
            continue
        for m in SEGMENT.finditer(text):
            if TELLING.search(text, *m.span()):
                features, spans = tokens_of(text, *m.span())
                segments.append(features)
                where.append((i, spans))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, spans), labels in zip(where, field.decode(segments), strict=True):
        edge = np.flatnonzero(np.diff(labels, prepend=-1, append=-1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if labels[a]:
                kind, s, e = LABELS[labels[a]], spans[a][0], spans[b - 1][1]
                if holds(kind, texts[i][s:e]):
                    out[i].append((kind, s, e))
    for i, spans in enumerate(out):
        if spans:
            taken = sorted((s, e) for _, s, e in base[i])
            ends = np.array([e for _, e in taken])
            free = []
            for k, s, e in spans:
                # Base spans of different kinds may overlap; ends are made rising so that one search is enough.
                at = int(np.searchsorted(np.maximum.accumulate(ends), s, side="right")) if len(ends) else 0
                if at >= len(taken) or taken[at][0] >= e:
                    free.append((k, s, e))
            out[i] = free
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _structs(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def scan(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, base, added``: spans by pattern and by the field, positions in code points, end exclusive.

    Every row is scanned on its own, whole, and gives one row; a null text is empty. Nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or train())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_chunks(frames):
            texts = texts_of(pdf["text"])
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            yield pd.DataFrame({"doc_id": list(pdf["doc_id"]), "base": [_structs(x) for x in base], "added": [_structs(x) for x in added]})

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, f"doc_id string, base {SPANS}, added {SPANS}").withColumn("doc_id", F.col("doc_id").cast("long"))


def report(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per document row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(documents, field).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.concat("base", "added"), KINDS).alias("spans"),
    )
