"""Secret scan with multipart credential linking.

Patterns find strong secrets on their own. Access identifiers, bare secrets and endpoints are weak: each is common in clean
text. Within a scope (a block of a document's lines) the three kinds are joined by distance, and a weak part is reported
only if a complementary part, weak or strong, stands near enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import in_chunks, texts_of
from touchline.session import stage

#: Fixed values of the contract, in its order of kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more; the look-behind only spares the search the inside of a run.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weak parts, of any length. Kinds that the method adds come after the base ones. The look-behind keeps the search linear.
WEAK_KINDS = ("identifier", "opaque", "endpoint")
IDENTIFIER = re.compile(r"""(?ai:\b(?:user(?:name)?|login|account|client_?id|key_?id|tenant))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?a:\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,})")
KINDS = BASE_KINDS + WEAK_KINDS

#: Lines apart that two parts may stand, inside one scope. A scope ends at a blank line.
LINES = 5

PARTS = "doc_id string, parts array<struct<kind:string,start:long,end:long,role:string,weak:boolean,scope:long,line:long>>"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    if "://" in text:
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.5:
            out.append(("opaque", *m.span()))
    return out


#: What a kind is part of a credential as. A base assignment or hex run is a secret, an access key an identifier.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "opaque": "secret", "endpoint": "endpoint"}


def parts_of(text: str) -> list[dict]:
    """Base spans and weak candidates with their scope and line; weak ones that meet a base span or another weak one are left out."""
    base = base_spans(text)
    weak = weak_spans(text)
    if not weak:
        return [{"kind": k, "start": s, "end": e, "role": ROLE[k], "weak": False, "scope": 0, "line": 0} for k, s, e in base]
    covered = sorted((s, e) for _, s, e in base)
    kept, at, last = [], 0, 0
    for k, s, e in sorted(weak, key=lambda x: x[1]):
        while at < len(covered) and covered[at][0] < e:
            last = max(last, covered[at][1])
            at += 1
        if last <= s:
            kept.append((k, s, e))
            last = e
    out, pos, line, scope, blank = [], 0, 0, 0, False
    for k, s, e in sorted(base + kept, key=lambda x: x[1]):
        gap = text[pos:s]
        line += gap.count("\n")
        scope += len(re.findall(r"\n[\x20\t\r]*\n", text[max(0, pos - 1) : s]))
        pos = s
        out.append({"kind": k, "start": s, "end": e, "role": ROLE[k], "weak": k in WEAK_KINDS, "scope": scope, "line": line})
    return out


def parts(documents: DataFrame) -> DataFrame:
    """``row, doc_id, parts``, written once: the row key stays what it is when a task is run again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_chunks(frames):
            yield pd.DataFrame({"doc_id": list(pdf["doc_id"]), "parts": [parts_of(t) for t in texts_of(pdf["text"])]})

    found = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PARTS)
    return stage(found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()))


def linked(found: DataFrame, lines: int = LINES) -> DataFrame:
    """``row, linked``: weak parts with a complementary part within ``lines`` lines of the same scope, in either direction.

    An interval join by sorting: the nearest part of each role before and after decides, so no pairs are made. Complementary
    roles: an identifier or an endpoint needs a secret, a secret an identifier or an endpoint.
    """
    weak = F.exists("parts", lambda p: p["weak"])
    secret = F.exists("parts", lambda p: p["role"] == "secret")
    other = F.exists("parts", lambda p: p["role"] != "secret")
    flat = found.filter(weak & secret & other).select("row", F.inline("parts"))
    # Both directions run forward and remember the last part of a role: work grows with the parts of a scope, not their square.
    before = Window.partitionBy("row", "scope").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def gap(is_role: Column) -> Column:
        at = F.when(is_role, F.col("line"))
        back = F.col("line") - F.last(at, ignorenulls=True).over(before)
        ahead = F.last(at, ignorenulls=True).over(after) - F.col("line")
        return F.least(back, ahead)

    near = flat.withColumn("to_secret", gap(F.col("role") == "secret")).withColumn("to_other", gap(F.col("role") != "secret"))
    apart = F.when(F.col("role") == "secret", F.col("to_other")).otherwise(F.col("to_secret"))
    reported = near.filter(F.col("weak") & (apart <= lines)).select("row", F.struct("kind", "start", "end").alias("s"))
    return reported.groupBy("row").agg(F.collect_list("s").alias("linked"))  # bounded by the length of one document


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document row; positions count code points.

    A null text is empty. Repeated rows each get a row of their own. Texts are read once; what goes on are the spans.
    """
    found = parts(documents)
    met = found.join(linked(found, lines), "row", "left")
    base = F.filter("parts", lambda p: ~p["weak"])
    plain = F.transform(base, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    count = lambda k: F.size(F.filter("parts", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat(plain, F.coalesce("linked", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    return met.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(plain, KINDS), 256).alias("base_sha256"), span_text(every, KINDS).alias("spans"),
    )
