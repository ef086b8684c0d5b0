"""Prefix trie, chat formatting and vector codes against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import CLASHING, as_set, with_clashes
from touchline.llm import chat_format, code_compression, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed=3):
    rng = random.Random(seed)
    first, second = "a common opening", "[INST] no mark </s> here \\[INST] <\\s> 😀"
    out = []
    for c in [*range(0, 40), 100, 101, 103, 105, 199, 250, 251, -3, -100, -101]:
        opening = [("user", first), ("assistant", second)][: rng.randint(0, 2)]
        rest = [(rng.choice(["user", "assistant", "system", "tool", "[TEXT]"]), rng.choice(["x", "y", "", "<<SYS>>", "long " * 30])) for _ in range(rng.randint(0, 7))]
        out += [(c, n, r, t) for n, (r, t) in enumerate(opening + rest)]
    out += [(300 + i, n, "user", f"copy {n}") for i in range(1, 30) for n in range(4)]  # copies without a base
    out += [(500, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(60)] + [(501, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(55)]
    out += [(600, None, None, None), (600, None, "user", "b"), (600, None, "user", "a"), (600, 2, "assistant", None), (600, 2, "assistant", None)]
    out += [(None, 0, "user", "nobody's"), (None, 1, "assistant", "none"), (601, 0, "user", ""), (602, 5, None, "")]
    rng.shuffle(out)
    return out


def trie(rows):
    conv = defaultdict(list)
    for i, turn, role, text in rows:
        if i is not None:
            conv[i].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    turns = {i: [(v[2], v[4]) for v in sorted(vs)] for i, vs in conv.items()}
    whole = {}
    for i in turns:
        h = zlib.crc32(str(i).encode()) % 6
        base = i - (abs(i) % 100) * (1 if i >= 0 else -1)
        whole[i] = tuple(turns.get(base, [])[:h] + turns[i][h:])
    members = defaultdict(list)
    for i, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(i)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(str(i) for i in sorted(m) if len(whole[i]) == len(k))))
        for k, m in members.items()), key=repr)


@pytest.mark.parametrize("tiny", [False, True])
def test_trie_equals_a_plain_one(spark, monkeypatch, tiny):
    if tiny:  # a full sketch, split conversations and small packs
        for name, value in {"LARGEST": 16, "BLOCK": 4, "PACK": 3}.items():
            monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations()
    got = prefix_trie.nodes(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == prefix_trie.COLUMNS
    assert as_set(got) == trie(rows)


def test_trie_of_few_and_no_conversations(spark):
    for rows in ([(7, 0, "user", "q")], [(5, 0, "user", "q"), (5, 0, "user", "q")], [(None, 0, "user", "q")]):
        assert as_set(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA))) == trie(rows)
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_takes_a_shared_prefix_for_a_single_one(spark):
    rows = spark.range(4000).select((F.col("id") % 7 + 1).alias("pos"), F.when(F.col("id") % 5 == 0, F.col("id") % 100).otherwise(F.col("id") * 7919).alias("a"), (F.col("id") % 7).alias("b"))
    seen = Counter((r.pos, r.a, r.b) for r in rows.collect())
    found = prefix_trie.sketch(rows, 4000)
    keys = np.array(list(seen))
    maybe = found.maybe_shared(keys[:, 0], keys[:, 1], keys[:, 2])
    many = np.array([n > 1 for n in seen.values()])
    assert maybe[many].all() and maybe[~many].mean() < 0.1 and many.any() and (~many).any()


def test_formatted_examples(spark):
    rows = conversations(8)
    frame = with_clashes(spark.createDataFrame(rows, SCHEMA))
    by = defaultdict(list)
    for i, turn, role, text in rows:
        by[i].append((turn is not None, turn or 0, role or "", text or ""))
    want, n_examples = [], {}
    for i, v in by.items():
        v = sorted(v)
        replies = "".join(t for *_, r, t in v if r == "assistant")
        want.append((i, len(v), sha("".join(f"{r}\n{t}\n" for *_, r, t in v)), len(replies), sha(replies)))
        n_examples[i] = sum(r == "assistant" for *_, r, _ in v) + (v[-1][2] != "assistant")
    report = chat_format.report(frame)
    assert as_set(report.drop("formatted_chars")) == sorted(want, key=repr)
    made = chat_format.examples(frame).collect()
    assert Counter(r.conv_id for r in made) == Counter(n_examples)
    texts = defaultdict(dict)
    for r in made:
        texts[r.conv_id][r.example] = r
    for i, of in texts.items():
        v = sorted(by[i])
        assert sum(r.last for r in of.values()) == 1 and of[len(of)].last
        at = [n for n, t in enumerate(v) if t[2] == "assistant"]
        for k, r in of.items():
            assert of[len(of)].text.startswith(r.text)  # all turns before, and the reply
            if r.loss_start is None:
                assert k == len(of) == len(at) + 1
            else:
                assert r.text[r.loss_end :] == "</s>" and r.text[: r.loss_start].endswith("<s>")
                assert spark_unescape(r.text[r.loss_start : r.loss_end]) == v[at[k - 1]][3]
    sizes = {i: sum(len(r.text) for r in of.values()) for i, of in texts.items()}
    assert {r.conv_id: r.formatted_chars for r in report.collect()} == sizes
    assert chat_format.report(spark.createDataFrame([], SCHEMA)).count() == 0


def spark_unescape(text):
    import re

    return re.sub(chat_format.UNESCAPE, r"\1\2\3", text)


def test_escaping_can_be_undone_and_leaves_no_mark(spark):
    rng = random.Random(5)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "TEXT]", "$1", "é", "\n", "<s>", "[INST]"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["\\" * 2000 + "<" * 2000 + "s>", "<" + "\\" * 5000 + "s>"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = frame.select("t", chat_format.escaped(F.col("t")).alias("e")).select("t", "e", chat_format.unescaped(F.col("e")).alias("u")).collect()
    marks = [m for pair in chat_format.MARKS.values() for m in pair] + list(chat_format.OTHER)
    for r in out:
        assert r.u == r.t and not any(m in r.e for m in marks)


def lloyd(rows):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not rows:
        return []
    width = -(-max(len(r[1]) for r in rows) // 4)
    x = [[int(np.floor(float(np.float32(v)) * 1024)) for v in r[1]] for r in rows]
    x = [[v[p * width : (p + 1) * width] + [0] * (width - len(v[p * width : (p + 1) * width])) for p in range(4)] for v in x]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, sum(x[i], [])))[:256]
    books = [[list(x[i][p]) for i in first] for p in range(4)]

    def assign():
        out = []
        for p in range(4):
            d = [[sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)) for e in books[p]] for v in x]
            out.append([(min(q), q.index(min(q))) for q in d])
        return out

    for _ in range(4):
        got = assign()
        for p in range(4):
            for e in range(len(first)):
                own = [v[p] for v, (_, b) in zip(x, got[p], strict=True) if b == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    got = assign()
    error = [sum(got[p][i][0] for p in range(4)) for i in range(len(rows))]
    label = Counter()
    for r, e in zip(rows, error, strict=True):
        label[r[2]] += e
    digest = sha(",".join(str(v) for p in books for e in p for v in e))
    return sorted(((r[0], "".join(f"{got[p][i][1]:02x}" for p in range(4)), error[i], label[r[2]], digest) for i, r in enumerate(rows)), key=repr)


def vectors(n=330, size=8, seed=1):
    rng = np.random.default_rng(seed)
    out = [(int(i), [float(v) for v in rng.normal(size=size)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    out += [(1000 + i, out[0][1], 1) for i in range(60)] + [out[3], out[3], (None, out[5][1], 0), (None, [0.0] * size, None)]
    return out + [(2000, None, 1), (2001, [None] * size, 1), (2002, [float("nan")] * size, 1), (2003, [float("inf")] * size, 1)]


@pytest.mark.parametrize("make", [lambda: vectors(), lambda: vectors(40, 8, 2), lambda: vectors(30, 6, 3) + [(5000, [], 1), (5001, [3.0e7, -3.0e7], 2)]])
def test_codes_equal_a_plain_lloyd(spark, make):
    rows = make()
    frame = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c != "label"])
    assert as_set(code_compression.codes(frame)) == lloyd(rows)


def test_codes_of_no_vectors(spark):
    assert code_compression.codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert code_compression.codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_only_parts_that_change_entry_migrate(spark, monkeypatch):
    moved = []
    placed = code_compression.placed
    monkeypatch.setattr(code_compression, "placed", lambda parts: moved.append(parts.count()) or placed(parts))
    rows = vectors()
    n = len(lloyd(rows))
    code_compression.codes(spark.createDataFrame(rows, VECTORS)).count()
    assert moved[0] == 4 * n and len(moved) == 4 and all(m < 2 * n for m in moved[1:])


def test_nearest_is_exact_for_large_components():
    rng = np.random.default_rng(0)
    for top in (1 << 10, 1 << 27, 1 << 50):
        x, book = rng.integers(-top, top, (50, 4)), rng.integers(-top, top, (20, 4))
        entry, distance = code_compression.nearest(x, book)
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in book] for v in x]
        assert [q.index(min(q)) for q in d] == entry.tolist()
        assert [min(min(q), code_compression.FARTHEST) for q in d] == distance.tolist()
