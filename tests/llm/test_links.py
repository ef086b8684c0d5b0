"""Near-duplicates of texts and vectors, components and group links against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tests.llm.cases import as_set, documents, rows, sentence, with_clashes
from touchline.llm import embedding_dedup, groups, minhash_dedup
from touchline.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def closure(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def smallest(ids, roots):
    out = []
    for i, r in zip(ids, roots, strict=True):
        known = [x for x, q in zip(ids, roots, strict=True) if q == r and x is not None]
        out.append(min(known) if known else None)
    return out


def near_data():
    import random

    rng = random.Random(9)
    data = rows()
    for g in range(12):  # chains and groups around the threshold
        base = sentence(rng, rng.randint(4, 200)).split()
        for i in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 9)}"
            data.append((1000 + 10 * g + i, " ".join(copy), "en", "s1", 1))
    return data


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    data = near_data()
    sets = [shingles(r[1]) for r in data]
    linked = [
        (i, j) for i in range(len(data)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    ids = [r[0] for r in data]
    component = smallest(ids, closure(len(data), linked))
    want = sorted(((i, len(s), c, i == c) for i, s, c in zip(ids, sets, component, strict=True)), key=repr)
    assert as_set(minhash_dedup.near_duplicates(with_clashes(documents(spark, data)))) == want
    # Tiny nodes and blocks: every tree branches to the end, groups have leaders and pieces.
    monkeypatch.setattr(minhash_dedup, "LEAF", 4)
    monkeypatch.setattr(minhash_dedup, "SET_BLOCK", 3)
    assert as_set(minhash_dedup.near_duplicates(documents(spark, data))) == want


def test_near_duplicates_clean_and_empty(spark):
    docs = with_clashes(documents(spark))
    kept = minhash_dedup.clean(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sum(i is not None and 200 <= i < 400 for i in ids) == 1 and ids.count(3) == 1 and 100 in ids
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_clean_judges_rows_not_ids(spark):
    import random

    rng = random.Random(4)
    copied, other, own, last = (sentence(rng, 60) for _ in range(4))
    data = [
        (1, copied), (None, copied), (None, other), (None, None), (7, copied), (7, own), (8, last), (8, last), (None, ""),
        (9, copied), (9, other),  # the null id of the other text names no component
    ]
    docs = with_clashes(documents(spark, [(i, t, "en", "s", n) for n, (i, t) in enumerate(data)]))
    kept = minhash_dedup.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n_chars for r in kept.collect()) == [0, 3, 5, 6, 8, 10]


def test_trees_reach_the_recall():
    rng = np.random.default_rng(4)
    one = (1 - 0.15**2) ** 3
    trees = minhash_dedup.trees_for(0.99999, 0.85)
    assert (1 - one) ** trees <= 1e-5
    misses = sum(all((rng.random((3, 2)) < 0.15).all(axis=1).any() for _ in range(trees)) for _ in range(3000))
    assert misses <= 2


@pytest.mark.parametrize("block", [3, 100])
def test_group_links_connect_what_all_links_connect(spark, block):
    rng = np.random.default_rng(2)
    values = [(int(g), i, int(x)) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 120, 60), strict=True))]
    linked = [(a[1], b[1]) for a in values for b in values if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 3]
    want = closure(60, linked)

    def compare(one, others):
        return 3 - np.abs(int(one) - np.array([int(x) for x in others]))

    members = spark.createDataFrame([(g, k, str(x).encode()) for g, k, x in values], "g long, k long, payload binary")
    got = closure(60, [(r.u, r.v) for r in groups.links(members, compare, block).collect()])
    assert got == want


def test_components_of_chain_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3), (4, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {j: 100 for j in range(100, 140)} | {200: 200, 201: 200}
    assert got == want


def vectors():
    rng = np.random.default_rng(8)
    out = [(i, rng.normal(size=20), i % 3) for i in range(60)]
    for c in range(4):
        base = rng.normal(size=20)
        for i in range(25):  # clouds around the threshold
            out.append((100 + 30 * c + i, base + rng.normal(size=20) * 0.1 * (c + 1) / 2, 1))
    base = rng.normal(size=20)
    out += [(300 + i, base * (1 + i % 2), 1) for i in range(30)]  # copies, some scaled
    out = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in out]
    nan = [1.0] * 19 + [float("nan")]
    out += [(400, None, 1), (401, [0.0] * 20, 1), (402, nan, 1), (403, [1.0] * 19 + [None], 1), (404, [], 1), (405, out[0][1], None), (None, out[80][1], 1), (406, [1.0, 2.0], 1), out[70], out[70]]
    out += [(407, [float("inf")] + [1.0] * 19, 1), (408, [1e-30] * 20, 2), (409, [2e-30] * 20, 2), (410, [-0.0] + [1e-30] * 19, 2)]
    return out


@pytest.mark.parametrize("piece", [2000, 7])
def test_embedding_links_equal_all_pairs(spark, piece):
    data = vectors()
    usable = [v is not None and k is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, k in data]
    unit = [np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)) if ok else None for ok, (_, v, _) in zip(usable, data, strict=True)]
    linked, n = [], [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            if usable[i] and usable[j] and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98:
                linked.append((i, j))
                n[i] += 1
                n[j] += 1
    ids = [r[0] for r in data]
    component = smallest(ids, closure(len(data), linked))
    want = sorted(((i, m, c, i == c) for i, m, c in zip(ids, n, component, strict=True)), key=repr)
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(with_clashes(table), piece=piece)
    assert len(linked) > 500 and as_set(got) == want


def test_embedding_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
