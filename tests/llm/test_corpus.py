"""Mixing, sharding, classifiers, and the stages of the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import as_set, documents, rows, with_clashes
from touchline.llm import mixing, quality, sharding, url_filter


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixture_keeps_budgets(spark):
    data = rows()
    docs = documents(spark, data)
    target = mixing.Target(max_repeats=1.5)
    got = mixing.mixture(with_clashes(docs), target).collect()
    assert len(got) == len(data) and Counter((r.doc_id, r.tokens) for r in got) == Counter((i, n_words(t)) for i, t, *_ in data)
    plan = {r.source: r for r in mixing.plan(mixing.stage(mixing.document_tokens(docs)), target).collect()}
    total = sum(n_words(r[1]) for r in data)
    a = plan["s0"].exponent
    p = {s: r.source_tokens / total for s, r in plan.items()}
    z = sum(x**a for x in p.values() if x)
    longest = max(n_words(r[1]) for r in data)
    for s, r in plan.items():
        assert r.weight == pytest.approx(p[s] ** a / z if p[s] else 0)
        assert r.budget <= 1.5 * r.source_tokens + 1
        held = sum(x.copies * x.tokens for x in got if x.source == s)
        assert r.budget - 2 * longest <= held <= r.budget
        mine = [x.copies for x in got if x.source == s]
        assert max(mine) - min(mine) <= 1
    # One notch flatter would break the limit.
    flat = max(0.0, a - 2e-6)
    z = sum(x**flat for x in p.values() if x)
    assert a == 0 or max(x**flat / z / x for x in p.values() if x) > 1.5
    order = sorted((hashlib.md5(f"s0|{x.block}".encode()).hexdigest(), hashlib.md5(str(x.doc_id).encode()).hexdigest(), x.copies) for x in got if x.source == "s0" and x.doc_id is not None)
    assert [x[2] for x in order] == sorted((x[2] for x in order), reverse=True)  # the last pass is a prefix of the permutation


def test_mixture_by_entropy_and_rows(spark):
    docs = with_clashes(documents(spark))
    tokens = mixing.stage(mixing.document_tokens(docs))
    plan = mixing.plan(tokens, mixing.Target(entropy_share=0.9)).collect()
    w = [r.weight for r in plan if r.weight > 0]
    assert -sum(x * math.log(x) for x in w) >= 0.9 * math.log(len(w)) - 1e-9
    mixed = mixing.mixed(docs, mixing.Target(max_repeats=1.0), 0.8)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mixture(docs, mixing.Target(max_repeats=1.0), 0.8).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixture(documents(spark, []), mixing.Target(max_repeats=1.5)).count() == 0
    with pytest.raises(ValueError):
        mixing.Target()


@pytest.mark.parametrize("range_rows", [200_000, 5])
def test_shards_are_even_whole_and_gapless(spark, range_rows):
    data = [r for r in rows() if r[0] not in (105, 106)]
    got = sharding.shards(with_clashes(documents(spark, data)), 8, range_rows).collect()
    digest = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == digest
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    mean, longest = sum(r.size for r in got) / 8, max(r.size for r in got)
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - mean) <= longest + mean / 20
    where = defaultdict(set)
    weight = Counter()
    for r in got:
        where[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r.size
    assert all(len(s) == 1 for c, s in where.items() if weight[c] <= mean / 20) and max(len(s) for s in where.values()) > 1
    # The ranges only spread the work.
    once = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shards(documents(spark, data), 8).collect()}
    assert {(r.doc_id, r.text_crc32): r.shard for r in got} == once


def test_shards_equal_a_plain_placement(spark):
    """A text of a third of the rows and one row repeated again and again are split; any number of ranges gives the same shards."""
    data = [r for r in rows() if r[0] not in (105, 106)] + [(1000 + i, "hot text", "en", "s", 8) for i in range(900)] + [(7, "hot row", "en", "s", 7)] * 700
    table = sharding.stage(sharding.records(with_clashes(documents(spark, data))))
    total = table.selectExpr("sum(size) AS bytes", "count(*) AS n").first()
    keys, _ = sharding.keyed(table, total, 8)
    order = sorted(keys.collect(), key=lambda r: (r.g, r.place, r.doc_id is not None, r.doc_id or 0, r.size))
    units = defaultdict(int)
    for r in order:
        units[r.g, r.place] += r.size
    start, before, want, slots = {}, 0, Counter(), Counter()
    for r in order:
        begin = start.setdefault((r.g, r.place), before)
        shard = min(7, int((begin + units[r.g, r.place] / 2) * 8 / float(total.bytes)))
        want[r.doc_id, r.text_crc32, shard, slots[shard]] += 1
        slots[shard] += 1
        before += r.size
    for range_rows in (5, 10_000):  # hundreds of ranges, and one for each shard
        got = sharding.shards(documents(spark, data), 8, range_rows).collect()
        assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == want
    ranged = sharding.ranges(*sharding.keyed(table, total, 8), total, 5).groupBy("rid").count().collect()
    assert len(ranged) > 100 and max(r["count"] for r in ranged) <= 64
    assert max(Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot row")).values()) < 700


def test_shards_of_empty_and_tiny_tables(spark):
    assert sharding.shards(documents(spark, [])).count() == 0
    assert [(r.doc_id, r.size, r.slot) for r in sharding.shards(documents(spark, [(1, None, None, None, None)])).collect()] == [(1, 8, 0)]


def labelled_documents(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        w = rng.choice(words, rng.integers(20, 80))
        good = i % 4 != 0
        data.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), "en", "s", 1))
        labels.append((i, int(good), 0))
    data += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "no id here", "en", "s", 1), data[5], data[5], (1002, "word " * 50_000, "en", "s", 1)]
    labels += [(1003, 1, 0), (None, 0, 0), (2, None, 0), (3, 7, 0)]
    return documents(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_documents(spark)
    got = quality.scores(with_clashes(docs), labels).collect()
    assert len(got) == 606
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    # Labels of held-out rows change nothing.
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, round(r.score, 9)) for r in quality.scores(docs, turned).collect()} == {(r.doc_id, round(r.score, 9)) for r in got}
    kept = quality.clean(with_clashes(docs), labels)
    assert kept.count() == sum(r.predicted for r in got)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scores(documents(spark, rows(n=5)), none).collect()} == {0.5}
    assert quality.scores(documents(spark, []), none).count() == 0


def test_pooling_does_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    texts = ["one two two three", "", "é " * 100, "Ab12 !! x"] * 5
    whole = quality.Pooler(vectors)(texts)
    monkeypatch.setattr(quality, "STEP", 7)
    assert np.allclose(whole, quality.Pooler(vectors)(texts), atol=1e-5) and not np.isnan(whole).any()


def test_quality_scores_equal_plain_loops(spark):
    """Word vectors, pooling and the forward pass, worked out token by token."""
    rng = np.random.default_rng(8)
    words = ["river", "Stone", "cloud", "éclair", "42", "7", "!!", "naïve", "the", "of"]
    texts = ["", None, "one", "the the the", "x\ty\nz", "a1b2--c3", *[" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(60)]]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)

    hasher, (position, sign) = quality.RunHasher(), quality.index_vectors()
    runs = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
    of = {}

    def buckets(text):
        out = []
        for token in runs.findall((text or "").encode()):
            if token not in of:  # the hash of a token does not depend on where it stands
                value, counts = hasher([token.decode()])
                assert counts.tolist() == [1]
                of[token] = (int(value[0]) >> 40) % quality.BUCKETS
            out.append(of[token])
        return out

    seen, sums = Counter(), defaultdict(lambda: [0] * quality.DIMENSIONS)
    for _, text in docs:
        b = buckets(text)
        for i, mine in enumerate(b):
            seen[mine] += 1
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if j != i:
                    for p, s in zip(position[b[j]], sign[b[j]], strict=True):
                        sums[mine][p] += int(s)
    table = quality.word_vectors(df)
    got = {r["bucket"]: (r["n"], [r[f"v{i}"] for i in range(quality.DIMENSIONS)]) for r in table.collect()}
    assert got == {b: (n, list(sums[b])) for b, n in seen.items()}

    def unit(v):
        size = math.sqrt(sum(x * x for x in v))
        return [x / size if size else 0.0 for x in v]

    vectors = {b: unit(sums[b]) for b in seen}

    def pooled(text):
        b = buckets(text)
        mean = [sum(vectors[k][i] for k in b) / max(len(b), 1) for i in range(quality.DIMENSIONS)]
        pairs = list(zip(b, b[1:]))
        alike = sum(sum(x * y for x, y in zip(vectors[k], vectors[m])) for k, m in pairs) / max(len(pairs), 1)
        return [*mean, alike, sum(k == m for k, m in pairs) / max(len(pairs), 1), math.sqrt(sum(x * x for x in mean)), math.log1p(len(b))]

    labels = spark.createDataFrame([(i, i % 2) for i in range(len(docs))], "doc_id long, quality int")
    model = quality.train(df, labels)
    net = model.network
    scores = {r["doc_id"]: r["score"] for r in quality.scores(df, labels).collect()}
    for i, text in docs:
        x = [(v - m) / s for v, m, s in zip(pooled(text), net.mean, net.scale)]
        hidden = [math.tanh(sum(v * net.w1[k][j] for k, v in enumerate(x)) + net.b1[j]) for j in range(quality.HIDDEN)]
        z = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-4)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 6))
    y = (x[:, 0] + rng.normal(size=2000) > 0).astype(int)
    net = quality.Network.fit(x[:300], y[:300])

    def loss():
        p = np.clip(net(x[300:]), 1e-12, 1 - 1e-12)
        return -np.mean(np.where(y[300:] == 1, np.log(p), np.log(1 - p)))

    before = loss()
    net.calibrate(x[300:], y[300:])
    assert net.temperature > 1 and loss() < before


URLS = [
    (1, "https://Example.NET/en/1"), (2, "http://blog.example.net/fr/2"), (3, "http://example.net"), (4, "http://a.example.com/de/x?y#z"), (5, "http://x.org/fr/"), (6, "http://org/fr/a"),
    (7, "no scheme"), (8, None), (9, "http://net?x/en/"), (10, "ftp://a://b/en"), (11, "http://notexample.net/en/"), (12, "http://example.com/DE/"), (13, "http://ÉX.net/\n/é?"), (1, "https://Example.NET/en/1"), (None, ""),
]


def test_url_rules_equal_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = url_filter.verdicts(with_clashes(spark.createDataFrame(URLS, "page_id long, url string"))).collect()
    want = []
    for i, u in URLS:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
            path = re.split("[?#]", rest[cut:], maxsplit=1)[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want.append((i, host, path, best[0] + best[1] if best else None, best[2] if best else None))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_on_unseen_addresses():
    model = url_filter.train()
    assert all(model(url_filter.address_of(u)) > 0.5 for u in ("http://big-casino.win/poker", "http://pills-cheap.biz/buy-viagra", "http://cams.adult/sexy"))
    assert all(model(url_filter.address_of(u)) < 0.5 for u in ("https://www.python.org/tutorial/", "https://www.example.com/en/77", "https://history.museum.org/article/1"))


@pytest.mark.parametrize("step", [1 << 18, 11])
def test_url_scores_equal_plain_loops(monkeypatch, step):
    monkeypatch.setattr(url_filter, "STEP", step)
    rng = np.random.default_rng(4)
    addresses = ["", "a", "net/", "example.com/en/304", "é.org/\n€/ü", "ab" * 400, "example.com/en/304"]
    addresses += ["".join(rng.choice(list("abc./-1é"), rng.integers(0, 60))) for _ in range(300)]
    row, feature = url_filter.gram_table(addresses)
    got = defaultdict(list)
    for i, f in zip(row.tolist(), feature.tolist(), strict=True):
        got[i].append(f)
    model = url_filter.train()
    for i, a in enumerate(addresses):
        raw = f"^{a}$".encode()
        want = {zlib.crc32(raw[k : k + n]) % url_filter.FEATURES for n in url_filter.GRAMS for k in range(len(raw) - n + 1)}
        assert sorted(got[i]) == sorted(want)
        z = model.bias + sum(model.weights[f] for f in want) / math.sqrt(max(len(want), 1))
        assert model(a) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert np.allclose(model.judge(addresses), [model(a) for a in addresses], atol=1e-15)
    assert len(model.judge([])) == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from touchline.llm import decontamination, minhash_dedup

    docs, labels = labelled_documents(spark)
    docs = docs.filter("doc_id is not null")
    benchmark = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string")
    dirty = documents(spark, [(5000, " ".join(f"item{i}" for i in range(20)), "en", "s", 1)])
    folder = str(tmp_path)
    docs.union(dirty).write.parquet(f"{folder}/documents.parquet")
    labels.union(spark.createDataFrame([(5000, 1, 0)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, now, folder)
        if i < 4:
            assert out.columns == now.columns, name
        out.write.parquet(f"{folder}/{i}")
        seen.append((now, spark.read.parquet(f"{folder}/{i}")))
        now = seen[-1][1]
    good = quality.scores(seen[0][0], spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1")
    assert as_set(seen[0][1].select("doc_id")) == as_set(good.select("doc_id"))
    kept = minhash_dedup.near_duplicates(seen[1][0]).filter("kept")
    assert as_set(seen[1][1].select("doc_id")) == as_set(kept.select("doc_id").distinct())  # one row of each
    fine = decontamination.report(seen[2][0], benchmark).filter("not contaminated")
    assert as_set(seen[2][1].select("doc_id")) == as_set(fine.select("doc_id"))
    assert 0 < seen[3][1].count() <= seen[3][0].count() and seen[4][1].count() == seen[4][0].count()
    assert corpus_pipeline.run(spark, folder).count() == seen[4][1].count()


def test_runs_are_hashed_in_bounded_slices():
    texts = ["ab cd", "", "x" * 300_000, *[f"word{i} of text {i % 7}" for i in range(30_000)], "last"]
    hasher = quality.RunHasher()
    hashes, counts = hasher(texts)
    alone = [quality.RunHasher()([t]) for t in texts[:200]]
    assert counts[:200].tolist() == [len(a[0]) for a in alone]
    assert hashes[: counts[:200].sum()].tolist() == [h for a in alone for h in a[0].tolist()]
    assert len(hasher.powers) < 4 * quality.HASHED_CHARS < sum(map(len, texts)) * 2
    assert [len(a) for a in hasher([])] == [0, 0]
