"""Training-data operators against brute force, and their defined results for odd rows."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spotlake.llm")

from compare import rows as table_rows  # noqa: E402
from compare import sql_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from spotlake.llm import ann, common, decontaminate, hmm, jaccard, packing, quality, queries, secrets, sharding, tokens, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "Ünïcode Ä b"), (5, "x " * 30_000), (6, "one"), (7, "É" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeats, with extra columns named like the operators' own."""
    rows = [(i, t, "a", 1, "b", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, shard int, word string, node int")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert table_rows(queries.QUERIES[name](spark, SF).toPandas()) == table_rows(sql_rows(queries.ORACLE_SQL[name], SF))


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, text in docs:
        words, hit, names = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            for run in [w[i : i + window] for i in range(max(1, len(w) - window + 1))] if w else []:
                for p in range(len(words) - len(run) + 1):
                    if words[p : p + len(run)] == run:
                        hit |= set(range(p, p + len(run)))
                        names.add(str(item_id))
        out.append((doc_id, len(words), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, odd):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 10, 12])))) for i in range(6)] + [(6, None), (7, "!"), (0, "b a c")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(20)] + [(9, items[2][1].upper() + ", " + items[2][1])] * 2 + [(None, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for few in (200_000, 0):  # broadcast, and shuffled joins
        got = decontaminate.contamination(d, b, broadcast_rows=few).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute_contamination(docs, items)
        assert all(sum(e - s for s, e in r.spans) == r.n_hit for r in got)
    assert decontaminate.contamination(odd, b.where("false").withColumn("pos", F.lit(1))).where("n_hit = 0").count() == len(ODD)
    assert decontaminate.contamination(odd.where("false"), b).count() == 0


def brute_base_spans(text):
    assign = re.compile(secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "(?i:password|passwd|secret|token|api_?key)"))
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(secrets.HEX, text) if len(m.group()) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def brute_redact(text, spans):
    out, at = "", 0
    for _, start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_texts_with_many_secrets(spark):
    """Places and marks across blocks of matches, and a time that grows with the text, not with its square."""
    rng = random.Random(5)
    kinds = [lambda: f"password = hunter{rng.randrange(10**6)}", lambda: "AKIA" + "".join(rng.choices("ABCXYZ0189", k=18)), lambda: "%030x" % rng.getrandbits(120), lambda: "token: " + "%030x" % rng.getrandbits(120), lambda: "é😀 plain words"]
    texts = [" ".join(rng.choice(kinds)() for _ in range(n)) for n in (1, 63, 64, 65, 128, 129, 1000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", secrets.base_spans(F.col("text")).alias("spans"))
    for r in rows.select("*", secrets.redact(F.col("text"), F.col("spans")).alias("marked")).collect():
        assert [tuple(s) for s in r.spans] == brute_base_spans(r.text)
        assert r.marked == brute_redact(r.text, brute_base_spans(r.text))
    long = spark.createDataFrame([(1, "")], "doc_id long, text string").select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.sha1(i.cast("string"))), "\n").alias("text"))
    begun = time.monotonic()
    r = long.select("text", secrets.base_spans(F.col("text")).alias("spans")).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last"), F.length(secrets.redact(F.col("text"), F.col("spans"))).alias("size")).first()
    assert (r.n, tuple(r["last"]), r["size"]) == (100_000, ("hex", 99_999 * 41, 99_999 * 41 + 40), 100_000 * 9 - 1)
    assert time.monotonic() - begun < 60


def test_base_spans_equal_brute_force(spark, odd):
    rng = random.Random(2)
    parts = ["PassWord", "token", "api_key", "secret", ":", "=", " ", '"', "'", "abcdef", "AKIA", "Z9" * 9, "0f" * 13, "é😀", "x", "apikey= 'q-1.b/c'", "a1b2" * 3]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)]
    got = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind != "random"] == brute_base_spans(r.text)
    out = secrets.scan_secrets(odd, keep=["doc_id", "shard", "word"])
    assert out.columns == ["doc_id", "shard", "word", "spans"] and out.count() == len(ODD)
    assert secrets.scan_secrets(odd.where("false")).count() == 0


def test_battery_finds_random_keys_and_leaves_long_words(spark):
    rng = random.Random(3)
    syllables = ["ther", "ing", "ation", "ent", "ble", "ness", "ver", "con", "ment", "ally"]
    key = lambda i: base64.b64encode(rng.randbytes(30 + i % 20)).decode().rstrip("=").replace("+", "x").replace("/", "y")
    keys = [key(i) for i in range(40)]
    words = ["".join(rng.choice(syllables) for _ in range(6)) for _ in range(400)]
    docs = [(i, f"see {w} and {keys[i]} here" if i < 40 else f"see {w} here") for i, w in enumerate(words)]
    got = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = [r.text[s.start : s.end] for r in got for s in r.spans]
    assert sum(f in keys for f in found) >= 32
    assert sum(f not in keys for f in found) <= 4
    hidden = spark.createDataFrame([("a password=hunter22 b AKIA" + "Q7" * 9,)], "text string")
    text = secrets.scan_secrets(hidden).select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert text == "a [SECRET] b [SECRET]"


def test_token_histogram_answers_every_limit(spark, odd):
    lengths = tokens.token_lengths(odd)
    n = [r.n_tokens for r in lengths.collect()]
    assert len(n) == len(ODD) and n[:2] == [0, 0]
    hist = tokens.length_histogram(lengths)
    for r in hist.collect():
        assert r.docs == n.count(r.n_tokens) and r.truncated_total == sum(min(x, r.n_tokens) for x in n)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= r.n_tokens for x in n), sum(x for x in n if x >= r.n_tokens))
        assert r.total_tokens == sum(n) and r.quantile == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    assert {r[0]: r[1] for r in tokens.truncated_totals(hist, [0, 3, 10**6]).collect()} == {k: sum(min(x, k) for x in n) for k in (0, 3, 10**6)}
    assert tokens.quantile_lengths(hist, [0.5]).first().n_tokens == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert tokens.length_histogram(lengths.where("false")).count() == 0


def test_minimax_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(300):
        sizes, k = [rng.randrange(1, 9) for _ in range(rng.randrange(9))], rng.randrange(1, 5)
        ends = [0, *sharding.minimax_cuts(sizes, k), len(sizes)]
        assert ends == sorted(ends)
        load = lambda e: max(sum(sizes[a:b]) for a, b in itertools.pairwise(e))
        assert load(ends) == min(load((0, *c, len(sizes))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))


def test_shards_are_whole_gapless_and_even(spark, odd):
    got = queries.op4_sharding(spark, SF).toPandas()
    assert len(got) == 200
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    out = sharding.shard_documents(odd, shards=4).collect()
    ones = [r for r in out if r.doc_id in (4, 6)]
    assert len(out) == len(ODD) and len(ones) == 3 and len({r.shard for r in ones}) == 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (1, 2)} == {(1, 0)}
    assert all(r.text_crc32 == zlib.crc32(b"one") for r in ones)
    assert sharding.shard_documents(odd.where("false")).count() == 0


def test_length_buckets_are_optimal_and_batches_whole(spark, odd):
    rng = random.Random(5)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(30), rng.randrange(1, 8))))
        counts, k = np.array([rng.randrange(1, 9) for _ in lengths]), rng.randrange(1, 5)
        cost = lambda bounds: sum(int(c) * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        bounds = packing.optimal_bounds(lengths, counts, k)
        assert len(bounds) <= k and cost(bounds) == min(cost([*x, lengths[-1]]) for r in range(k) for x in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
    out = packing.pack(odd, max_len=100, budget=400, buckets=3).collect()
    sizes = sorted(len((t or "").encode()) + 1 for _, t in ODD)
    per = Counter()
    for r in out:
        assert 0 < r.length <= r.padded_length <= 100 and r.position < 400 // r.padded_length
        per[r.doc_id] += r.length
    assert sum(per.values()) == sum(sizes) and len({(r.bucket, r.batch, r.position) for r in out}) == len(out)
    assert packing.pack(odd.where("false")).count() == 0


def naive_forward(model, seen):
    alpha, total = model.start, 0.0
    for k in seen:
        alpha = (alpha @ model.move) * model.emission[k]
        total += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
    return total


def test_forward_is_exact_and_training_raises_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    rng = np.random.default_rng(6)
    seen = rng.integers(0, 256, 400).astype(np.int32)
    sizes = np.array([1, 7, 8, 100, 3, 281])
    model = hmm.first_model(3, np.bincount(seen, minlength=256).astype(float))
    stops = np.cumsum(sizes)
    want = [naive_forward(model, seen[e - n : e]) for e, n in zip(stops, sizes, strict=True)]
    assert hmm.forward(model, seen, sizes) == pytest.approx(want)
    before, starts, moves, emissions = hmm.forward(model, seen, sizes, counts=True)
    assert starts.sum() == pytest.approx(len(sizes)) and moves.sum() == pytest.approx(400) and emissions.sum() == pytest.approx(400)
    better = hmm.Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), (emissions + 1e-12) / (emissions + 1e-12).sum(0))
    assert hmm.forward(better, seen, sizes).sum() > before.sum()


def test_language_scores(spark, odd):
    docs = [(i, " ".join(random.Random(i).choice(["the", "a", "of", "cat", "dog", f"w{i}"]) for _ in range(i))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for head in (200_000, 3):  # all counts at hand, and most of them joined
        got = {r.doc_id: r for r in hmm.score_language(frame, head=head, rounds=2).collect()}
        out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
        count = Counter(w for i, t in docs if not out(i) for w in [*spaced(t), ""])
        n, v = sum(count.values()), len(count)
        for i, text in docs:
            words, r = [*spaced(text), ""], got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(words), sum(w in count for w in words), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
            assert math.isfinite(r.score) and r.score < 0
    assert hmm.score_language(odd, rounds=1).count() == len(ODD)
    assert hmm.score_language(odd.where("false"), rounds=1).count() == 0


def naive_scores(docs, head, least, states, rounds):
    """The model of score_language on lists and single sequences, one step after another."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    texts = {i: spaced(t) for i, t in docs}
    count = Counter(w for i in texts if not held[i] for w in texts[i])
    bins = {}
    for w, c in count.items():
        if c >= least:
            bins.setdefault(math.floor(math.log2(c) * 64), []).append(w)
    frequent = []
    for b in sorted(bins, reverse=True):
        if len(frequent) + len(bins[b]) > head:
            break
        frequent += bins[b]
    frequent.sort(key=lambda w: (-count[w], w))
    tail = lambda w: zlib.crc32(w.encode()[-2:]) % 96
    place = {w: i + 1 for i, w in enumerate(frequent)}
    kind = lambda w: place[w] if w in place else 1 + len(frequent) + tail(w)
    totals = np.zeros(1 + len(frequent) + 96)
    totals[0] = sum(not h for h in held.values())
    types = Counter()
    for w, c in count.items():
        totals[kind(w)] += c
        types[kind(w)] += 1
    model = hmm.first_model(states, totals)
    sequences = {i: [*map(kind, t), 0] for i, t in texts.items()}
    for _ in range(rounds):
        start, moves, emissions = np.full(states, 0.1), np.full((states, states), 0.1), np.repeat(20.0 * totals[:, None] / totals.sum() + 1e-6, states, axis=1)
        for i, x in sequences.items():
            if held[i]:
                continue
            alphas, beta = [model.start], np.ones(states)
            for k in x:
                a = (alphas[-1] @ model.move) * model.emission[k]
                alphas.append(a / a.sum())
            for t in range(len(x) - 1, -1, -1):
                w = model.emission[x[t]] * beta
                both = alphas[t][:, None] * model.move * w
                both /= both.sum()
                moves += both
                emissions[x[t]] += both.sum(axis=0)
                beta = model.move @ w
                beta /= beta.sum()
                if t == 0:
                    start += both.sum(axis=1)
        model = hmm.Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    out = {}
    for i, x in sequences.items():
        rare = [w for w in texts[i] if w not in place]
        inside = sum(math.log10((count[w] + 0.5) / (totals[kind(w)] + 0.5 * (types[kind(w)] + 1))) for w in rare)
        out[i] = naive_forward(model, x) / math.log(10) + inside
    return out


@pytest.mark.parametrize(("head", "least"), [(100, 3), (4, 1)])
def test_language_model_equals_naive_one(spark, head, least):
    docs = [(i, " ".join(random.Random(i).choice(["the", "a", "of", "cat", "dog", f"w{i % 7}", f"v{i}"]) for _ in range(i % 23))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = naive_scores(docs, head, least, states=3, rounds=3)
    got = {r.doc_id: r.score for r in hmm.score_language(frame, states=3, rounds=3, head=head, least=least).collect()}
    assert got == pytest.approx(want)


def test_archives_round_trip(spark):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "é" * 5000, "<p>" + "a" * 200]
    ids = [3, 1, 5, 4, 6, 7, None]
    frame = spark.createDataFrame([(i, f"http://x/{i}\n", h, 1) for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, offset int")
    index = warc.write_archives(frame, roll=300)
    for gap in (0, 10**6):
        got = {r.page_id: r for r in warc.read_archives(index, gap=gap).collect()}
        for i, h in zip(ids, html, strict=True):
            data = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            assert got[i].payload == (None if i == 3 else data) and got[i].refers_to == (1 if i == 3 else None)
    assert warc.read_archives(index.where("page_id = 7")).count() == 1
    assert warc.write_archives(frame.where("false")).count() == 0
    fields, block = warc.parse(warc.record(1, "u", b"\r\n\r\nx", None))
    assert block == b"\r\n\r\nx" and fields["WARC-Type"] == "response" and gzip.decompress(warc.record(2, "u", b"y", 1)).endswith(b"\r\n\r\n")


def brute_components(docs, size, t):
    sets = []
    for _, text in docs:
        w = spaced(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and both * t.denominator >= (len(sets[i] | sets[j])) * t.numerator:
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize(("size", "threshold"), [(4, "0.85"), (5, "0.8"), (1, "0.5")])
def test_near_duplicates_equal_brute_force(spark, size, threshold):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 30, 60]))] for _ in range(12)]
    docs = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    docs += [(200, None), (201, ""), (202, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for more in ({}, {"largest": 2000}):
        got = jaccard.near_duplicates(frame, size, threshold, **more).collect()
        assert sorted(map(tuple, got)) == brute_components(docs, size, Fraction(threshold))


def test_region_links_connect_what_all_links_connect():
    rng = np.random.default_rng(8)
    centers = [rng.choice(400, 60, replace=False) for _ in range(6)]
    sets = []
    for _ in range(300):
        s = set(centers[rng.integers(6)].tolist())
        for _ in range(rng.integers(0, 9)):
            s.discard(int(rng.choice(sorted(s))))
            s.add(int(rng.integers(400, 900)))
        sets.append(np.array(sorted(s), np.uint64))
    t, keys = Fraction("0.85"), [str(i).encode() for i in range(300)]

    def classes(links):
        root = {k: k for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for k in keys:
            groups.setdefault(find(k), set()).add(k)
        return sorted(map(sorted, groups.values()))

    every = {(keys[i], keys[j]) for i, j in itertools.combinations(range(300), 2) if jaccard.linked(sets[i], sets[j], t)}
    assert classes(jaccard.region_links(keys, sets, t, leaf=8, pivots=4)) == classes(every)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 6)} == {4}
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id == 1} == {(0, 1)}
    assert jaccard.near_duplicates(odd.where("false")).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_components_take_few_stages(spark):
    context = spark.sparkContext
    context.setJobGroup("few-stages", "components of a chain")
    try:
        assert common.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), "a", "b").count() == 41
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("few-stages")) <= 130  # a plan that repeats its steps has 168


def test_quality_on_held_out_labels(spark, odd):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert len(got) == 1000 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    model = quality.fit_quality(odd, spark.createDataFrame([(4, 1), (7, 0), (7, None)], "doc_id long, quality int"))
    assert quality.score_quality(odd, model).count() == len(ODD)
    assert quality.score_quality(odd.where("false"), quality.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_neighbours_of_clusters_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 16))
    x[:200] = x[0] + 0.01 * x[:200]
    x[300:330] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (None, x[0].tolist()), (1080, [None] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, k=10, enough=100, block=200, query_block=16).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        hit += len(set(best) & set(own["vec_id"]))
    assert hit >= 0.9 * 300 and set(got["query_id"]) == set(range(0, 600, 20))
    assert ann.search(frame.where("false")).count() == 0
    few = ann.search(frame.where("vec_id < 3"), k=20).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_neighbours_of_uneven_lengths(spark):
    """At the query's own block and number of candidates, a hundredth of the rows being ten times longer."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(8000)[:80]] *= 10
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=200).toPandas()
    hit = 0
    for q in range(0, 8000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got.loc[got["query_id"] == q, "vec_id"]))
    assert hit >= 0.95 * 800


def test_pipeline_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, "/root/testdata/sf0.01"), "test")
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 500 < seen[-1] < seen[0]
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert decontaminate.contamination(docs, items).where("n_hit > 0").count() == 0
    left = jaccard.near_duplicates(docs)
    assert left.where("component_id <> doc_id").count() <= 1  # redacted texts may grow alike
    packed = packing.pack(docs)
    assert packed.select("doc_id").distinct().count() == seen[-1]


@pytest.mark.parametrize("written", [True, False])
def test_pipeline_decides_by_row(spark, tmp_path, written):
    """Null, repeated and shared ids: each row goes or stays for its own text."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e, item = text(80), text(80), text(80), text(80), text(80), text(12)
    dirty = f"{text(30)} {item} {text(30)}"
    rows = [(None, a), (None, a + " x"), (None, a), (3, b), (3, b), (3, b + " y"), (4, c), (2, c), (None, c), (5, a + " z"), (5, d), (6, ""), (6, ""), (None, None)]
    rows += [(None, dirty), (7, dirty + " q"), (7, e), (8, e), (None, text(60))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    shape = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame(rows, shape)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    if written:
        docs = common.materialize(docs, "test")
    plain = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    sets = [set(zip(*[spaced(t)[k:] for k in range(5)], strict=False)) for _, t, *_ in rows]
    near = lambda x, y: x and y and len(x & y) * 10 >= len(x | y) * 8
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if near(sets[i], sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    classes = {}
    for i, r in enumerate(root):
        classes.setdefault(r, []).append(i)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == corpus_pipeline.COLUMNS
    got = plain(left)
    assert sum(got.values()) == len(classes)
    for own in classes.values():
        ids = [rows[i][0] for i in own]
        least = min((i for i in ids if i is not None), default=None)
        assert sum(got[x] for x in {(least, rows[i][1]) for i in own if rows[i][0] == least}) >= 1
    assert got[(5, d)] == 1 and got[(7, e)] == 1 and got[(8, e)] == 0 and got[(2, c)] == 1 and got[(6, "")] == 2

    want = Counter((i, t) for i, t, *_ in rows if f" {item} " not in (t or ""))
    assert plain(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == want
