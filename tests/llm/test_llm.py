"""Corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies in a chain, shared passages, short, empty and null texts, a repeated row."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    passage = sentence(rng, 70)
    texts = [base, base, None, "", "   \n", "one two", "One\tTWO"]
    chain = base.split()
    for k in range(12):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"edit{k}"
        texts.append(" ".join(chain))
    for _ in range(90):  # a long list
        near = base.split()
        for _ in range(rng.randrange(1, 9)):
            near[rng.randrange(len(near))] = sentence(rng, 1)
        texts.append(" ".join(near))
    for _ in range(20):
        texts.append(sentence(rng, rng.randrange(5, 120)) + " " + passage + " " + sentence(rng, rng.randrange(5, 120)))
    texts += [sentence(rng, 80) for _ in range(20)] + ["é" * 300 + " x", "ü" + "é" * 300, "lone"]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[-1], (None, base)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("tk", F.lit(1))


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width,percent,sketch,stars", [(4, 80, 64, 4), (5, 60, 64, 0), (5, 35, None, 1), (2, 90, 32, 4)])
def test_near_duplicates(spark, corpus, monkeypatch, width, percent, sketch, stars):
    from sparkloom.llm import near_dup

    monkeypatch.setattr(near_dup, "STARS", stars)
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    got = near_dup.near_duplicates(frame(spark, corpus), width=width, percent=percent, sketch=sketch).collect()
    sets = {i: shingles(t, width) for i, t in corpus if i is not None}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id), r


def test_near_duplicates_of_one_id(spark):
    """An id on two different texts: each links what it resembles, and only near-duplicates go."""
    import corpus_pipeline
    from sparkloom.llm.near_dup import near_duplicates

    rng = random.Random(3)
    x, y, z = (sentence(rng, 100) for _ in range(3))
    rows = [(5, x), (5, y), (5, z), (7, x + " more"), (8, y + " more"), (3, z + " more"), (5, ""), (5, z)]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(5, 5, True): 3, (5, 3, False): 2, (7, 5, False): 1, (8, 5, False): 1, (3, 3, True): 1}
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in [*rows, (5, x + " end")]], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    mine = [t for i, t in left if i == 5 and t.startswith(x)]
    assert len(mine) == 1 and sorted(left) == sorted([(5, mine[0]), (5, y), (5, ""), (3, z + " more")])


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix_dedup(spark, corpus, batches):
    from sparkloom.llm.suffix_dedup import remove_repeats, suffix_dedup

    width = 200
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup(frame(spark, corpus), min_bytes=width, batches=batches).collect()}
    texts = [(i, (t or "").encode()) for i, t in corpus]
    seen = collections.Counter(b[k : k + width] for _, b in texts for k in range(len(b) - width + 1))
    kept_texts = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i, len(b)]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
        kept_texts.append(kept.decode("utf-8", "ignore"))
    left = remove_repeats(frame(spark, corpus), min_bytes=width, batches=batches)
    assert left.columns == ["doc_id", "text", "n", "tk"]
    assert sorted(r.text or "" for r in left.collect()) == sorted(kept_texts)


def test_long_text_in_segments(spark, monkeypatch):
    import pyarrow as pa

    from sparkloom.llm import suffix_dedup as s
    from sparkloom.llm import texthash

    rng = random.Random(1)
    passage = sentence(rng, 60)
    texts = [(0, sentence(rng, 400) + passage + sentence(rng, 300)), (1, passage + sentence(rng, 200)), (2, "ab" * 2000), (None, sentence(rng, 90) + passage[:250] + "é" * 400 + passage[100:])]
    sizes = []
    pieces = texthash.pieces
    # Workers import the module anew, so what they do is done here too, with short segments.
    monkeypatch.setattr(s, "SEGMENT", 300)
    monkeypatch.setattr(texthash, "pieces", lambda t, limit: sizes.append(len(t)) or pieces(t, limit))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, None], pa.int64()), pa.array([0, 1, 2, 3]), pa.array([t for _, t in texts])], names=["doc_id", "tk", "text"])
    (short,) = s._sampler(200)([batch])
    monkeypatch.setattr(s, "SEGMENT", 1 << 20)
    (whole,) = s._sampler(200)([batch])
    assert sizes[0] > 3 * sizes[1] == 12
    # A run that a segment's end divides comes in two parts; together they cover the same windows.
    for one, two in zip(short.column("suffixes").to_pylist(), whole.column("suffixes").to_pylist()):
        windows = [{(x["k1"], x["p"], i) for x in runs for i in range(x["s"], x["e"] + 1)} for runs in (one, two)]
        assert windows[0] == windows[1] and windows[0]
    got = {x.doc_id: x for x in s.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"), batches=3).collect()}
    texts = {i: t.encode() for i, t in texts}
    seen = collections.Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert (got[i].n_removed, got[i].n_spans) == (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())), i


def test_suffix_arrays(spark):
    """Each suffix's longest match with any other, against all pairs; levels grow geometrically."""
    from sparkloom.llm import suffix_dedup as s
    from sparkloom.llm.scratch import Scratch

    rng = random.Random(2)
    base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = [(x + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 6))), k, rng.randrange(9)) for k, x in enumerate(base * 3)]
    df = spark.createDataFrame([(bytearray(x), k, j) for x, k, j in rows], "suffix binary, k1 long, k2 long")
    family = s.SuffixIndexFamily(Scratch(spark, "t"))
    for b in range(5):
        family.insert(df.where(f"k1 % 5 = {b}"))
    assert [n for n, _ in family.levels] == [4, 1]
    got = {(r.k1, r.k2): r.reach for r in family.matches().collect()}

    def common(x, y):
        return next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

    assert got == {(k, j): max(common(x, y) for y, m, _ in rows if m != k) for x, k, j in rows}


def test_bpe(spark, corpus):
    import public_tokenizers as P
    import tiktoken

    from sparkloom.llm.bpe import bpe_decode, bpe_encode, load_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    rng = random.Random(6)
    knots = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aeinst", "etaoinshrdlu") for n in (63, 65, 130, 1500)]
    rows = corpus + [(1000, "x" * 5000 + "zq" * 900), (1002, " ".join(knots)), (5, "another text of this id"), (1001, "日本語 <|endoftext|> 🎉́ \x00\r\n  tail  ")]
    df = bpe_encode(frame(spark, rows), path, P.PATTERN, keep_ids=True)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    want = collections.Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = {r.doc_id: r.text for r in bpe_decode(df.where("doc_id >= 1000"), path).collect()}
    assert back == {i: t for i, t in rows if i and i >= 1000 and t}


def test_url_filter(spark):
    from sparkloom.llm.queries import URL_RULES
    from sparkloom.llm.url_filter import filter_urls, split_rule

    hosts = ["com", "example.com", "Example.COM", "a.b.example.net", "xexample.com", "example.org", "com.au", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/70?x#y", "/de/8.html", "/de/", "/es/1", "/EN/7"]
    urls = [None, "", "no scheme.com/en/7", "://", "http://x.com/en/7://y"] + [f"https://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#z")]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fit = [(len(p), p, a) for a, p in URL_RULES for h, q in [split_rule(p)] if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    got = {r.page_id: tuple(r)[1:] for r in filter_urls(rows, URL_RULES).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert {r.verdict for r in filter_urls(rows, []).collect()} == {"allow"}
    plan = filter_urls(rows, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract has it, and hosts with line feeds."""
    from sparkloom.llm.queries import op1_url_filters

    want = {
        "http://example.com/en/1": ("com/en/", "block"),
        "http://example.com/en/71": ("example.com/en/7", "allow"),
        "http://example.net/de/1": ("net/de/", "allow"),
        "http://a.example.net/de/81": ("example.net/de/8", "block"),
        "http://xexample.net/de/8": ("net/de/", "allow"),
        "http://example.org/es/1": ("org/es/", "block"),
        "http://example.org/en/1": (None, "allow"),
        "http://a\nb.com/en/1": ("com/en/", "block"),
        "http://com\n/en/1": (None, "allow"),
        "http://x/y.com\n/en/1": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op1_url_filters(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_mixing(spark):
    from sparkloom.llm.mixing import mix_sources, mixed_documents, water_fill

    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None, "zero"]), rng.randrange(1, 400)) for k in range(3000)]
    rows = [(k, s, 0 if s == "zero" else n) for k, s, n in rows] + [(None, "a", 5), (7, "a", 5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mix_sources(sized, (3.0, 1.0, 2.0)).collect()
    assert len(out) == len(rows)
    totals = collections.defaultdict(int)
    for _, s, n in rows:
        totals[s] += n
    order = sorted(k for k in totals if k is not None) + [None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * totals[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = collections.defaultdict(int)
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == totals[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in order:
        assert abs(taken[s] - target[s]) <= 400, s
    again = collections.Counter((r.doc_id, r.size, r.copies) for r in mix_sources(sized.repartition(7), (3.0, 1.0, 2.0)).collect())
    assert again == collections.Counter((r.doc_id, r.size, r.copies) for r in out)
    docs = spark.createDataFrame([(1, "a b c", "x", "m"), (2, None, None, "m")], "doc_id long, text string, source string, copies string")
    assert mixed_documents(docs, (1.0,)).columns == docs.columns
    assert water_fill(spark.createDataFrame([], "source string, source_size long, weight double"), 1.5, 2.0).count() == 0


def test_mixing_salted_join(spark, monkeypatch):
    from sparkloom.llm import mixing

    sized = spark.createDataFrame([(k, f"s{k % 5}", 10 + k) for k in range(50)], "doc_id long, source string, size long")
    want = sorted(tuple(r) for r in mixing.mix_sources(sized, (3.0, 1.0, 2.0)).collect())
    monkeypatch.setattr(mixing, "SMALL", 2)
    assert sorted(tuple(r) for r in mixing.mix_sources(sized, (3.0, 1.0, 2.0)).collect()) == want


def test_toxicity_chain(spark):
    from sparkloom.llm.toxicity import drop_toxic, score_toxicity, train

    rng = random.Random(9)
    bad, junk = ["vile", "rotten", "scummy"], ["%%%", "###"]
    rows, labels = [], []
    for k in range(900):
        words, toxic, low = sentence(rng, rng.randrange(10, 400)).split(), k % 8 == 0, k % 5 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        for _ in range(4 * low):
            words.insert(rng.randrange(len(words)), rng.choice(junk))
        rows.append((k, " ".join(words)))
        if k < 600:
            labels.append((k, int(toxic), int(not low)))
    docs = spark.createDataFrame(rows + [(None, None), (5, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    chain = train(docs, table, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    held = [r for r in score_toxicity(docs, chain).collect() if r.doc_id is not None and r.doc_id >= 600]
    assert len(held) == 300
    assert sum((r.toxic >= 0.5) == (r.doc_id % 8 == 0) for r in held) >= 295
    assert sum((r.low_quality >= 0.5) == (r.doc_id % 5 == 0) for r in held) >= 290
    kept = drop_toxic(docs, chain)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {k for k in range(0, 900, 8) if chain.predict([rows[k][1]])[0][1] >= 0.5}
    assert train(docs, table.limit(0), {"toxic": "toxic = 1"}) is None
    assert score_toxicity(docs, None).where("toxic > 0").count() == 0


def newton(x, y, l2):
    """A logistic regression solved to the end by Newton steps, on columns of mean 0 and variance 1."""
    mean, scale = x.mean(axis=0), 1 / np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = np.hstack([(x - mean) * scale, np.ones((len(x), 1))])
    keep = np.append(np.full(x.shape[1], l2), 0.0)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + np.diag(keep + 1e-12), z.T @ (p - y) / len(y) + keep * w)
    return lambda v: 1 / (1 + np.exp(-(np.hstack([(v - mean) * scale, np.ones((len(v), 1))]) @ w)))


def test_toxicity_by_a_dense_chain(spark):
    """Features, folds and both models of the chain against plain loops and an exact solver over the same rows."""
    import math
    import re

    from sparkloom.llm import toxicity as t

    rng = random.Random(4)
    rows = []
    for k in range(400):
        words = [w for w in sentence(rng, rng.randrange(5, 60)).split()]
        words += [rng.choice(["vile", "rotten"]) for _ in range(rng.choice([0, 1, 3]) if k % 4 == 0 else rng.random() < 0.05)] + ["%%%"] * (k % 3 == 0 and rng.random() < 0.9)
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(k % 4 == 0), int(k % 3 != 0)))
    rows += [(7, None, 0, 1), (9, "", 0, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, tox, q) for k, _, tox, q in rows[:400]], "doc_id long, toxic int, quality int")
    chain = t.train(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"})

    def features(text):
        count = collections.Counter()
        for w in set(re.findall(r"[^\W\d_]+|[^\w\s]{2,}|[|]", text.lower())):
            for raw in {b"=" + w.encode()} | {w[:n].encode() for n in (4, 5, 6, 7) if len(w) >= n}:
                count[zlib.crc32(raw) % t.BUCKETS] += 1
        out = set()
        for b, n in count.items():
            out |= {b} | {(b * 2654435761 + m * 40503) % t.BUCKETS for m in (2, 3) if n >= m}
        return out

    # Id 9 has two texts; the one of smaller hash was fitted.
    first = {r.doc_id: r.text for r in docs.where("text is not null and doc_id < 400").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()}
    held = [features(first[k]) for k in range(400)]
    y = {"low_quality": np.array([1.0 - r[3] for r in rows[:400]]), "toxic": np.array([float(r[2]) for r in rows[:400]])}
    every = collections.Counter(b for h in held for b in h)
    chosen = set()
    for v in y.values():
        inside = collections.Counter(b for h, one in zip(held, v) if one for b in h)
        p, n, sure = v.sum(), (1 - v).sum(), {}
        for f, c in every.items():
            a, b = inside[f], c - inside[f]
            odds = math.log((a + 0.5) / (p - a + 0.5)) - math.log((b + 0.5) / (n - b + 0.5)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if c >= 5 and odds > t.MARGIN:
                sure[f] = odds
        chosen |= set(sorted(sure, key=lambda f: (-sure[f], f))[: t.FEATURES])
    assert chosen == set(chain.index)
    x = np.array([[float(f in h) for f in chain.index] for h in held])
    fold = np.array([zlib.crc32(first[k].encode()) % t.FOLDS for k in range(400)])
    early = np.zeros(400)
    for f in range(t.FOLDS):
        early[fold == f] = newton(x[fold != f], y["low_quality"][fold != f], t.L2)(x[fold == f])
    low = newton(x, y["low_quality"], t.L2)
    toxic = newton(np.hstack([x, early[:, None]]), y["toxic"], t.L2)
    got = chain.predict([first[k] for k in range(400)])
    want = np.stack([low(x), toxic(np.hstack([x, low(x)[:, None]]))], axis=1)
    assert np.abs(got - want).mean() < 0.02 and ((got >= 0.5) == (want >= 0.5)).mean() > 0.99


def test_language_by_plain_loops(spark):
    """Frequencies and votes against loops over bytes, and every machine against a longer descent on its objective."""
    from itertools import combinations

    from sparkloom.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").where("lang is not null")
    texts = [(r.text, r.lang) for r in docs.dropDuplicates(["text"]).collect() if r.text][:120]
    assert len({lang for _, lang in texts}) >= 3

    def frequencies(text):
        table = {65 + k: 97 + k for k in range(26)} | {48 + k: 48 for k in range(10)} | {k: 32 for k in (9, 10, 11, 12, 13)}
        b = [table.get(c, c) for c in b" " + text.encode() + b"  "]
        count = np.zeros(langid.DIMENSIONS)
        for i in range(len(b) - 2):
            h = (b[i] * 0x9E3779B1 ^ b[i + 1] * 0x85EBCA77 ^ b[i + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            count[h >> 20] += 1
        return np.sqrt(count / (len(b) - 2))

    x = langid.featurize([t.encode() for t, _ in texts])
    plain = np.array([frequencies(t) for t, _ in texts[:30]])
    assert np.allclose(x[:30], plain, atol=1e-6)
    y = np.array([lang for _, lang in texts])
    model = langid.Model(x, list(y))
    family = np.array([langid._family(v) for v in y])
    for (level, a, b), w, bias in zip(model.machines, model.w, model.b):
        names = family if not level else y
        mask = (names == a) | (names == b)
        z, sign = x[mask].astype(float), np.where(names[mask] == a, 1.0, -1.0)
        loss = lambda w, c: 0.5 * (np.maximum(0, 1 - sign * (z @ w + c)) ** 2).mean() + 0.5e-5 * w @ w  # noqa: E731, B023
        v, c = np.zeros(z.shape[1]), 0.0
        for _ in range(600):
            short = np.maximum(0, 1 - sign * (z @ v + c)) * -sign / len(sign)
            v, c = v - 0.5 * (z.T @ short + 1e-5 * v), c - 0.5 * short.sum()
        assert loss(w, bias) <= loss(v, c) * 1.01 + 1e-4
    told = model.predict([t.encode() for t, _ in texts[:30]])
    for row, (lang, score) in zip(plain, told):
        margins = dict(zip(model.machines, model.w @ row + model.b))

        def winner(level, names):
            votes = {n: [0, 0.0] for n in names}
            for a, b in combinations(names, 2):
                m = margins[level, a, b]  # noqa: B023
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
            return max(names, key=lambda n: tuple(votes[n]))

        group = winner("", sorted(model.families))
        assert lang == winner(group, model.families[group]) and 0 < score <= 1


def test_language_id(spark):
    from sparkloom.llm.langid import identify, train

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fit, rest = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    model = train(fit)
    assert set(model.families) == {"germanic", "romance"}
    got = identify(rest, model).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (None, "the house")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.lang_pred == "und") for r in identify(odd, model).collect()) == [(0, False), (1, True), (2, True), (3, True)]
    assert train(fit.limit(0)) is None and {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_language_sample(spark, monkeypatch):
    """The sample holds distinct texts in equal shares: copies and a rare language don't move it."""
    from sparkloom.llm import langid

    fitted = []
    model = langid.Model
    monkeypatch.setattr(langid, "Model", lambda rows, langs: fitted.append(list(langs)) or model(rows, langs))
    rows = [(f"the text number {k} of them", "en") for k in range(400)] * 5
    rows += [(f"el texto numero {k} de ellos", "es") for k in range(300)] + [("der eine", "de"), ("der andere", "de"), (None, "de"), ("x", None)]
    rows += [("one text that fills the table", "en")] * 3000
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert langid.train(docs, sample=80) is not None
    assert collections.Counter(fitted[0]) == {"de": 2, "en": 39, "es": 39}
    few = spark.createDataFrame([(f"text {k}", "en") for k in range(10)] * 500, "text string, lang string")
    assert langid.train(few, sample=100) is not None and len(fitted[1]) == 10


def test_language_whole_texts(spark):
    """Texts whose languages differ only after a long common start are learned from their ends."""
    from sparkloom.llm.langid import identify, train

    ends = {"en": "the house and the garden of the king ", "es": "la casa y el jardin del rey de los "}
    texts = [(k, f"{k} " + "0123 -- " * 1200 + ends[lang] * 300, lang) for k, lang in enumerate(["en", "es"] * 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = identify(docs, train(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in texts}


def test_nearest(spark):
    from sparkloom.llm.ann import hilbert, nearest

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    x[100:160] = x[100]  # equal vectors
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(5001, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, 2.0]), (None, [1.0] * 16), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for r in nearest(df, k=20, step=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(3000), -s))[:20]
        hit += len(set(true.tolist()) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-12 for i, v in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert hit >= 0.9 * 20 * len(got)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id in (0, 20)")).count() == 2
    grid = np.stack(np.meshgrid(np.arange(8), np.arange(8)), -1).reshape(-1, 2)
    path = grid[np.argsort(hilbert(grid.astype(np.int64), 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # neighbours along the curve are neighbours in space


def test_nearest_over_many_cells(spark, monkeypatch):
    """The index's recall where cells are small, copied and far fewer than all are searched; lengths differ."""
    from sparkloom.llm import ann

    monkeypatch.setattr(ann, "CELL", 256)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(7)
    n = 12000
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 24))) * rng.uniform(0.5, 2, (n, 1))
    searched = []
    search = ann._windows
    monkeypatch.setattr(ann, "_windows", lambda ranked, scratch, reach, most, k: searched.append(reach / most) or search(ranked, scratch, reach, most, k))
    df = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, k=20, step=20).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(got[q]) == 20 for q in range(0, n, 20)) and len(got) == n // 20
    hit = 0
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got) and searched[-1] < 0.25


def test_token_store(spark, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from sparkloom.llm.token_store import decode_blocks, encode_blocks, token_round_trip

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus, (2000, "a <|endoftext|> b"), (2000, "<|endoftext|"), (2000, None), (None, "other"), (None, None), (3000, "<|endoftext|><|endoftext|> " + "long text 12 " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("h", F.lit("clash"))
    got = sorted(token_round_trip(df.repartition(3), path, P.PATTERN).collect(), key=lambda r: r.start)
    want = collections.Counter()
    for i, s in rows:
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, int), np.array([65535]), rng.integers(0, 65536, 5000), np.zeros(9000, int), rng.zipf(1.3, 7000) % 50257):
        assert (decode_blocks(encode_blocks(ids)) == ids).all()
    assert len(encode_blocks(np.tile(np.arange(50), 2000))) < 40_000  # 200,000 bytes of repeating ids
    broken = bytearray(encode_blocks(np.arange(3000)))
    broken[40] ^= 255
    with pytest.raises(ValueError):
        decode_blocks(bytes(broken))


def test_audio(spark):
    from sparkloom.llm.audio import HOP, RATE, align_recordings, encode_wav, fingerprint

    rng = np.random.default_rng(4)

    def tune(notes):
        t = np.arange(RATE // 8) / RATE
        return np.concatenate([np.sin(2 * np.pi * 262 * 2 ** (n / 12) * t) * 0.5 for n in notes])

    songs = [tune(rng.integers(0, 24, 64)) for _ in range(4)]
    shift = 12 * HOP
    noisy = songs[0][shift:] + 0.01 * rng.normal(size=len(songs[0]) - shift)
    media = [(0, songs[0]), (20, songs[1]), (1, noisy), (2, songs[0]), (3, songs[2]), (4, songs[3])]
    rows = [(i, encode_wav(x)) for i, x in media] + [(60, None), (61, b"junk"), (62, encode_wav(np.zeros(100))), (None, encode_wav(songs[2]))]
    prints = fingerprint(spark.createDataFrame(rows, "id long, m binary").withColumn("codes", F.lit(1)), "id", "m")
    got = {r.id: r for r in align_recordings(prints, step=20).collect()}
    assert got[0].class_id == got[2].class_id == 0 and got[1].class_id == 1
    assert (got[0].n_links, got[0].best_class, got[0].best_offset) == (1, 1, -12)
    show = tune(rng.integers(0, 24, 8 * 400))  # some minutes, and ten seconds out of them
    part = show[5000 * HOP : 5000 * HOP + 10 * RATE]
    there = align_recordings(fingerprint(spark.createDataFrame([(0, encode_wav(show)), (1, encode_wav(part)), (2, encode_wav(songs[1]))], "id long, m binary"), "id", "m"), step=1).collect()
    assert {r.id: (r.n_links, r.best_class, r.best_offset) for r in there} == {0: (1, 1, -5000), 1: (1, 0, 5000), 2: (0, None, None)}
    loud = [encode_wav(songs[0] * 0.5 + x * rng.normal(size=len(songs[0]))) for x in (0, 0.05, 0.1)]  # a tenth of the bits wrong at most
    heard = align_recordings(fingerprint(spark.createDataFrame(list(enumerate(loud)), "id long, m binary"), "id", "m"), step=1)
    assert {r.n_links for r in heard.collect()} == {2}
    assert got[20].n_links == 0 and got[60].class_id is None and got[61].n_codes == 0 and got[62].n_codes == 0
    assert align_recordings(prints.limit(0)).count() == 0


def test_audio_every_offset(spark):
    """Links and the best against votes and bit error at every offset of every pair; noisy copies share few whole codes."""
    from sparkloom.llm import audio

    rng = np.random.default_rng(1)
    lists = []
    for n in (47, 47, 60, 20, 16, 10, 150):
        base = rng.integers(0, 2**32, n, np.uint32)
        for noise in (0.0, 0.03, 0.06, 0.1, 0.18):
            flips = (rng.random((n, 32)) < noise) @ (1 << np.arange(32, dtype=np.uint64))
            lists.append((base ^ flips.astype(np.uint32))[int(rng.integers(0, 4)) :])
    lists += [np.zeros(50, np.uint32), np.zeros(30, np.uint32)]  # a held chord aligns at many offsets
    weak = [np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, (len(c), 3)).astype(np.uint32), axis=1) for c in lists]
    kind = "id long, n_codes long, codes array<int>, weak array<int>"
    prints = [(k, len(c), c.view(np.int32).tolist(), w.view(np.int32).tolist()) for k, (c, w) in enumerate(zip(lists, weak))]
    got = {r.id: r for r in audio.align_recordings(spark.createDataFrame(prints, kind), step=2).collect()}
    sparse = 0
    for i in range(0, len(lists), 2):
        links, best = set(), (2.0, None, None)
        for j in range(len(lists)):
            a, c = lists[i], lists[j]
            for offset in range(-len(a), len(c)) if i != j else ():
                start, end = max(0, -offset), min(len(a), len(c) - offset)
                if end - start < audio.OVERLAP:
                    continue
                differ = np.bitwise_count(a[start:end] ^ c[start + offset : end + offset])
                rate = float(differ.sum()) / (32.0 * (end - start))
                x, y = a[start:end], c[start + offset : end + offset]
                votes = int((((x ^ y) & ~weak[i][start:end]) == 0)[(x != 0xFFFFFFFF) & (y != 0xFFFFFFFF)].sum())
                if rate <= audio.ERRORS and votes >= audio.VOTES:
                    links.add(j)
                    sparse += (differ == 0).sum() < 6
                    best = min(best, (rate, j, offset))
        assert (got[i].n_links, got[i].best_class, got[i].best_offset) == (len(links), best[1], best[2])
    assert sparse > 3
    same = [(k, n, [-1] * n, [7] * n) for k, n in enumerate((40, 40, 30))]  # silence alone aligns nothing
    assert {r.n_links for r in audio.align_recordings(spark.createDataFrame(same, kind), step=1).collect()} == {0}


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_minhash_near_dedup", "op5_suffix_array_dedup", "op6_source_mixing"])
def test_queries_against_sql(spark, name):
    import duckdb

    from sparkloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    plain = lambda rows: sorted(tuple("" if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got) == plain(want.fetchall())


def test_empty_tables(spark):
    import public_tokenizers as P

    import corpus_pipeline
    from sparkloom.llm import bpe, langid, mixing, near_dup, suffix_dedup, token_store, toxicity, url_filter

    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels, {"toxic": "toxic = 1"}) is None
    assert toxicity.score_toxicity(docs, None).count() == 0 and toxicity.drop_toxic(docs, None).count() == 0
    assert langid.identify(docs, None).count() == 0
    whole = docs.selectExpr("doc_id", "text", "'x' as lang", "source", "1 as n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, whole, "").count() == 0, name
    assert near_dup.near_duplicates(docs).count() == 0
    assert suffix_dedup.suffix_dedup(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert bpe.bpe_encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert mixing.mixed_documents(docs, (1.0, 2.0)).count() == 0
    assert token_store.token_round_trip(docs, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), [("block", "com/")]).count() == 0


def test_very_long_texts(spark):
    """Texts of millions of bytes, one of them a single word, among short ones and columns of clashing names."""
    from sparkloom.llm import langid, near_dup, suffix_dedup, toxicity

    rng = random.Random(12)
    long = sentence(rng, 150_000)
    rows = [(1, long), (2, long[:-2000] + " " + sentence(rng, 250)), (3, "x" * 1_500_000), (4, "short text here"), (None, "")]
    docs = frame(spark, rows).withColumn("lang", F.lit("en")).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert near[2].component_id == 1 and not near[2].kept and near[3].component_id == 3 and near[1].n_shingles == len(shingles(long, 5))
    cut = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert cut[1].n_bytes == len(long) and len(long) - 2000 <= cut[1].n_removed <= len(long) - 1900 and cut[3].n_removed == 1_500_000
    labels = spark.createDataFrame([(k, 1, int(k == 3)) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels, {"toxic": "toxic = 1"}))
    assert scored.count() == 5 and scored.where("toxic is null").count() == 0
    told = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert told == {1: "en", 2: "en", 3: "en", 4: "en", None: "und"}


def test_components(spark):
    from sparkloom.llm.components import connected_components
    from sparkloom.llm.scratch import Scratch

    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(1, None), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in df.collect()} == {x: find(x) for x in list(root)}


def test_pipeline(spark, tmp_path):
    """The rows of ``run`` against a plain chain in Python; every stage takes something away or repeats it."""
    import corpus_pipeline as p
    import public_tokenizers as P
    import tiktoken

    from sparkloom.llm import mixing, queries, toxicity
    from sparkloom.llm.bpe import load_ranks

    rng = random.Random(8)
    passage = sentence(rng, 60)
    rows = []
    for k in range(300):
        words = sentence(rng, rng.randrange(30, 80)).split()
        if k % 6 == 0:
            words[3:3] = ["vile", "rotten"]
        text = " ".join(words)
        if k % 10 == 1:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        rows.append((k, text, "en", f"s{k % 3}" if k % 7 else None, len(text)))
    rows += [(400 + k, rows[5 + 2 * k][1] + f" end{k}", "en", "s0", 1) for k in range(20)]
    rows += [(7, rows[50][1] + " x", "en", "s1", 1), (None, None, None, None, None), (500, "", "en", "s1", 0), (None, rows[8][1], "en", "s2", 1), rows[20]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("text_hash", F.lit("clash")).withColumn("copies", F.lit(0))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = rows

    # Toxicity: the same chain, asked text by text.
    chain = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), queries.TOXIC_CATEGORIES)
    clean = [r for r in now if chain.predict([r[1] or ""])[0][1] < 0.5]
    assert 0 < len(clean) < len(now)
    now = clean

    # Near-duplicates: of each group the row of smallest id, then of smallest text hash.
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    named = sorted({r for r in now if r[0] is not None}, key=lambda r: (r[0], hashes[r[1]]))
    sets, group = [shingles(r[1], 5) for r in named], list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept = {}
    for r, g, h in zip(named, group, sets):
        kept.setdefault(("set", g) if h else ("none", r[0], r[1]), r)
    now = [r for r in now if r[0] is None] + list(kept.values())
    assert len(now) < len(clean)

    # Repeated strings of 200 bytes.
    texts = [(r[1] or "").encode() for r in now]
    seen = collections.Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    cut, removed = [], 0
    for r, b in zip(now, texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        removed += int(gone.sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if b else ""
        cut.append((r[0], None if r[1] is None else left, r[3]))
    assert removed > 0

    # Mixing, with the bucket order of the operator's seed.
    size = [len((t or "").split()) for _, t, _ in cut]
    total = collections.defaultdict(int)
    for (_, _, s), n in zip(cut, size):
        total[s] += n
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    target |= {s: weight[s] * level for s in free}
    mixed = []
    later = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t, _ in cut], "t string").select("t", F.xxhash64("t").alias("h")).distinct().collect()}
    for s in order:
        mine = [k for k in range(len(cut)) if cut[k][2] == s]
        digest = {k: hashlib.md5(f"17:{'' if cut[k][0] is None else cut[k][0]}".encode()).hexdigest() for k in mine}
        buckets = -(-len(mine) // mixing.BUCKET)
        mine.sort(key=lambda k: (int(digest[k][:8], 16) % buckets, -size[k], digest[k], later[cut[k][1]]))
        rate = target[s] / total[s] if total[s] else 0.0
        part = rate - np.floor(rate)
        for at, k in enumerate(mine):
            copies = int(np.floor(rate) + np.floor((at + 1) * part + 0.5) - np.floor(at * part + 0.5))
            mixed += [cut[k][:2]] * copies
    assert len(mixed) > len(cut)

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for i, t in mixed:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, str(tmp_path)).collect())
    assert got == want
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in p.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == p.COLUMNS, name
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]
