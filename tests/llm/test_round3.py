"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, many partitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import clusters, decontam, shingles, trie

# clustering


def brute_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * scale) < 2**26 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z, strict=True))
    near = lambda v: min(range(len(c)), key=lambda z: (far(v, c[z]), z))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [v for (_, v), a in zip(kept, at, strict=True) if a == z]) else c[z] for z in range(len(c))]
    at = [near(v) for _, v in kept]
    d = [far(v, c[a]) for (_, v), a in zip(kept, at, strict=True)]
    own = defaultdict(int)
    for a, x in zip(at, d, strict=True):
        own[a] += x
    sha = lambda z: hashlib.sha256(",".join(map(str, z)).encode()).hexdigest()
    return sorted((str(i), a, x, own[a], sum(d), sha(c[a])) for (i, _), a, x in zip(kept, at, d, strict=True))


def got_clusters(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(parts)
    out = clusters.cluster_vectors(df, **kw).drop("centroid").collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # copies
    rows += [(7, [0.25] * 6), (None, [1.0] * 6), (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] * 6), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (2006, [1e300] * 6)]
    for k, parts in ((1, 1), (5, 3), (40, 2)):
        assert got_clusters(spark, rows, parts, k=k, dims=6) == brute_clusters(rows, k, 5, 6)
    assert got_clusters(spark, rows[:3], k=40, dims=6) == brute_clusters(rows[:3], 40, 5, 6)  # fewer than k
    assert got_clusters(spark, [(1, None)], dims=6) == []


def test_clusters_ties_and_large_values(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(27)]  # repeated points, equal distances
    assert got_clusters(spark, grid, k=4, dims=2, scale=1) == brute_clusters(grid, 4, 5, 2, 1)
    large = [(i, [float(x) for x in np.random.default_rng(i).integers(-(2**26) + 1, 2**26, 3)]) for i in range(60)]
    assert got_clusters(spark, large, k=6, dims=3, scale=1) == brute_clusters(large, 6, 5, 3, 1)


def test_no_centroid_that_may_win_is_pruned():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(-20, 20, (200, 4))
        c = rng.integers(-20, 20, (12, 4))
        t = clusters.Tree(x)
        at, whole = clusters.assign(t, c)
        assert (at == clusters.squared(t.x, c).argmin(axis=1)).all()
        assert all((t.sums[n] == t.x[t.lo[n] : t.hi[n]].sum(axis=0)).all() for n, _ in whole)
    near = np.concatenate([rng.integers(0, 3, (500, 4)), rng.integers(0, 3, (500, 4)) + 1000])
    _, whole = clusters.assign(clusters.Tree(near), np.array([[0] * 4, [1000] * 4]))
    assert len(whole) == 2  # both halves go whole


# decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, window=10, shingle=3, threshold=1.0):
    units = set()
    for i, t in items:
        w = words(t)
        m = len(w) if window is None else min(window, len(w))
        units |= {(i, tuple(w[s : s + m])) for s in range(len(w) - m + 1) if m}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, u in units:
            m = len(u)
            k, n, need = decontam.need_of(m, shingle, threshold)
            for s in range(len(w) - m + 1):
                if sum(tuple(w[s + j : s + j + k]) == u[j : j + k] for j in range(n)) >= need:
                    hit |= set(range(s, s + m))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got_hits(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, words int")
    out = decontam.contamination(d, b, **kw).collect()
    for r in out:
        assert r.n_hit == sum(s.end - s.start for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out), key=str)


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["é", "ñandú", "x" * 40]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(5, "Alpha beta, GAMMA"), (None, "secret words without an id"), (99, None), (98, " ,; "), (97, items[3][1]), (96, "the the the the the the the the the the the the")]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 12])))]
        for _ in range(rng.choice([0, 1, 2])):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts.append(rng.choice([" ", ", ", "\n"]).join(w[a:] if rng.random() < 0.3 else w).upper())
        docs.append((d, "! ".join(parts)))
    docs += [(0, docs[5][1]), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "..."), (None, "alpha-beta gamma"), (903, "the " * 3000), (904, "secret words without an id")]
    return docs, items


def test_decontamination_against_brute_force(spark, benchmark):
    docs, items = benchmark
    assert got_hits(spark, docs, items) == brute_hits(docs, items)


@pytest.mark.parametrize(("window", "shingle", "threshold"), [(10, 3, 0.6), (None, 3, 1.0), (None, 2, 0.5), (4, 5, 1.0), (6, 1, 0.8)])
def test_decontamination_by_other_windows_and_thresholds(spark, benchmark, window, shingle, threshold):
    docs, items = benchmark
    docs = docs[::3]
    assert got_hits(spark, docs, items, window=window, shingle=shingle, threshold=threshold) == brute_hits(docs, items, window, shingle, threshold)


def test_decontamination_without_broadcast_or_exact_list(spark, benchmark, monkeypatch):
    docs, items = benchmark
    monkeypatch.setattr(decontam, "MOST_BROADCAST", -1)
    monkeypatch.setattr(decontam, "MOST_TOKENS", -1)
    assert got_hits(spark, docs, items) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark, benchmark):
    docs, items = benchmark
    assert got_hits(spark, [], items) == []
    assert got_hits(spark, docs[:5], []) == brute_hits(docs[:5], [])
    one = decontam.digests(decontam.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(10, "a"), (9, "b")], "item_id long, text string"))).first()
    assert (one.n_items, one.items_sha256, one.contaminated) == (2, hashlib.sha256(b"10,9").hexdigest(), True)


# prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent string")
    return sorted(tuple(r) for r in trie.prefix_trie(trie.shared_heads(trie.turn_arrays(df))).collect())


def talk(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([0, 1, 1, 2, 3, 3, 6])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b b", None, "c  d\te", ""])))
        if rng.random() < 0.5:  # much shared
            rows += [(c, 10 + t, "user", f"same {t}") for t in range(rng.choice([1, 4]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_trie_against_brute_force(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = talk(300, parts)
        assert got_trie(spark, rows) == brute_trie(rows)
        copies = [(c, t, "user", f"turn {t}") for c in range(500) for t in range(4 - (c % 7 == 0))]  # one array, or one turn less
        assert got_trie(spark, copies) == brute_trie(copies)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_cases(spark, monkeypatch):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "null first"), (1, 0, None, None), (1, 0, None, None), (2, 5, "b", "tie"), (2, 5, "a", "tie"), (2, 5, "a", "other"), (3, 0, "ab", "c"), (4, 0, "a", "bc"),
        (20, 0, "user", "x " * 50_000), (-5, 0, "u", "below 0"), (41, 3, "u", "no base"), *[(60, t, "user", f"t{t}") for t in range(300)], *[(61, t, "user", f"t{t}") for t in range(299)],
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0 or r[0] % 20 == r[0] % -20]
    monkeypatch.setattr(trie, "MOST_BROADCAST", -1)
    assert got_trie(spark, rows) == brute_trie(rows)
    assert got_trie(spark, []) == []


def test_common_prefix():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (b"".join(rng.choice([b"a", b"b"]) * trie.SYMBOL for _ in range(rng.randrange(8))) for _ in "ab")
        n = 0
        while n < min(len(a), len(b)) // trie.SYMBOL and a[: (n + 1) * trie.SYMBOL] == b[: (n + 1) * trie.SYMBOL]:
            n += 1
        assert trie.common_prefix(a, b) == n


# word hashes


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096, 65536])
def test_thue_morse_words_have_hashes_of_their_own(size):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    rotated = word[8:] + word[:8]
    swapped = word[8:16] + word[:8] + word[16:]
    texts = {word, other, rotated, swapped}
    h, n = shingles.word_hashes([t.encode() for t in texts])
    assert len(set(h.tolist())) == len(texts) and n.tolist() == [1] * len(texts)


def test_word_hashes_don_t_depend_on_the_place():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé\x00") for _ in range(n)) for n in [*range(1, 40), 200]]
    h, _ = shingles.word_hashes([t.encode() for t in texts])
    again, _ = shingles.word_hashes([(" \n" + "  ".join(texts)).encode()])
    assert h.tolist() == again.tolist()
    low = re.compile("[A-Z]")
    assert len(set(h.tolist())) == len({low.sub(lambda m: m[0].lower(), t) for t in texts})


def test_thue_morse_documents_are_no_copies(spark):
    from quillon.llm import ngram_join

    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_documents(docs).collect()} == {1: 1, 2: 2, 3: 1}


# language ID


def languages(spark, rows):
    from quillon.llm import langid

    return {(r.doc_id, r.lang_pred): r.score for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}


def test_language_id_without_texts_to_learn_from(spark):
    assert languages(spark, [(i, "" if i % 2 else None, "en", "x") for i in range(10)] + [(99, "some words", None, "x")]) == {**{(i, "und"): 0.0 for i in range(10)}, (99, "und"): 0.0}
    assert languages(spark, []) == {}


def test_language_id_of_null_and_repeated_ids(spark):
    a, b = "the quick brown fox and the lazy dog of that thing number", "ñandú llegó mañana señor con el niño pequeño y la número"
    rows = [(None, f"{a} {i}", "en", "x") for i in range(150)] + [(None, f"{b} {i}", "es", "x") for i in range(150)] + [(7, a, "en", "x")] * 300 + [(8, None, "fr", "x")]
    got = languages(spark, rows)
    assert {k[1] for k in got if k[0] is None} == {"en", "es"} and (7, "en") in got and (8, "und") in got


def test_language_id_accuracy_on_held_out_documents(spark):
    import os

    from quillon.llm import langid

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    out = langid.identify(docs).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang").filter("lang is not null"), "doc_id")
    right, all_ = out.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    print("held-out accuracy", right, all_, right / all_)
    assert all_ > 2000 and right / all_ >= 0.95


# hosts, quotes, secrets


def test_hosts_with_ports_users_and_addresses(spark):
    from pyspark.sql import functions as F

    from quillon.llm import urls

    rows = ["example.com:8080", "user:pw@www.example.co.uk:1", "10.0.0.1", "10.0.0.1:80", "[::1]:443", "a.github.io", "b.github.io", "", "localhost", "1.2.3.example.de"]
    df = spark.createDataFrame([(h,) for h in rows], "host string")
    got = {r.host: (r.s, r.d) for r in df.select("host", urls.suffix_of(F.col("host")).alias("s"), urls.domain_of(F.col("host")).alias("d")).collect()}
    assert got["example.com:8080"] == ("com", "example.com") and got["user:pw@www.example.co.uk:1"] == ("co.uk", "example.co.uk")
    assert got["10.0.0.1"] == got["10.0.0.1:80"] == ("10.0.0.1", "10.0.0.1") and got["[::1]:443"] == ("[::1]", "[::1]")
    assert got["a.github.io"] == ("io", "github.io") and got["1.2.3.example.de"] == ("de", "example.de")
    named = df.filter("host like '%github%'").select(urls.suffix_of(F.col("host"), ("github.io",)).alias("s"), urls.domain_of(F.col("host"), ("github.io",)).alias("d"))
    assert sorted(map(tuple, named.collect())) == [("github.io", "a.github.io"), ("github.io", "b.github.io")]
    pages = spark.createDataFrame([(1, "http://h/", "short *"), (2, "http://h/", "*" * 300)], "page_id long, url string, html string")
    assert [r.bad for r in urls.symbol_outcomes(pages).orderBy("page_id").collect()] == [None, 1]
    assert [r.bad for r in urls.symbol_outcomes(pages, least_text=0).orderBy("page_id").collect()] == [1, 1]


def test_short_quotes_link_to_other_conversations(spark):
    from quillon.llm import chat

    rows = [(1, 0, "u", "Yes."), (2, 0, "u", "> Yes.\nwhy"), (3, 0, "u", "no"), (3, 1, "u", ">> yes.\nYes."), (1, 1, "u", "> Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links = lambda **kw: {(r.conv_id, r.turn): (r.to_conv, r.to_turn) for r in chat.quote_links(df, **kw).collect()}
    assert links() == {(2, 0): (1, 0), (3, 1): (1, 0), (1, 1): (1, 0)}
    assert links(least=8) == {(1, 1): (1, 0)}


def test_secrets_of_many_repositories_are_examples(spark):
    from quillon.llm import secrets

    token, plain = "aZ3dE6gH9jK2mN5pQ8sT1vW4", "aaaaaaaaaaaaaaaaaaaaaaa1aaa1"
    rows = [(i, f"key {token} here {plain}" if i < 3 else f"note {token[::-1]} end", "owner", f"repo{i}", "x") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string, live string")
    got = {r.doc_id: [s.value for s in r.live] for r in secrets.scan_secrets(df, "owner", "repo").collect()}
    assert got[0] == [token] and got[5] == []  # one owner, but eleven repositories; a token of two characters is none
    got = {r.doc_id: [s.value for s in r.live] for r in secrets.scan_secrets(df, "owner", "repo", copied_repos=20).collect()}
    assert got[5] == [token[::-1]]
