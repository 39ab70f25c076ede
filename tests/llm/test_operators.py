"""Every operator on small tables: brute force or SQL, nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, langid, lines, media, mixing, ngram_join, secrets, shingles, urls, vectors
from quillon.llm.common import Workspace, components

LONG = " ".join(f"w{i}" for i in range(3000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the very old barn".split()
TEXTS = [
    None, "", "  \n ", "One two", "one TWO", " ".join(BASE), " ".join(BASE).upper(), " ".join([*BASE, "now"]), " ".join([*BASE[:-1], "shed"]),
    LONG, LONG + " tail", "a\x0bb c", "é à ü ñ " * 5, "x", "line a\nline b\n\nline a",
]
COLS = "doc_id long, text string, lang string, source string, n long, a long, kept boolean, token string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1, 2, True, "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, COLS)


def sets(texts):
    out = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def reach(n, links):
    low = list(range(n))
    for _ in range(n):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_jaccard_join_against_brute_force(docs):
    s = sets(TEXTS)
    links = [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    low = reach(len(s), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_documents(docs).collect()}
    assert got == {i: (len(s[i]), low[i]) for i in range(len(s))}
    assert low[10] == 9 and low[7] == 5


def test_jaccard_join_random_near_copies(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):
        base = [f"v{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(len(t))] = f"n{rng.integers(9999)}"
            texts.append(" ".join(t))
    s = sets(texts)
    low = reach(len(s), [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])])
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_documents(df).collect()}
    assert got == dict(enumerate(low))


def test_jaccard_join_blocks_and_few_hubs(spark, monkeypatch):
    """Many members to a token, blocks of a few rows, one hub: most links are left to the trees."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rng = np.random.default_rng(8)
    passage = [f"p{x}" for x in range(30)]
    texts = []
    for k in range(5):
        own = [f"w{k}-{x}" for x in range(18 + 3 * k)]
        for _ in range(7):
            t = passage + own + [f"x{v}" for v in rng.integers(0, 9999, rng.integers(0, 12))]
            texts.append(" ".join(t))
    s = sets(texts)
    low = reach(len(s), [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])])
    got = {r.doc_id: r.component_id for r in ngram_join.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(low)) and 1 < len(set(low)) < len(low)


def test_jaccard_join_empty_and_null_ids(spark, docs):
    assert ngram_join.near_documents(docs.limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_documents(df).collect()} == {(None, 2, None), (4, 2, 4), (5, 0, 5)}


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.poisson(3, (40, 64))
    vec = np.concatenate([base, base + (rng.random((40, 64)) < 0.02), rng.poisson(8, (60, 64))])
    size, comp = vec.sum(axis=1), np.arange(len(vec))
    i, j = ngram_join.tree_pairs(vec, size, comp)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a, b in itertools.combinations(range(len(vec)), 2) if 180 * np.minimum(vec[a], vec[b]).sum() >= 80 * (size[a] + size[b])}
    assert want == got and len(got) >= 40


def test_bounds_are_bounds():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        x, y = (ngram_join.counts(ngram_join.point(v)) for v in (a, b))
        assert x.sum() == len(a) and ngram_join.overlap(x, y) >= inter
        assert np.minimum(ngram_join.folded(x, 64), ngram_join.folded(y, 64)).sum() >= ngram_join.overlap(x, y)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4)], "a long, b long")
    assert {(r.id, r.component) for r in components(Workspace(spark), edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5)}
    assert components(Workspace(spark), edges.limit(0)).count() == 0


def test_steps_over_small_tables_have_few_tasks(spark):
    """Shuffles of 64 partitions, of which adaptive plans may not put small ones together: a path of 300 ids takes tasks by its rows."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
        sc.setJobGroup("few-tasks", "components")
        out = components(Workspace(spark), edges)
        assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(301)]
        assert out.rdd.getNumPartitions() <= 2 * sc.defaultParallelism
        told = sc.statusTracker()
        jobs = told.getJobIdsForGroup("few-tasks")
        tasks = [told.getStageInfo(s).numCompletedTasks for j in jobs for s in told.getJobInfo(j).stageIds if told.getStageInfo(s)]
        assert len(jobs) > 5 and sum(tasks) < 2200, sum(tasks)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shingles_of_many_texts():
    assert [len(x) for x in shingles.shingle_sets([(t or "").encode() for t in TEXTS])] == [len(x) for x in sets(TEXTS)]


@pytest.mark.parametrize("n", range(6))
def test_shingles_of_few_words_in_a_chunk(n):
    words = [f"w{i}" for i in range(n)]
    alone = " ".join(words)
    whole = shingles.shingle_sets([alone.encode(), LONG.encode()])[0]
    for texts in ([alone], ["", alone], [alone, "  "]):
        got = shingles.shingle_sets([t.encode() for t in texts])
        assert [len(x) for x in got] == [len(x) for x in sets(texts)] and np.array_equal(got[texts.index(alone)], whole)
    split = shingles.shingle_sets([w.encode() for w in words])  # as many words, one to a text
    assert [len(x) for x in split] == [1] * n


def lines_by_hand(texts, least):
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    seen = {}
    for k in keys:
        for x in set(k):
            seen[x] = seen.get(x, 0) + 1
    out = []
    for t, k in zip(texts, keys, strict=True):
        keep = [x for x, y in zip((t or "").split("\n"), k, strict=True) if not (y and seen[y] >= least)]
        out.append((len(k), len(k) - len(keep), "\n".join(keep)))
    return out


def test_lines_against_brute_force(spark):
    texts = [None, "", "Hello\nx", " hello \ny\n\n", "HELLO", "hello\nhello\nz", "\n\n", "q" * 50_000, "É\nhello"]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_lines long, line string")
    rows = lines.drop_common_lines(df.select("doc_id", "text", "line"), min_docs=4, batches=3, fanout=2).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in rows] == lines_by_hand(texts, 4)
    assert rows[0].line == "c" and lines.drop_common_lines(df.select("doc_id", "text").limit(0)).count() == 0


def test_line_runs_compact_and_anti_join(spark):
    df = spark.createDataFrame([(i, f"line {i}\nshared") for i in range(6)], "doc_id long, text string")
    runs = lines.LineRuns(spark, fanout=2)
    for i in range(4):
        runs.add(lines.hashed_lines(df.filter(F.col("doc_id") == i)))
    assert [len(x) for x in runs.levels] == [0, 0, 1] and runs.common(4).count() == 1
    assert runs.unseen(lines.hashed_lines(df.filter("doc_id = 5"))).count() == 1
    repeated = df.filter("doc_id = 0").union(df.filter("doc_id = 0"))
    one = lines.LineRuns(spark)
    one.add(lines.hashed_lines(repeated))
    assert one.common(2).count() == 2  # every row is a document
    # keys stand in one run only, whatever was added before
    two = lines.LineRuns(spark, fanout=9)
    for i in range(3):
        two.add(lines.hashed_lines(df.filter(F.col("doc_id") == i)))
    keys = [{(r.h1, r.h2) for r in run.collect()} for _, run in two.runs()]
    assert [len(k) for k in keys] == [2, 1, 1] and len(set.union(*keys)) == 4 and two.common(3).count() == 1


def test_urls(spark):
    pages = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/de/"), (3, "http://w.example.com/de/a"), (4, "x://b.org/fr/y#z"), (5, None), (6, "nonsense"),
        (7, "http://bad.org/1"), (8, "http://bad.org/2"), (9, "http://bad.org/3"), (10, "http://fine.org/"), (11, "http://net/"), (12, "http://xnet/"), (1, "http://A.Example.NET/en/x?q"),
    ]
    df = spark.createDataFrame([(*p, "h", "r") for p in pages], "page_id long, url string, html string, rule string")
    outcome = [(7, 1), (8, 1), (9, 1), (10, 0), (4, 0), (3, 0), (None, 1), (2, None)]
    out = urls.filter_urls(df.drop("rule"), spark.createDataFrame(outcome, "page_id long, bad int"), max_bad=0.45, z=0.5).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(pages) and got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][2] == "net/" and got[12][2] is None
    none = urls.filter_urls(df, spark.createDataFrame([], "page_id long, bad int"))
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}
    assert urls.filter_urls(df.limit(0), spark.createDataFrame(outcome, "page_id long, bad int")).count() == 0


def base_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_secrets_against_re(spark):
    key = "zQ8kd93hfkA02mfkq71xPbc9"
    texts = [
        None, "", "password=abcdefgh é token: 'short' secret: token: abcdefgh12", "AKIA" + "B2" * 8 + " AKIAX", "deadbeef" * 4 + "ff é " + "a" * 31, f"é {key} end", f"{key} and {key}",
        "API_KEY = \"abcd1234efgh\"" * 3, "pass" * 9000,
    ]
    shared = "sharedTokenSharedToken0123456"
    rows = [(i, t, f"s{i % 3}", "r", "v", 1) for i, t in enumerate([*texts, shared, shared, shared])]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, repo string, value string, start int")
    got = [r for r in secrets.digests(secrets.scan_secrets(df, "source", "repo")).collect()]
    assert len(got) == len(rows) + 1
    for r in got:
        want = base_spans(rows[r.doc_id][1])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in want).encode()).hexdigest()
    by = {r.doc_id: r.spans for r in got}
    assert by[6] == "live:0:24,live:29:53" or by[6] == "" and by[5] == ""
    assert by[9] == by[10] == by[11] == ""
    assert secrets.scan_secrets(df.limit(0), "source", "repo").count() == 0


def test_language_network(spark):
    words = {"xx": "foo bar baz qux".split(), "yy": "ñandú señor año niño".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 30)), k, "z") for i, k in enumerate(["xx", "yy"] * 90)]
    rows += [(1000, None, "xx", "z"), (1001, "123 !?", "yy", "z"), (1002, "", None, "z"), (1003, "foo bar " * 9000, None, "z"), (None, "baz qux foo", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [(i, k) for i, _, k, _ in rows[:180] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.95 * len(held) and all(got[i].held_out for i, _ in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"] and got[1000].score == 0 and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"} and langid.identify(df.limit(0)).count() == 0


def test_network_gradient_and_reader():
    net = langid.Network(["a", "b", "c"])
    data, label = np.random.default_rng(3).integers(0, 256, (4, 9)), np.array([0, 1, 2, 1])
    _, g = net.loss(data, label)
    for k in net.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = net.p[k][i], 1e-5
        net.p[k][i] = old + e
        up, _ = net.loss(data, label)
        net.p[k][i] = old - e
        down, _ = net.loss(data, label)
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), rel=1e-4)
    q = langid.Reader(net.p).probabilities(data.T.astype(np.intp))
    value = -np.log([[q[t, label[b], b] for t in range(9)] for b in range(4)]).mean()
    assert value == pytest.approx(net.loss(data, label)[0], rel=1e-4)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 16))
    vec = [(base[i % 8] + rng.normal(size=16) * 0.12).tolist() for i in range(60)]
    vec += [vec[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0] * 16, [1.0] * 8]
    label = [i % 2 for i in range(60)] + [0] + [1] * 8
    label[3] = None
    df = spark.createDataFrame([(i, v, k, 5) for i, (v, k) in enumerate(zip(vec, label, strict=True))], "vec_id long, embedding array<double>, label int, n_links long")
    ok = [i for i, v in enumerate(vec) if v and label[i] is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    links = [(i, j) for i, j in itertools.combinations(ok, 2) if label[i] == label[j] and len(vec[i]) == len(vec[j]) and cos(vec[i], vec[j]) >= 0.93]
    low = reach(len(vec), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert links and got == {i: (sum(i in p for p in links), low[i], low[i] == i) for i in range(len(vec))}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_tiles_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MOST_BLOCK", 16)
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(20, 8)), 5, axis=0) + rng.normal(size=(100, 8)) * 0.15
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()} == {i: int(near[i].sum()) - 1 for i in range(100)}


def test_quantisation_bound():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(200, 48))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, f = vectors.quantised(u)
    near = vectors.products(q, q) * s[:, None] * s[None]
    assert (np.abs(near - u @ u.T) <= f[:, None] + (1 + f[:, None]) * f[None]).all()


def test_chat_quotes(spark):
    rows = [
        (1, 0, "user", "Please explain the tides"), (1, 1, "assistant", "> please   EXPLAIN the tides\nThe moon pulls water."), (1, 2, "user", "And the sun as well?"),
        (1, 3, "assistant", ">> Please explain the tides\n> The moon pulls water.\nYes."), (2, 0, "user", "> the MOON pulls water.\nIs it so?"), (2, 1, "user", None), (3, 5, "user", ""),
        (None, 0, "user", "> The moon pulls water."), (1, 2, "user", "And the sun as well?"),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth long")
    out = chat.link_quotes(df).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows) and got[1, 1].text == "The moon pulls water." and (got[1, 1].parent_turn, got[1, 1].depth) == (0, 1)
    assert got[1, 3].parent_turn == 1 and got[1, 3].depth == 2 and got[1, 3].max_level == 2 and got[1, 3].n_linked == 2
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].depth) == (1, 1, 0) and got[2, 1].parent_turn == 0 and got[3, 5].parent_turn is None
    assert got[None, 0].parent_conv is None and chat.link_quotes(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows[:-1])
    rel = con.sql(chat.oracle())
    want = {tuple(r[rel.columns.index(c)] for c in ("conv_id", "turn", "n_linked", "parent_conv", "parent_turn", "depth")) for r in rel.fetchall()}
    assert want == {(r.conv_id, r.turn, r.n_linked, r.parent_conv, r.parent_turn, r.depth) for r in out}


def test_chat_links_short_lines_of_the_own_conversation(spark):
    rows = [
        (1, 0, "user", "Why?"), (1, 1, "assistant", "Yes."), (1, 2, "user", "> Why?\nGo on."), (1, 3, "assistant", ">\n> \n好的好的好的。"),
        (1, 4, "user", "No matter"), (1, 5, "assistant", "> 好的好的好的。"), (2, 0, "user", "> Why?\nWell?"), (2, 1, "user", "> NO  matter"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_conv, r.parent_turn, r.depth) for r in chat.link_quotes(df, least=8).collect()}
    assert got[1, 2] == (1, 1, 0, 1) and got[1, 5] == (1, 1, 3, 3) and got[1, 3] == (0, 1, 2, 2)
    assert got[2, 0] == (0, None, None, 0) and got[2, 1] == (1, 1, 4, 1)
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_conv, r.parent_turn, r.depth) for r in chat.link_quotes(df).collect()}  # by default lines of any length link
    assert got[2, 0] == (1, 1, 0, 0) and got[1, 2] == (1, 1, 0, 1)


def test_chat_links_past_the_quoting_conversation(spark):
    line = "The moon pulls water."
    rows = [
        (1, 0, "user", f"> {line}\nIs it so?"), (1, 1, "assistant", line), (1, 2, "user", f"> {line}"), (7, 3, "user", line), (8, 0, "user", line),
        (9, 0, "user", f"> {line}\n{line}"), (1, 5, "user", "> only once here"), (1, 6, "user", "only once here"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.to_conv, r.to_turn) for r in chat.quote_links(df).collect()}
    assert got == {(1, 0): (7, 3), (1, 2): (1, 1), (9, 0): (1, 1)}


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 3, b"\xff" * 130, "é日🙂".encode() * 900])
def test_media_round_trip(raw):
    payload = media.pad(raw)
    avi = media.write_avi(payload)
    blocks, n = media.read_avi(avi)
    assert n == len(payload) and n % 64 == 0 and blocks.tobytes()[:n] == payload and avi[:4] == b"RIFF"
    assert [c[0] for c in media.clips(blocks)][0] == 0 and sum(c[2] for c in media.clips(blocks)) == len(blocks) // media.PER_FRAME


def test_media_rows_and_luma(spark, docs):
    rows = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert rows[i].tail_crc32 == zlib.crc32(p[-64:])
    assert rows[0].feature == rows[1].feature and media.media_digests(docs.limit(0)).count() == 0 and media.clip_rows(docs).count() >= len(TEXTS)
    block = np.zeros((1, 64), np.uint8)
    c = np.where(block < 128, -255.0, 0.0) + block
    want = [[128 + sum(c[0, k] * media._basis()[z // 8, y] * media._basis()[z % 8, x] for k, z in enumerate(media.ZIGZAG)) for x in range(8)] for y in range(8)]
    assert np.abs(media.luma(block).reshape(8, 8).astype(float) - np.clip(np.rint(want), 0, 255)).max() <= 1
    assert media.shots(np.array([[9, 0], [9, 0], [0, 9], [0, 9]]) * 300) == [0, 2]


def test_mixing(spark, docs):
    out = mixing.mix(docs.drop("kept")).collect()
    assert len(out) == len(TEXTS) and {r.doc_id: r.n_tokens for r in out} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
    assert all(0 <= r.p <= 1 for r in out) and mixing.mix(docs.drop("kept").limit(0)).count() == 0
    rows = [(i, "word " * 20, "ab"[i % 4 == 0], ["x", "y"][i % 3 == 0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = {"source": {"x": 0.5, "y": 0.5}, "lang": {"a": 0.5, "b": 0.5}, "topic": 1.0}
    got = mixing.mix(df, t, budget=0.4).filter("kept")
    n = got.count()
    share = {c: got.filter(c).count() / n for c in ("source = 'x'", "lang = 'a'")}
    assert all(abs(x - 0.5) < 0.06 for x in share.values()) and abs(n / 2000 - 0.4) < 0.05


def fitted(tok, ix, shares):
    """Weights of the form tok * exp(sum of one term per value) that meet the shares, by Newton's method on the terms."""
    at = np.concatenate([np.eye(len(s))[i] for i, s in zip(ix, shares, strict=True)], axis=1)
    want, u = np.concatenate(shares), np.zeros(at.shape[1])
    value = lambda u: (tok / tok.sum() * np.exp(at @ u)).sum() - want @ u
    for _ in range(200):
        w = tok / tok.sum() * np.exp(at @ u)
        g = at.T @ w - want
        if np.abs(g).max() < 1e-13:
            break
        step, size = np.linalg.lstsq(at.T @ (at * w[:, None]), -g, rcond=1e-12)[0], 1.0
        while value(u + size * step) > value(u) + 1e-4 * size * (g @ step) and size > 1e-6:
            size /= 2
        u = u + size * step
    return tok / tok.sum() * np.exp(at @ u)


def test_mixing_meets_associated_marginals(spark):
    """Every source is nearly of one language: a few rounds of raking don't meet the sources' targets."""
    n = {(s, l): 200 * (s + 1) ** 2 if s == l else 2 for s in range(4) for l in range(4)}
    rows = [("word " * 10, f"l{l}", f"s{s}") for (s, l), k in n.items() for _ in range(k)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    targets = {"source": {f"s{s}": 0.25 for s in range(4)}, "lang": {f"l{l}": x for l, x in enumerate((0.3, 0.2, 0.4, 0.1))}, "topic": 1.0}
    got = {(r.source, r.lang): (r.rate, r.p) for r in mixing.mix(df, targets, budget=0.5).select("source", "lang", "rate", "p").distinct().collect()}
    tok = np.array([10.0 * k for k in n.values()])
    ix = [np.array([s for s, _ in n]), np.array([l for _, l in n])]
    w = fitted(tok, ix, [np.full(4, 0.25), np.array([0.3, 0.2, 0.4, 0.1])])
    rate = w * tok.sum() / tok
    have = np.array([got[f"s{s}", f"l{l}"][0] for s, l in n])
    assert have == pytest.approx(rate, rel=2e-5, abs=1e-6)  # rates have six decimals
    assert np.bincount(ix[0], have * tok) / tok.sum() == pytest.approx(np.full(4, 0.25), rel=1e-5)


def test_mixing_cap_until_no_further_cell(spark):
    """Each pass lifts c so that one more cell reaches 1: the budget is met only after all of them."""
    rate = [2.0**k for k in range(10)]
    rows = [(f"s{k}", "l", "prose", 1000, r / sum(rate)) for k, r in enumerate(rate)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tok long, w double")
    p = {r.source: r.p for r in mixing.cell_probabilities(Workspace(spark), cells, 0.9).collect()}
    assert sum(p.values()) == pytest.approx(9, rel=1e-9) and sum(x == 1 for x in p.values()) == 8


def test_mixing_reports_targets_that_cannot_be_met(spark):
    rows = [(i, "word " * 10, "ab"[i % 2], "xy"[i % 2]) for i in range(20)]  # x is always a, y always b
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(RuntimeWarning, match="off its target"):
        assert mixing.mix(df, {"source": {"x": 0.5, "y": 0.5}, "lang": {"a": 0.9, "b": 0.1}, "topic": 1.0}).count() == 20
