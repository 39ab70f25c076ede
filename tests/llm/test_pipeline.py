"""The pipeline against a brute-force version of all five stages, and registration."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as cp
from quillon.llm import langid, mixing, ngram_join, queries

tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that is was for with as his on be at by".split(), "fr": "çà été où là élève même très déjà après être fenêtre garçon".split()}


def corpus():
    rng = np.random.default_rng(12)
    rows = []
    for i in range(90):
        lang = ["en", "fr"][i % 3 == 0]
        body = [" ".join(rng.choice(WORDS[lang], 14)) for _ in range(int(rng.integers(1, 5)))]
        if i % 5 == 0:
            body.append("Shared line of many documents")
        rows.append([i, "\n".join(body), lang, f"s{i % 4}"])
    for i in range(4):  # near and exact copies of long texts
        long = " ".join(rng.choice(WORDS["en"], 80))
        rows += [[100 + 3 * i, long, "en", "s0"], [101 + 3 * i, long + " more", "en", "s1"], [102 + 3 * i, long, None, "s2"]]
    rows += [[200, None, "en", "s0"], [201, "", "fr", "s1"], [202, "123 456", None, None], [7, rows[7][1], rows[7][2], rows[7][3]], [8, "quite another text of the same number and id", "en", "s3"]]
    return [(*r, len(r[1] or "")) for r in rows]


def language_by_hand(rows, net):
    """The network position by position, over segments as the reader cuts them."""
    p, h = net.p, langid.HIDDEN
    sig = lambda a: 1 / (1 + np.exp(-a))

    def states(x, d):
        s, out = np.zeros(h), []
        for b in x if d == 0 else x[::-1]:
            gx, gu = p["x"][d][b], s @ p["u"][d]
            z, r = sig(gx[:h] + gu[:h]), sig(gx[h : 2 * h] + gu[h : 2 * h])
            c = np.tanh(gx[2 * h :] + r * gu[2 * h :])
            s = c + z * (s - c)
            out.append(s)
        return np.array(out if d == 0 else out[::-1])

    kept = []
    for r in rows:
        text = r[1] or ""
        if not any(map(str.isalpha, text)):
            continue
        raw, total = text.encode(), np.zeros(len(net.langs))
        for at in range(0, len(raw), langid.SEGMENT):
            x = list(raw[at : at + langid.SEGMENT])
            q = np.concatenate([states(x, 0), states(x, 1)], 1) @ p["out"] + p["bias"]
            q = np.exp(q - q.max(1, keepdims=True))
            total += (q / q.sum(1, keepdims=True)).sum(0)
        kept.append((r, net.langs[total.argmax()], total.max() / len(raw)))
    return kept


def lines_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    out = []
    for r in rows:
        text = "\n".join(x for x in (r[1] or "").split("\n") if held.get(key(x), 0) < 10)
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def near_by_hand(rows):
    sets = []
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = [r[0] for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    out, seen = [], set()
    for r, c in zip(rows, low, strict=True):
        if r[0] == c and r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


def mixed_by_hand(rows):
    quantile = lambda v, q: sorted(v)[int(np.ceil(q * len(v))) - 1]
    words = [r[1].split() for r in rows]
    measures = []
    for r, w in zip(rows, words, strict=True):
        n, k = len(r[1]), len(w)
        row = [sum(c in chars for c in r[1]) * 1000 // n if n else 0 for chars in mixing.COUNTED.values()]
        measures.append([*row, min(1000, n * 10 // k) if k else 0, len(set(w)) * 1000 // k if k else 0])
    masks = [0] * len(rows)
    for i in range(len(mixing.MEASURES)):
        for j, q in enumerate(mixing.CUTS):
            cut = quantile([m[i] for m in measures], q)
            masks = [x | (m[i] > cut) << (2 * i + j) for x, m in zip(masks, measures, strict=True)]
    count = {m: masks.count(m) for m in masks}
    centres = sorted(count, key=lambda m: (-count[m], m))[: mixing.TOPICS]
    near = lambda m: min(range(len(centres)), key=lambda k: ((m ^ centres[k]).bit_count(), k))
    for _ in range(mixing.STEPS):
        of = [near(m) for m in masks]
        centres = [sum(1 << b for b in range(12) if 2 * sum(m >> b & 1 for m, o in zip(masks, of, strict=True) if o == k) > of.count(k)) if k in of else c for k, c in enumerate(centres)]
    cell = [(r[3] or mixing.NONE, r[2] or mixing.NONE, f"t{near(m)}") for r, m in zip(rows, masks, strict=True)]
    tok = {}
    for c, w in zip(cell, words, strict=True):
        tok[c] = tok.get(c, 0) + len(w)
    tok = {c: t for c, t in tok.items() if t}
    w, total = {c: float(t) for c, t in tok.items()}, sum(tok.values())
    share = []
    for d, name in enumerate(mixing.DIMS):
        nat = {}
        for c, t in tok.items():
            nat[c[d]] = nat.get(c[d], 0) + t
        x = {v: t ** mixing.TARGETS[name] for v, t in nat.items()}
        share.append({v: y / sum(x.values()) for v, y in x.items()})
    for _ in range(600):
        for d in range(3):
            now = {}
            for c, v in w.items():
                now[c[d]] = now.get(c[d], 0) + v
            w = {c: v * share[d][c[d]] / now[c[d]] for c, v in w.items()}
    rate = {c: w[c] * total / t for c, t in tok.items()}
    c, at_cap = cp.BUDGET, -1
    while True:
        full = [k for k in tok if c * rate[k] >= 1]
        rest = sum(tok[k] * rate[k] for k in tok if c * rate[k] < 1)
        if len(full) == at_cap or not rest:
            break
        at_cap, c = len(full), max(c, (cp.BUDGET * total - sum(tok[k] for k in full)) / rest)
    draw = lambda i: int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:8], 16) / 2**32
    p = [min(1.0, c * rate.get(k, 0)) for k in cell]
    return [r for r, x in zip(rows, p, strict=True) if draw(r[0]) < x], [abs(draw(r[0]) - x) for r, x in zip(rows, p, strict=True)]


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()}
    net = langid.trained(spark.read.parquet(str(tmp_path / "documents.parquet")))
    judged = language_by_hand(rows, net)
    one = [r for r, _, score in judged if score >= cp.LEAST_SCORE]
    assert all(abs(score - cp.LEAST_SCORE) > 1e-3 for _, _, score in judged)
    three = near_by_hand(lines_by_hand(one))
    four, margin = mixed_by_hand(three)
    assert min(margin) > 1e-6 and 0 < len(four) < len(three) < len(one) < len(rows)
    coder = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for r in four:
        ids = coder.encode_ordinary(r[1])
        want[r[0]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
    assert got == want


def test_extra_and_clashing_columns(spark):
    """All stages but the last return the columns of their input, whatever these are called."""
    extra = {"n_lines": "long", "kept": "int", "Topic": "string", "r1": "string", "c0": "double", "lang_pred": "string", "component_id": "long"}
    docs = spark.createDataFrame(corpus(), COLUMNS)
    docs = docs.withColumns({c: F.lit(7).cast(t) for c, t in extra.items()}).select(*extra, *docs.columns)
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["kept"] == 7 and r["r1"] == "7" and r["component_id"] == 7 for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    assert cp.tokens(spark, docs, "").count() == len(got)


def test_rows_of_one_id(spark):
    """Equal rows become one; rows of one id with other texts are documents of their own."""
    rows = [(1, "one text of five words and more", "en", "a", 1), (1, "one text of five words and more", "fr", "b", 1), (1, "something else that is said here instead", "en", "a", 1), (None, "x y", None, None, 1), (None, "x y", None, None, 1)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(r.text for r in got) == sorted([rows[0][1], rows[2][1], "x y", "x y"])


def test_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    held = {r[1] for r in corpus() if r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    free = {r[1] for r in corpus() if r[1] and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    parts = {part for _, part in langid.sample(docs)}
    assert parts and all(any(p in t for t in free) for p in parts) and not any(p in held - free for p in parts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries()) and ngram_join.oracle()
