"""Repeated rows, ties, very long texts and clashing names, against the SQL and brute force."""

import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, langid, lines, media, mixing, queries, secrets, urls
from quillon.llm.common import free_name

KINDS = {"doc_id": "bigint", "page_id": "bigint", "conv_id": "bigint", "turn": "bigint"}


def sql(statement, **tables):
    """Rows of a DuckDB statement over tables given as (columns, rows)."""
    con = duckdb.connect()
    for name, (cols, rows) in tables.items():
        ddl = ", ".join(f"{c} {KINDS.get(c, 'varchar')}" for c in cols)
        con.sql(f"create table {name} ({ddl})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(cols))})", rows)
    rel = con.sql(statement)
    return sorted((tuple(map(str, (r[rel.columns.index(c)] for c in sorted(rel.columns)))) for r in rel.fetchall()))


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Puts tables where the registered queries look for them."""
    root = tmp_path_factory.mktemp("tables")

    def put(**tables):
        for name, (cols, rows) in tables.items():
            ddl = ", ".join(f"{c} {'long' if c in KINDS else 'string'}" for c in cols)
            spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        return str(root)

    return put


def same_as_sql(spark, folder, name, **tables):
    got = rows_of(queries.queries()[name](spark, folder(**tables)))
    assert got == sql(queries.oracle_sql()[name], **tables)
    return got


def test_free_name():
    assert free_name("kept", ["a", "Kept", "_kept"]) == "__kept" and free_name("p", []) == "p"


def test_repeated_rows_count_as_documents(spark, folder):
    rows = [(1, "Hello\nown line"), *[(1, "hello")] * 12, (None, "hello\n\nx"), (2, None), (2, ""), (3, "a\na\na"), (4, " HELLO \t")]
    got = same_as_sql(spark, folder, "op2_line_dedup", documents=(["doc_id", "text"], rows))
    assert sum(r[2] == "1" for r in got) == 15


def test_line_counts_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "same\n" + str(i), 5, "c", 9) for i in range(3)], "doc_id long, text string, n_lines long, r1 string, N_dropped int")
    out = lines.drop_common_lines(df, min_docs=3)
    assert out.columns == ["doc_id", "n_lines", "r1", "N_dropped", "text", "_n_lines", "_n_dropped"]
    assert {(r.n_lines, r.r1, r._n_lines, r._n_dropped) for r in out.collect()} == {(5, "c", 2, 1)}


def test_one_very_long_line(spark):
    df = spark.createDataFrame([(1, "x" * 1_000_000 + "\nshared"), (2, "shared\n" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in lines.drop_common_lines(df, min_docs=2).collect()}
    assert got == {1: (2, 1, 1_000_000), 2: (50_001, 50_000, 0)}


def test_domains_and_suffixes(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "x.y.co.uk", "co.uk", "a..b", "h" * 200_000 + ".org", "q." * 30_000 + "net", "gov.x1"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    began = time.time()
    got = [(r[0], r[1]) for r in df.select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()]
    assert time.time() - began < 20
    assert got[:7] == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", ""), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), (".b", "b")]
    assert got[7] == (hosts[7], "org") and got[8] == ("q.net", "net") and got[9] == ("gov.x1", "x1")


def test_reputation_changes_verdicts(spark, folder):
    fine, bad = "<p>" + "plain words " * 30, "<p>" + "*** %%% words " * 30
    rows = [(i, f"http://junk.example.org/{i}", bad) for i in range(30)] + [(100 + i, f"http://good.example.org/{i}", fine) for i in range(30)]
    rows += [(200, "http://junk.example.org/fr/1", fine), (201, "http://new.example.org/", None), (202, None, bad), (7, "http://junk.example.org/7", bad), (None, "http://x.com", fine)]
    rows += [(203, "http://" + "l" * 1_000_000 + ".com/" + "p" * 1_000_000, "short")]
    got = same_as_sql(spark, folder, "op3_url_filter", pages=(["page_id", "url", "html"], rows))
    by_host = {r[0]: r[-1] for r in got if r[3] == "None"}  # host and verdict where no rule decides
    assert by_host["junk.example.org"] == "block" and by_host["good.example.org"] == "allow"


def test_many_matches_in_one_text(spark):
    key = "aB3dE6gH9jK2mN5pQ8sT1vW4x"  # a token of few different characters is none
    text = " ".join(f"token={i:08d}" if i % 2 else f"{key}{i}" for i in range(20_000))
    began = time.time()
    df = spark.createDataFrame([(1, text, "s", "r"), (1, text, "s", "r"), (2, None, None, None)], "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secrets.digests(secrets.scan_secrets(df, "owner", "repo")).collect()}
    assert (got[1].n_assign, got[1].n_live, got[1].spans.count("live:")) == (10_000, 10_000, 10_000) and got[2].spans == "" and time.time() - began < 90


def test_secrets_of_owners_against_sql(spark, folder):
    own, copied = "password=ownvalue99", "password=copied9999"
    rows = [(i, f"{copied} and {own if i == 3 else ''} {'Zz9' * 9 if i < 2 else ''}", f"s{i}") for i in range(5)] + [(3, f"{copied} and {own} ", "s3"), (9, None, None)]
    rows += [(10, "AKIA" + "B2" * 8 + " é " + "ab" * 20 + ("Q1" * 15), "s9")]
    got = same_as_sql(spark, folder, "op4_secret_scan", documents=(["doc_id", "text", "source", "lang"], [(*r, "en") for r in rows]))
    assert {r[6] for r in got if r[1] == "3"} == {"1"}  # n_live


def test_many_marks_and_long_lines(spark):
    rows = [(1, 0, "u", "x" * 1_000_000), (1, 1, "a", "> " * 20_000 + "deep"), (1, 2, "u", " \t" * 200_000 + "> " + "x" * 1_000_000), (1, 3, "a", ">" * 300_000)]
    got = {r.turn: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].max_level == 20_000 and got[2].parent_turn == 0 and got[3].max_level == 300_000 and got[3].text == ""


def depth_first(up):
    """(depth, place) of every turn by a plain walk."""
    below = {}
    for t in sorted(up):
        below.setdefault(up[t], []).append(t)
    out = {}

    def walk(t, depth):
        out[t] = (depth, len(out))
        for c in below.get(t, []):
            walk(c, depth + 1)

    for t in below.get(None, []):
        walk(t, 0)
    return out


def test_reply_order(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for conv in range(6):
        up, said = {}, {}
        for t in range(1, 25):
            if rng.random() < 0.1:
                continue
            said[t] = f"message {conv} {t} {rng.integers(99999)}"
            older = [x for x in said if x < t]
            quoted = int(rng.choice(older)) if older and rng.random() < 0.6 else None
            up[t] = quoted if quoted is not None else t - 1 if t - 1 in said else None
            rows.append((conv, t, "u", (f"> {said[quoted]}\n" if quoted is not None else "") + said[t]))
        want |= {(conv, t): x for t, x in depth_first(up).items()}
    out = chat.link_quotes(spark.createDataFrame([*rows, rows[3]], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.depth, r.reply_pos) for r in out} == want and len(out) == len(rows) + 1
    first = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("conv_id = 0").collect()
    assert [r.reply_pos for r in first] == list(range(len(first))) and not any(">" in r.text for r in first)


def test_chat_against_sql(spark, folder):
    rows = [(1, 0, "u", "The first line of all"), (1, 1, "a", "> the FIRST line of all\nAn answer to it"), (1, 2, "u", "> The first line of all\nAnother answer"), (1, 3, "a", ">> the first line of all\n> An answer to it\nLast")]
    rows += [(2, 5, "u", "> An answer to it\nElsewhere"), (1, 1, "a", "> the FIRST line of all\nAn answer to it"), (None, 1, "u", "> x"), (3, None, "u", None), (2, 6, "u", "An answer to it")]
    got = same_as_sql(spark, folder, "op8_chat_quotes", conversations=(["conv_id", "turn", "role", "text"], rows))
    assert len(got) == len(rows)


def test_mixing_names_ties_and_sql(spark, folder):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[20 * (i % 3) : 20 * (i % 3) + 20], 12)), ["en", "fr", None][int(rng.integers(3))], f"s{int(rng.integers(4))}") for i in range(300)]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3])] * 3 + [(900, None, None, None), (901, "", "en", "s0"), (902, "word " * 200_000, "en", "s1"), (None, "w1 w2", "fr", "s2")]
    got = same_as_sql(spark, folder, "op10_mixing", documents=(["doc_id", "text", "lang", "source"], rows))
    assert len({r[-1] for r in got}) > 1
    df = spark.createDataFrame([(*r, 7, "t", 0.5) for r in rows], "doc_id long, text string, lang string, source string, kept int, Topic string, p double")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "n_tokens", "_topic", "rate", "_p", "_kept"] and out.filter("kept = 7 and Topic = 't'").count() == len(rows)


def test_raking_is_the_same_either_way(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 30)), "ab"[i % 2], f"s{int(rng.integers(4))}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = rows_of(mixing.mix(df))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert rows_of(mixing.mix(df)) == one


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 2)
    monkeypatch.setattr(langid, "SAMPLE", 80)
    rows = [(i, f"text of language {i % 70}", f"l{i % 70:02d}") for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df)
    assert {lang for lang, _ in got} == {f"l{k:02d}" for k in range(70)} and len(got) <= 2 * 70 * langid.LEAST_ROWS
    assert len(langid.trained(df).langs) == 70


def code_bits(symbols, length):
    return {s: format(i, f"0{length}b") for i, s in enumerate(symbols)}


def magnitude(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def test_baseline_images_of_other_writers():
    """Two components with sampling 2 x 1, run lengths, restart intervals, a quantiser and stuffed bytes."""
    rng = np.random.default_rng(2)
    blocks = [np.where(rng.random((1, n, 64)) < 0.2, rng.integers(-300, 300, (1, n, 64)), 0) for n in (4, 2)]
    blocks[0][0, 0, 1:] = 0
    blocks[0][0, 1, 40] = 5
    blocks[0][0, 1, 1:40] = 0
    dc, ac = code_bits(range(12), 4), code_bits([0, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]], 8)
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    table = lambda k, codes, n: bytes([k]) + bytes([len(codes) if i == n else 0 for i in range(1, 17)]) + bytes(codes)
    head = b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(range(1, 65))) + segment(0xC0, struct.pack(">BHHB", 8, 8, 32, 2) + b"\x01\x21\x00\x02\x11\x00")
    head += segment(0xC4, table(0, dc, 4)) + segment(0xC4, table(0x10, ac, 8)) + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, b"\x02\x01\x00\x02\x00\x00\x3f\x00")
    scan = b""
    for mcu in range(2):
        bits, last = "", [0, 0]
        for part, places in ((0, (2 * mcu, 2 * mcu + 1)), (1, (mcu,))):
            for p in places:
                b = blocks[part][0, p]
                size, more = magnitude(int(b[0]) - last[part])
                last[part] = int(b[0])
                bits += dc[size] + more
                run = 0
                end = max([0, *np.flatnonzero(b[1:]) + 1])
                for v in b[1 : end + 1].tolist():
                    if not v:
                        run += 1
                        continue
                    bits += ac[0xF0] * (run // 16)
                    size, more = magnitude(v)
                    bits += ac[run % 16 << 4 | size] + more
                    run = 0
                bits += ac[0] if end < 63 else ""
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (b"\xff\xd0" if mcu == 0 else b"\xff\xd9")
    image = head + scan
    j = media.parse_jpeg(image)
    assert (j.width, j.height, j.restart, j.parts) == (32, 8, 1, [(1, 2, 1, 0), (2, 1, 1, 0)])
    got = media.decode_scan(image, j)
    assert (got[0] == blocks[0]).all() and (got[1] == blocks[1]).all()
    want = np.clip(np.rint((blocks[0][0, 0] * np.arange(1, 65)).astype(np.float32) @ media._TRANSFORM + 128), 0, 255).reshape(8, 8)
    assert np.abs(media.decode_luma(image)[:, :8].astype(int) - want).max() <= 1
    for broken in (image.replace(b"\xff\xc0", b"\xff\xc2"), image[: len(head) + 3], b"no image", head[:40]):
        with pytest.raises((ValueError, IndexError)):
            media.decode_scan(broken, media.parse_jpeg(broken))


def test_movies_of_this_writer_are_read_from_the_file_alone():
    payload = media.pad(bytes(range(256)) * 40)
    avi = media.write_avi(payload)
    blocks, _ = media.read_avi(avi)
    assert media.movie_clips(avi) == media.clips(blocks)
    images, length, per_frame = media.images_of(avi)
    assert length == len(payload) and per_frame == 40_000 and len(images) == len(blocks) // media.PER_FRAME
    j = media.parse_jpeg(images[0])
    c = media.decode_scan(images[0], j)[0].reshape(-1, 64)
    assert (np.where(c < 0, c + 255, c) == media.decode_coefficients(images[0])).all()
