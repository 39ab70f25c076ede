"""Byte-level BPE encoding and decoding over arrays.

Pre-tokenisation uses no regex.  Every code point gets a class; white space also
says whether it is the last before other text, and an apostrophe whether a
contraction follows.  Each class is a transition function on eight states, and
the states before all positions come from an associative scan of function
composition: rows of ``WIDTH`` positions are composed side by side, the row
functions are scanned the same way, and a last pass runs each row from its entry
state.  A position starts a piece where (state, class) says so.  A document's
first position has a constant function, so many documents are scanned at once.

Pieces are looked up in a cache per Python worker (cleared at ``MOST_CACHED``).
New pieces are merged together: all pieces of a chunk, one merge of lowest rank
each per step; long ones by a heap.  The pair table follows from the ranks alone.

Cases: a null text is empty and has no ids; texts of any length are encoded
whole; special tokens don't exist; equal texts give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back

WIDTH = 64
CHUNK_BYTES = 250_000
MOST_CACHED = 300_000
LONG_PIECE = 24

LETTER, NUMBER, OTHER, AP1, AP2, SPACE, SPACE_LAST, WHITE, WHITE_LAST = range(9)
EDGE, IN_L, IN_N, IN_O, PREFIX, IN_W, ONE_LEFT, TWO_LEFT = range(8)
# Code points of white space; letters after an apostrophe.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
AFTER_ONE, AFTER_TWO = "stmd", ("re", "ve", "ll")


def _rule(state: int, cls: int) -> tuple[int, bool]:
    """The state after a character of class ``cls``, and whether the character starts a piece."""
    if cls == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return state - 1 if state == TWO_LEFT else EDGE, False
        return IN_L, state not in (IN_L, PREFIX)
    if cls == NUMBER:
        return IN_N, state not in (IN_N, PREFIX)
    if cls in (OTHER, AP1, AP2):
        if state in (IN_O, PREFIX):
            return IN_O, False
        return {OTHER: IN_O, AP1: ONE_LEFT, AP2: TWO_LEFT}[cls], True
    if cls == SPACE_LAST:
        return PREFIX, True
    if cls == WHITE_LAST:
        return EDGE, True
    return IN_W, state != IN_W


#: Row: class, plus 9 at a document's first position.  Column: state.
NEXT = np.array([[_rule(s if c < 9 else EDGE, c % 9)[0] for s in range(8)] for c in range(18)], np.uint8)
STARTS = np.array([[_rule(s if c < 9 else EDGE, c % 9)[1] or c >= 9 for s in range(8)] for c in range(18)], bool)


def _class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = WHITE
    return table


_CLASSES: list[np.ndarray] = []


def classes(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of every code point; first: positions of the documents' first code points."""
    if not _CLASSES:
        _CLASSES.append(_class_table())
    c = _CLASSES[0][cp]
    n = len(cp)
    start = np.zeros(n + 2, bool)
    start[first] = True
    start[n:] = True
    white = c == WHITE
    ahead = np.zeros(n, bool)  # other text of the same document follows
    ahead[:-1] = ~white[1:]
    ahead &= ~start[1 : n + 1]
    c = np.where(white, np.where(cp == 32, SPACE, WHITE) + ahead, c).astype(np.uint8)
    ap = np.flatnonzero(cp == 39)
    if len(ap):
        wide = np.concatenate((cp, np.zeros(2, cp.dtype)))
        n1 = np.where(start[ap + 1], 0, wide[ap + 1])
        n2 = np.where((n1 == 0) | start[np.minimum(ap + 2, n + 1)], 0, wide[np.minimum(ap + 2, n + 1)])
        one = np.isin(n1, [ord(x) for x in AFTER_ONE])
        two = np.zeros(len(ap), bool)
        for a, b in AFTER_TWO:
            two |= (n1 == ord(a)) & (n2 == ord(b))
        c[ap[one]] = AP1
        c[ap[two]] = AP2
    c[first] += 9
    return c


def scan(c: np.ndarray) -> np.ndarray:
    """The state before every position, by composing transition functions."""
    n = len(c)
    if n <= 4 * WIDTH:
        out, s = np.empty(n, np.uint8), EDGE
        for i, x in enumerate(c.tolist()):
            out[i] = s
            s = int(NEXT[x, s])
        return out
    rows = -(-n // WIDTH)
    grid = np.zeros(rows * WIDTH, np.uint8)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    flat = NEXT.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(WIDTH):
        f = flat[(grid[j].astype(np.intp) * 8)[:, None] + f]
    entry = scan_functions(f)
    out = np.empty((WIDTH, rows), np.uint8)
    s = entry
    for j in range(WIDTH):
        out[j] = s
        s = flat[grid[j].astype(np.intp) * 8 + s]
    return out.T.reshape(-1)[:n]


def scan_functions(f: np.ndarray) -> np.ndarray:
    """Entry states of rows whose functions are ``f`` (rows x 8), starting from EDGE."""
    n = len(f)
    if n <= 4 * WIDTH:
        out, s = np.empty(n, np.uint8), EDGE
        for i, row in enumerate(f.tolist()):
            out[i] = s
            s = row[s]
        return out
    rows = -(-n // WIDTH)
    grid = np.tile(np.arange(8, dtype=np.uint8), (rows * WIDTH, 1))
    grid[:n] = f
    grid = grid.reshape(rows, WIDTH, 8)
    g = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(WIDTH):
        g = np.take_along_axis(grid[:, j], g, axis=1)
    s = scan_functions(g)
    out = np.empty((rows, WIDTH), np.uint8)
    for j in range(WIDTH):
        out[:, j] = s
        s = np.take_along_axis(grid[:, j], s[:, None].astype(np.intp), axis=1)[:, 0]
    return out.reshape(-1)[:n]


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code-point positions at which pieces start."""
    c = classes(cp, first)
    return np.flatnonzero(STARTS.ravel()[c.astype(np.intp) * 8 + scan(c)])


class Encoder:
    """Ranks, pair table and piece cache of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        ids = np.array([self.ranks[t] for t in self.tokens])
        self.size = int(ids[-1]) + 1
        self.length = np.zeros(self.size, np.int64)
        self.length[ids] = [len(t) for t in self.tokens]
        self.start = np.zeros(self.size, np.int64)
        self.start[ids] = np.cumsum(self.length[ids]) - self.length[ids]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)])
        get, keys, values = self.ranks.get, [], []
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a = get(t[:k])
                if a is not None and (b := get(t[k:])) is not None:
                    keys.append(a * self.size + b)
                    values.append(r)
        order = np.argsort(keys)
        self.pair_key = np.array(keys)[order]
        self.pair_rank = np.array(values)[order]
        self.pair = dict(zip(keys, values, strict=True))
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.count = np.zeros(1024, np.int64)
        self.offset = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], self.size)

    def _merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Words of at most LONG_PIECE bytes, merged side by side."""
        n, wide = len(words), max(map(len, words))
        length = np.array([len(w) for w in words])
        a = np.full((n, wide + 1), -1, np.int64)
        a[np.arange(wide + 1)[None, :] < length[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._rank(a[:, :-1], a[:, 1:])
        live, col = np.arange(n), np.arange(wide + 1)
        while len(live):
            r = rank[live]
            j = r.argmin(axis=1)
            best = r[np.arange(len(live)), j]
            go = best < self.size
            live, j, best = live[go], j[go], best[go]
            if not len(live):
                break
            src = np.minimum(col[None, :] + (col[None, :] > j[:, None]), wide)
            rows = np.take_along_axis(a[live], src, axis=1)
            rows[:, -1] = -1
            at = np.arange(len(live))
            rows[at, j] = best
            a[live] = rows
            r = np.take_along_axis(rank[live], np.minimum(src[:, :-1], wide - 1), axis=1)
            r[:, -1] = self.size
            r[at, j] = self._rank(best, rows[at, j + 1])
            has = j > 0
            r[at[has], j[has] - 1] = self._rank(rows[at[has], j[has] - 1], best[has])
            rank[live] = r
        return [row[row >= 0] for row in a]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """A heap of pairs over a linked list: n log n for any length."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, size, pair = len(ids), self.size, self.pair.get
        after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        heap = [(r, i, 0, 0) for i in range(n - 1) if (r := pair(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, si, sj = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or stamp[i] != si or stamp[j] != sj:
                continue
            ids[i], ids[j] = r, -1
            stamp[i] += 1
            stamp[j] += 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[j]
                if (q := pair(r * size + ids[k])) is not None:
                    heapq.heappush(heap, (q, i, stamp[i], stamp[k]))
            k = before[i]
            if k >= 0 and (q := pair(ids[k] * size + r)) is not None:
                heapq.heappush(heap, (q, k, stamp[k], stamp[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Put new pieces into the cache."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = np.array([r])
            elif len(w) <= LONG_PIECE:
                short.append(i)
            else:
                out[i] = self._merge_long(w)
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            for i, ids in zip(part, self._merge_many([words[i] for i in part]), strict=True):
                out[i] = ids
        new = np.concatenate(out).astype(np.uint32)
        counts = np.array([len(x) for x in out])
        at, base = len(self.cache), self.used
        while len(self.count) < at + len(words):
            self.count, self.offset = np.resize(self.count, 2 * len(self.count)), np.resize(self.offset, 2 * len(self.offset))
        while len(self.flat) < base + len(new):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[at : at + len(words)] = counts
        self.offset[at : at + len(words)] = base + np.cumsum(counts) - counts
        self.flat[base : base + len(new)] = new
        self.used += len(new)
        self.cache.update(zip(words, range(at, at + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, their byte starts in the joined text, and the texts' first ids (one more than texts)."""
        whole = "".join(texts)
        data = whole.encode()
        cp = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64)
        n_cp = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(n_cp) - n_cp
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(cp, first[n_cp > 0])
        size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        ends = np.cumsum(size)
        b0 = (ends - size)[starts]
        b1 = np.append(b0[1:], len(data))
        if len(self.cache) > MOST_CACHED:
            self.forget()
        pieces = [data[a:b] for a, b in zip(b0.tolist(), b1.tolist(), strict=True)]
        get = self.cache.get
        index = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            self.learn(list({pieces[i] for i in missing.tolist()}))
            index[missing] = [get(pieces[i]) for i in missing.tolist()]
        count = self.count[index]
        end = np.cumsum(count)
        pos = np.arange(int(end[-1])) - np.repeat(end - count, count) + np.repeat(self.offset[index], count)
        ids = self.flat[pos]
        length = self.length[ids]
        of_piece = np.searchsorted(starts, np.append(first, len(cp)))
        return ids, np.cumsum(length) - length, np.append(0, end)[of_piece]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        length = self.length[ids]
        end = np.cumsum(length)
        if not len(end):
            return b""
        pos = np.arange(int(end[-1])) - np.repeat(end - length, length) + np.repeat(self.start[ids], length)
        return self.bytes[pos].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about CHUNK_BYTES at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
    give_back()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (unsigned 32-bit little-endian), decoded_sha256 (of the decoded ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for doc_ids, texts in chunks(batches):
            ids, _, at = enc.encode(texts)
            raw, back = ids.astype("<u4").tobytes(), enc.decode(ids)
            byte = np.append(0, np.cumsum(enc.length[ids]))[at].tolist()
            at = at.tolist()
            span = range(len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([at[i + 1] - at[i] for i in span], pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in span]),
                    pa.array([hashlib.sha256(back[byte[i] : byte[i + 1]]).hexdigest() for i in span]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), starts (byte offset of each id in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for doc_ids, texts in chunks(batches):
            ids, starts, at = enc.encode(texts)
            base = np.append(0, np.cumsum(enc.length[ids]))[at]
            rel = starts - np.repeat(base[:-1], np.diff(at))
            offs = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.ListArray.from_arrays(offs, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(offs, pa.array(rel, pa.int64())),
                ],
                names=["doc_id", "ids", "starts"],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
