"""Word shingles over arrays: every whole text to its set of hashed 5-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import give_back

WORDS = 5
CHUNK_BYTES = 500_000
M = np.array(0x9E3779B97F4A7C15, np.uint64)

_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The first k bytes of a lane of 8 (little-endian).
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_spans(raws: list[bytes], breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case (a blank after each), starts and ends of the words, and the number of words per text.

    breaks: of each byte (A-Z in lower case) whether it parts words; the blank does."""
    folded = _FOLD[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    edge = np.diff(np.concatenate(([1], breaks[folded].astype(np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))
    return folded, start, end, np.diff(np.concatenate(([0], at)))


def span_hashes(whole: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes [start, end), none of them empty.

    A span is cut into lanes of 8 bytes; each lane goes through the mixer together with its number, and the
    sum of its lanes is mixed with its length.  No span is a polynomial in a base, so texts that repeat
    a pattern (such as Thue-Morse words) don't cancel."""
    lanes = np.ndarray(len(whole) + 1, "<u8", np.concatenate((whole, np.zeros(8, np.uint8))), strides=(1,))
    size = end - start
    total = mix((lanes[start] & _FIRST[np.minimum(size, 8)]) + mix(M[None])[0])
    longer = np.flatnonzero(size > 8)
    if len(longer):
        more = (size[longer] - 1) // 8
        first = np.cumsum(more) - more
        lane = np.arange(more.sum()) - np.repeat(first, more) + 1
        at = np.repeat(start[longer], more) + 8 * lane
        part = lanes[at] & _FIRST[np.minimum(np.repeat(end[longer], more) - at, 8)]
        total[longer] += np.add.reduceat(mix(part + mix((lane + 1).astype(np.uint64) * M)), first)
    return mix(total + size.astype(np.uint64) * M)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts (A-Z in lower case), and the number of words per text."""
    whole, start, end, n = word_spans(raws)
    return span_hashes(whole, start, end), n


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes; fewer words than WORDS: the whole sequence as one."""
    h, n = word_hashes(raws)
    weights = [np.uint64(pow(int(M), 2 * j + 3, 2**64)) for j in range(WORDS)]
    most = max(0, len(h) - WORDS + 1)
    g = np.zeros(most, np.uint64)
    for j, w in enumerate(weights):
        g += h[j : j + most] * w
    g = mix(g)
    out, at = [], 0
    for k in n.tolist():
        if k >= WORDS:
            s = np.sort(g[at : at + k - WORDS + 1])
            keep = np.empty(len(s), bool)
            keep[:1] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s if keep.all() else s[keep])
        elif k:
            one = np.full(1, k, np.uint64)
            for j in range(k):
                one = mix(one + h[at + j : at + j + 1] * weights[j])
            out.append(one)
        else:
            out.append(g[:0])
        at += k
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids (column 0) and raw texts (column 1), about CHUNK_BYTES at a time."""
    for batch in batches:
        ids, raws, size = [], [], 0
        texts = batch.column(1)
        for k, i in enumerate(batch.column(0).to_pylist()):
            raw = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            ids.append(i)
            raws.append(raw)
            size += len(raw) + 1
            if size >= CHUNK_BYTES:
                yield ids, raws
                ids, raws, size = [], [], 0
        if ids:
            yield ids, raws
    give_back()
