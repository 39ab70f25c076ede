"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers of ``HIDDEN`` units read the UTF-8 bytes of a segment
forwards and backwards; every byte position gets a probability of each language
from both states.  A document's probabilities are the mean over all its
positions; the label is the largest, the score its probability.  Texts are cut
into segments of ``SEGMENT`` bytes so that many run side by side; every byte of
every text is read.

The network is trained here, by backpropagation through time in numpy with Adam,
on a bounded sample of labelled rows: every language has its share of ``SAMPLE``
rows with the smallest hashes of id and text, ``PER_LANG`` at most and ``LEAST_ROWS`` at least where it has
as many different ones, one window of ``WINDOW`` characters at a hashed place of each.  No language is left out, however
many there are.  Rows whose crc32(id) mod 3 is 1 are never learned from.  The
sample, and a count for each label, are all that reaches the driver.

Cases: very long texts are read whole, in segments; ties of the score go to the label
that sorts first; null text, or text without a letter: ``und`` with score 0; null ids are
not held out; an empty text teaches nothing, so a language of which all labelled texts are empty is not learned;
without a labelled text every text is ``und``; rows that repeat are learned from once; equal texts get
equal labels; columns of other names are ignored.  The driver holds the sample: its size grows with the number of languages only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

HIDDEN = 8
SEGMENT, BATCH = 128, 1024
SAMPLE, PER_LANG, LEAST_ROWS, WINDOW = 15_360, 240, 20, 160
STEPS, RATE, TRAIN_LEN, TRAIN_BATCH = 180, 0.02, 48, 256
UND = "und"
CHUNK_BYTES = 500_000


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, window of text) of the bounded training sample, in a fixed order."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.coalesce("text", F.lit("")) != "")
    )
    u = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1_000_000_000))
    rows = rows.withColumn("u", u)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("u").alias("n")).orderBy("lang").collect()  # a row a language
    if not counts:
        return []
    each = max(LEAST_ROWS, min(PER_LANG, SAMPLE // len(counts)))
    # half as many again as are wanted: the count is approximate
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1_000_000_000, 3 * each * 1_000_000_000 // (2 * max(1, r["n"])) + 1))])
    place = F.pmod(F.xxhash64("id", "text", F.lit("place")), F.greatest(F.char_length("text") - WINDOW, F.lit(1)).cast("long")).cast("int") + 1
    picked = rows.filter(F.col("u") < F.element_at(rate, F.col("lang"))).select("lang", "u", F.substring(F.col("text"), place, F.lit(WINDOW)).alias("part")).distinct()
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "part"))).filter(F.col("k") <= each)
    got = picked.select("lang", "u", "part").orderBy("u", "lang", "part").limit(each * len(counts))
    return [(r["lang"], r["part"]) for r in got.collect()]


class Network:
    """Weights of both directions and of the output layer.

    x: 2 x 256 x 3H (byte to gates), u: 2 x H x 3H, out: 2H x K, bias: K."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        self.langs = langs
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)),
            "u": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "out": rng.normal(0, 0.3, (2 * h, k)),
            "bias": np.zeros(k),
        }

    @staticmethod
    def _sigmoid(a: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh(0.5 * a)

    def loss(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of data (batch x length), and its gradients."""
        h, (b, n) = HIDDEN, data.shape
        p, kept, states = self.p, [], []
        for d in range(2):
            s, seen, out = np.zeros((b, h)), [], [None] * n
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                gx, gu = p["x"][d][data[:, t]], s @ p["u"][d]
                z = self._sigmoid(gx[:, :h] + gu[:, :h])
                r = self._sigmoid(gx[:, h : 2 * h] + gu[:, h : 2 * h])
                c = np.tanh(gx[:, 2 * h :] + r * gu[:, 2 * h :])
                seen.append((t, s, z, r, c, gu[:, 2 * h :]))
                s = c + z * (s - c)
                out[t] = s
            kept.append(seen)
            states.append(np.stack(out, 1))
        both = np.concatenate(states, 2)
        logit = both @ p["out"] + p["bias"]
        logit -= logit.max(2, keepdims=True)
        q = np.exp(logit)
        q /= q.sum(2, keepdims=True)
        value = -np.log(q[np.arange(b)[:, None], np.arange(n)[None], label[:, None]] + 1e-12).mean()
        q[np.arange(b)[:, None], np.arange(n)[None], label[:, None]] -= 1
        q /= b * n
        g = {"out": np.einsum("bth,btk->hk", both, q), "bias": q.sum((0, 1)), "x": np.zeros_like(p["x"]), "u": np.zeros_like(p["u"])}
        back = q @ p["out"].T
        for d in range(2):
            ds = np.zeros((b, h))
            for t, s, z, r, c, uc in reversed(kept[d]):
                ds = ds + back[:, t, d * h : (d + 1) * h]
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (s - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                gx = np.concatenate((dz, dr, dc), 1)
                gu = np.concatenate((dz, dr, dc * r), 1)
                np.add.at(g["x"][d], data[:, t], gx)
                g["u"][d] += s.T @ gu
                ds = ds * z + gu @ p["u"][d].T
        return float(value), g

    def train(self, rows: list[tuple[str, str]], seed: int = 2) -> float:
        """Adam over random segments of the rows, languages drawn evenly; the last loss."""
        rng = np.random.default_rng(seed)
        raw: dict[str, list[np.ndarray]] = {}
        for lang, part in rows:
            x = np.frombuffer(part.encode(), np.uint8)
            if len(x):
                raw.setdefault(lang, []).append(np.resize(x, max(len(x), TRAIN_LEN)))
        names = [x for x in self.langs if x in raw]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        value = 0.0
        for step in range(1, STEPS + 1):
            data, label = [], []
            for i in range(TRAIN_BATCH):
                lang = names[(step * TRAIN_BATCH + i) % len(names)]
                x = raw[lang][rng.integers(len(raw[lang]))]
                at = rng.integers(len(x) - TRAIN_LEN + 1)
                data.append(x[at : at + TRAIN_LEN])
                label.append(self.langs.index(lang))
            value, g = self.loss(np.stack(data), np.array(label))
            for k, v in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                v -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return value


class Reader:
    """The network in single precision, laid out for many segments at once.

    Gates stand in rows and segments in columns; halves are folded into the
    weights so that sigmoid(a) is (1 + tanh(a / 2)) / 2."""

    def __init__(self, p: dict[str, np.ndarray]):
        h = HIDDEN
        scale = np.repeat([0.5, 0.5, 1.0], h)
        self.x = [np.ascontiguousarray((p["x"][d] * scale).T, np.float32) for d in range(2)]
        inner = np.repeat([0.5, 0.5, 0.5], h)
        self.u = [np.ascontiguousarray((p["u"][d] * inner).T, np.float32) for d in range(2)]
        self.out = [np.ascontiguousarray(p["out"][d * h : (d + 1) * h].T, np.float32) for d in range(2)]
        self.bias = p["bias"].astype(np.float32)[:, None]

    def logits(self, data: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """data: length x segments of bytes; returns length x languages x segments.

        ends: where each segment ends.  The way back starts there, so what stands behind it, and how long the other
        segments are, makes no difference."""
        h = HIDDEN
        n, b = data.shape
        out = np.empty((n, len(self.bias), b), np.float32)
        part = np.empty(out.shape[1:], np.float32)
        g, a = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        least = n if ends is None else int(ends.min())
        for d in range(2):
            s = np.zeros((h, b), np.float32)
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                np.take(self.x[d], data[t], axis=1, out=g, mode="clip")
                np.matmul(self.u[d], s, out=a)
                zr = a[: 2 * h]
                zr += g[: 2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                c = a[2 * h :]
                c *= a[h : 2 * h]
                c += g[2 * h :]
                np.tanh(c, out=c)
                s -= c
                s *= a[:h]
                s *= 0.5
                s += c
                if d == 1 and t >= least:
                    s *= t < ends
                if d == 0:
                    np.matmul(self.out[0], s, out=out[t])
                else:
                    np.matmul(self.out[1], s, out=part)
                    out[t] += part
        out += self.bias
        return out

    def probabilities(self, data: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        q = self.logits(data, ends)
        q -= q.max(axis=1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(axis=1, keepdims=True)
        return q

    def pooled(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean probabilities, and the number of positions by their own label."""
        k = len(self.bias)
        size = np.array([len(r) for r in raws], np.int64)
        n_seg = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(raws)), n_seg)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        at = np.repeat(np.cumsum(size) - size, n_seg) + within * SEGMENT
        length = np.minimum(np.repeat(size, n_seg) - within * SEGMENT, SEGMENT)
        whole = np.frombuffer(b"".join(raws) + b"\x00" * SEGMENT, np.uint8)
        total, votes = np.zeros((len(raws), k)), np.zeros((len(raws), k), np.int64)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), BATCH):
            seg = order[i : i + BATCH]
            n = length[seg]
            data = whole[at[seg][None, :] + np.arange(int(n[0]))[:, None]].astype(np.intp)
            q = self.probabilities(data, n)
            live = np.arange(len(data))[:, None] < n[None, :]
            best = q.argmax(axis=1)
            q *= live[:, None, :]
            sums = q.sum(axis=0)
            for j in range(k):
                total[:, j] += np.bincount(owner[seg], sums[j], len(raws))
                votes[:, j] += np.bincount(owner[seg], ((best == j) & live).sum(axis=0), len(raws)).astype(np.int64)
        return total / np.maximum(size, 1)[:, None], votes


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    rows = sample(docs, id_col, text_col, lang_col)
    if not rows:
        return None
    net = Network(sorted({lang for lang, _ in rows}))
    net.train(rows)
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, share (of positions with that label), and the columns ``keep``."""
    weights, langs = (None, []) if net is None else ({k: v.astype(np.float32) for k, v in net.p.items()}, net.langs)
    schema = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"), *keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights) if weights else None
        for batch in batches:
            texts = batch.column(1)
            start, size = 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    yield judged(reader, batch.slice(start, i + 1 - start))
                    start, size = i + 1, 0
        give_back()

    def judged(reader: Reader | None, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        label, score, share = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if reader else []
        if some:
            q, votes = reader.pooled([texts[i].encode() for i in some])
            for i, row, v in zip(some, q, votes, strict=True):
                j = int(row.argmax())
                label[i], score[i], share[i] = langs[j], min(1.0, round(float(row[j]), 4)), round(float(v[j] / v.sum()), 4)
        names = ["doc_id", "lang_pred", "score", "share", *keep]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(score), pa.array(share), *batch.columns[2:]], names=names)

    from pyspark.sql import types as T

    out = T.StructType([schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType()), *schema.fields[2:]])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"), *keep).mapInArrow(run, out)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the sample of ``docs`` and label every row: doc_id, held_out, lang_pred, score, share."""
    out = predict(docs, trained(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "share")
