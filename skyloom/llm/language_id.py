"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in UTF-8, one direction forwards and one backwards, each a gated recurrent unit of HIDDEN cells;
a linear layer on both states labels every byte with log-odds of the languages. So that a text's parts go through it side
by side, it reads segments of SEGMENT bytes, each with the CONTEXT bytes before and after it, which warm up the states and
aren't pooled there. A document's probabilities are the softmax of the mean log-probabilities over all its bytes that
belong to letters, times POOL. Training, by backpropagation through time in numpy with Adam, takes SEGMENTS stretches of
TRAIN_SEGMENT bytes from a sample of TRAIN_DOCS expected documents of each language, or fewer, so that all languages have
MAX_DOCS, picked by hash; these bound what the driver gets, at any size of the input and any number of languages but for
its table of languages.

Text that is null or has no letter is `und` with score 0. A null doc_id counts as the empty text, whose remainder is 0, so
it is held out of training; a null lang is never learned. Without any labelled text every text is `und`. Repeated rows are judged alike; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training, ship, slices, spread, table, utf8

SEGMENT, CONTEXT, TRAIN_SEGMENT, HIDDEN = 128, 16, 64, 8
#: Bounds of the training sample: documents of each language (expected), segments of each document.
TRAIN_DOCS, MAX_DOCS, SEGMENTS = 1500, 60_000, 4
EPOCHS, BATCH, SEED = 8, 256, 7
POOL = 20.0
#: Segments that go through the network at a time.
LANES = 2048
LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    """For each direction: table (256 x 3H, what a byte adds to the gates), recurrent weights (3H x H), candidate's recurrent bias (H); then the output layer."""

    table: np.ndarray  # 2 x 256 x 3H
    rec: np.ndarray  # 2 x 3H x H
    bias: np.ndarray  # 2 x H
    out: np.ndarray  # L x 2H
    out_bias: np.ndarray  # L


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(net: Network, d: int, x: np.ndarray, keep: bool):
    """States of direction d over x (steps x lanes) as steps x H x lanes; with keep, also what the backward pass needs."""
    h_n = net.rec.shape[2]
    steps, lanes = x.shape
    table, rec, bias = np.ascontiguousarray(net.table[d].T), net.rec[d], net.bias[d][:, None]
    h = np.zeros((h_n, lanes), np.float32)
    states = np.empty((steps, h_n, lanes), np.float32)
    saved = []
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        a = np.take(table, x[t], axis=1)
        u = rec @ h
        gates = _sigmoid(a[: 2 * h_n] + u[: 2 * h_n])
        z, r = gates[:h_n], gates[h_n:]
        c_rec = u[2 * h_n :] + bias
        c = np.tanh(a[2 * h_n :] + r * c_rec)
        if keep:
            saved.append((t, h, z, r, c, c_rec))
        h = c + z * (h - c)
        states[t] = h
    return states, saved


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    """steps x L x lanes: log-odds of the languages at every position."""
    both = np.concatenate([_forward(net, 0, x, False)[0], _forward(net, 1, x, False)[0]], axis=1)
    return net.out @ both + net.out_bias[:, None]


def _log_softmax(s: np.ndarray, axis: int) -> np.ndarray:
    s = s - s.max(axis=axis, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=axis, keepdims=True))


def train_network(x: np.ndarray, y: np.ndarray, n_lang: int, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> Network:
    """x: segments x TRAIN_SEGMENT bytes, y: a language for each; every position is trained to say its segment's language."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    p = [normal(2, 256, 3 * hidden), normal(2, 3 * hidden, hidden), np.zeros((2, hidden), np.float32), normal(n_lang, 2 * hidden), np.zeros(n_lang, np.float32)]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    step, total = 0, max(1, epochs * ((len(x) + BATCH - 1) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            pick = order[k : k + BATCH]
            grads = _gradients(Network(*p), np.ascontiguousarray(x[pick].T), y[pick])
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
            for v, g, m, s in zip(p, grads, first, second):
                g = g * scale
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(*p)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over positions, by backpropagation through time."""
    steps, lanes = x.shape
    h_n = net.rec.shape[2]
    runs = [_forward(net, d, x, True) for d in (0, 1)]
    both = np.concatenate([r[0] for r in runs], axis=1)
    dl = np.exp(_log_softmax(net.out @ both + net.out_bias[:, None], 1))
    dl[:, y, np.arange(lanes)] -= 1
    dl /= steps * lanes
    d_out = np.einsum("tlb,thb->lh", dl, both, optimize=True)
    d_both = net.out.T @ dl
    d_table, d_rec, d_bias = np.zeros_like(net.table), np.zeros_like(net.rec), np.zeros_like(net.bias)
    for d, (_, saved) in enumerate(runs):
        dh = np.zeros((h_n, lanes), np.float32)
        d_in = np.empty((steps, 3 * h_n, lanes), np.float32)
        for t, h, z, r, c, c_rec in reversed(saved):
            dh = dh + d_both[t, d * h_n : (d + 1) * h_n]
            dz = dh * (h - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * c_rec * r * (1 - r)
            d_in[t] = np.concatenate([dz, dr, dc])
            du = np.concatenate([dz, dr, dc * r])
            d_rec[d] += du @ h.T
            d_bias[d] += du[2 * h_n :].sum(axis=1)
            dh = dh * z + net.rec[d].T @ du
        flat = d_in.transpose(0, 2, 1).reshape(-1, 3 * h_n)
        for k in range(3 * h_n):
            d_table[d, :, k] = np.bincount(x.reshape(-1), flat[:, k], 256)
    return [d_table, d_rec, d_bias, d_out.astype(np.float32), dl.sum(axis=(0, 2))]


def letter_bytes(text: str) -> np.ndarray:
    """Which bytes of the text in UTF-8 belong to letters; for ASCII by table."""
    raw = np.frombuffer(text.encode(), np.uint8)
    low = raw | 0x20
    mask = (low >= 97) & (low <= 122) & (raw < 128)
    if (raw >= 128).any():
        width = np.diff(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)))
        odd = {c for c in set(text) if ord(c) > 127 and LETTER.match(c)}
        if odd:
            mask |= np.repeat(np.fromiter((c in odd for c in text), bool, len(text)), width)
    return mask


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean log-probabilities (texts x languages) over the bytes of letters; nan where there is none."""
    n_lang = len(net.out_bias)
    total, weight = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lanes = 0

    def flush() -> None:
        nonlocal lanes
        x, mask, owner = (np.concatenate([p[k] for p in pending]) for k in range(3))
        for k in range(0, len(x), LANES):
            log_p = _log_softmax(_logits(net, np.ascontiguousarray(x[k : k + LANES].T)), 1)
            m = mask[k : k + LANES].T.astype(np.float32)
            summed = np.einsum("tlb,tb->bl", log_p, m)
            np.add.at(total, owner[k : k + LANES], summed)
            np.add.at(weight, owner[k : k + LANES], m.sum(axis=0))
        pending.clear()
        lanes = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        mask = letter_bytes(text)
        if not mask.any():
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        n = -(-len(raw) // SEGMENT)
        x, m = np.full(n * SEGMENT + 2 * CONTEXT, 32, np.uint8), np.zeros((n, SEGMENT + 2 * CONTEXT), bool)
        x[CONTEXT : CONTEXT + len(raw)] = raw
        m[:, CONTEXT:-CONTEXT] = np.append(mask, np.zeros(n * SEGMENT - len(raw), bool)).reshape(n, SEGMENT)
        pending.append((np.lib.stride_tricks.sliding_window_view(x, SEGMENT + 2 * CONTEXT)[::SEGMENT], m, np.full(n, i)))
        lanes += n
        if lanes >= 2 * LANES:
            flush()
    if pending:
        flush()
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / weight[:, None]


def training_segments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Stretches at evenly spaced places of sampled documents. The driver gets about MAX_DOCS * SEGMENTS * TRAIN_SEGMENT bytes at most."""
    ship(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL").filter(is_training(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, TRAIN_SEGMENT), np.uint8), np.zeros(0, np.int64), []
    shares = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, min(TRAIN_DOCS, MAX_DOCS / len(counts)) / n) * (1 << 30)))])
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < shares[F.col("lang")]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, langs, parts = [], [], []
            for doc_id, lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if len(raw) >= TRAIN_SEGMENT:
                    for k in range(n := min(SEGMENTS, len(raw) // TRAIN_SEGMENT)):
                        at = (len(raw) - TRAIN_SEGMENT) * k // max(n - 1, 1)
                        ids.append(doc_id)
                        langs.append(lang)
                        parts.append(raw[at : at + TRAIN_SEGMENT])
                elif raw:
                    ids.append(doc_id)
                    langs.append(lang)
                    parts.append(raw.ljust(TRAIN_SEGMENT))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["doc_id", "lang", "part"])

    got = picked.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, part binary").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["doc_id"].to_pylist(), got["part"].to_pylist()), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    langs = sorted({r[0] for r in rows})
    return np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, TRAIN_SEGMENT), np.array([langs.index(r[0]) for r in rows], np.int64), langs


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    x, y, langs = training_segments(docs)
    net = train_network(x, y, max(len(langs), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            mean = score_texts(net, b.column(1).to_pylist())
            none = np.isnan(mean[:, 0]) | (not langs)
            q = np.exp(_log_softmax(np.where(none[:, None], 0, mean) * POOL, 1))
            best = q.argmax(axis=1)
            named = ["und" if u else langs[k] for u, k in zip(none, best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(np.where(none, 0.0, q[np.arange(len(q)), best]), pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = spread(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
