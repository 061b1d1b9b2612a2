"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. Training takes a bounded sample of labelled documents (MAX_TRAIN expected), bins
each statistic at quantiles of the sample, and grows depth-wise trees on the logistic loss from histograms of gradients.
The trees are flattened into arrays, which numpy traverses for a batch of documents at once.

Null text counts as empty; empty texts get a score like others. A null doc_id has no label; several labels of one
document are averaged (a label counts as 1 from an average of 1/2 on); labels that are null or of documents that aren't
there are not used. Of rows that repeat a labelled doc_id with different texts, the one with the least statistics is learned. Without any usable label every score is 1/2. Repeated rows are scored alike; an empty table gives an
empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training, ship, slices, spread, table, utf8, whole_rows

#: Expected size of the sample that is fitted.
MAX_TRAIN = 30_000
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros(256, np.uint8)  # 1 letter (a non-ASCII byte too), 2 digit, 3 blank, 4 punctuation, 5 one of SYMBOLS, 6 other
_KIND[:] = 6
_KIND[33:127] = 4
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[list(SYMBOLS)] = 5
NAMES = (
    "log_bytes", "log_words", "word_len", "letters", "digits", "blanks", "punctuation", "symbols", "others", "upper", "long_words", "short_words", "distinct_words", "log_lines",
    "line_words", "distinct_lines", "stops", "exclaims", "bars", "top_word", "distinct_threes", "ends_in_symbol", "all_caps", "non_ascii", "byte_entropy",
)


def statistics(text: bytes) -> list[float]:
    """The NAMES of one text in UTF-8."""
    b = np.frombuffer(text, np.uint8)
    n = max(len(b), 1)
    count = np.bincount(b, minlength=256)
    kinds = np.bincount(_KIND, weights=count, minlength=7)
    words = text.split()
    w = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    threes = len(set(zip(words, words[1:], words[2:]))) / (w - 2) if w > 2 else 1.0
    p = count[count > 0] / n
    return [
        np.log1p(len(b)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        count[65:91].sum() / n, (lengths > 12).sum() / w, (lengths < 3).sum() / w, len(seen) / w, np.log1p(len(lines)),
        len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), count[46] / w, count[33] / w, count[124] / w, max(seen.values(), default=0) / w, threes,
        sum(x[-1] in SYMBOLS for x in words) / w, sum(x.isupper() for x in words) / w, count[128:].sum() / n, float(-(p * np.log2(p)).sum()),
    ]


class Trees(NamedTuple):
    """Flattened complete trees: node k's children are 2k + 1 and 2k + 2; a row goes right if its bin is above `cut`."""

    edges: np.ndarray  # statistics x bin edges
    attribute: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows, total = self.bins(x), np.arange(len(x)), np.full(len(x), self.base)
        inner = self.attribute.shape[1]
        for attribute, cut, leaf in zip(self.attribute, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (b[rows, attribute[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosting by histograms: at each node the cut with the largest gain among all statistics and bins."""
    n, m = x.shape
    edges = np.quantile(x, np.linspace(0, 1, n_bins + 1)[1:-1], axis=0).T.copy() if n else np.zeros((m, n_bins - 1))
    inner, leaves = 2**depth - 1, 2**depth
    p = (y.sum() + 1) / (n + 2)
    model = Trees(edges, np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), 255, np.int64), np.zeros((n_trees, leaves)), float(np.log(p / (1 - p))))
    if not n or y.min() == y.max():
        return model if n else model._replace(base=0.0)
    b = model.bins(x).astype(np.int64)
    f = np.full(n, model.base)
    for t in range(n_trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            place = (at - first) * n_bins
            hist = np.empty((3, m, width, n_bins))
            for k in range(m):
                key = place + b[:, k]
                for v, weight in enumerate((g, h, None)):
                    hist[v, k] = np.bincount(key, weight, width * n_bins).reshape(width, n_bins)
            left = hist.cumsum(axis=3)
            total = left[..., -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least) | (right[2] < least)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(axis=1)
            good = best[np.arange(width), pick] > 1e-9
            model.attribute[t, first : first + width] = np.where(good, pick // n_bins, 0)
            model.cut[t, first : first + width] = np.where(good, pick % n_bins, 255)
            at = 2 * at + 1 + (b[np.arange(n), model.attribute[t, at]] > model.cut[t, at])
        place = at - inner
        model.leaf[t] = rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        f += model.leaf[t, place]
    return model


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(quality, text) of a sample of labelled documents, picked by a hash of the doc_id; the picked ids are bounded, so they may be broadcast."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(is_training(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    share = min(1.0, max_train / max(usable.count(), 1))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return one.select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fits on the driver; what it collects is MAX_TRAIN rows of statistics."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    sample = training_sample(docs, labels, max_train)
    sample = spread(sample.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "quality", "text")).mapInArrow(run, "doc_id long, quality int, x array<float>")
    got = sample.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), np.float64).reshape(got.num_rows, len(NAMES))
    return fit(x, got["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """docs (its columns in the struct `doc`, which has a text) with a score. Only texts go to Python and only scores come back: rows stay where they are."""
    ship(docs.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [np.zeros(0)]
            for b in slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
                x = np.array([statistics(t) for t in utf8(b.column(0))], np.float64).reshape(b.num_rows, len(NAMES))
                parts.append(model.score(x.astype(np.float32).astype(np.float64)))
            yield pa.array(np.concatenate(parts))

    return spread(docs.select("doc")).select("doc", F.arrow_udf(run, "double")(F.col("doc.text")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, max_train)
    small = scored(docs.select(F.struct("doc_id", "text").alias("doc")), model)
    return small.select("doc.doc_id", (~is_training(F.col("doc.doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, with all their columns."""
    model = train(docs, labels)
    return scored(whole_rows(docs), model).filter(F.col("score") >= THRESHOLD).select("doc.*")


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
