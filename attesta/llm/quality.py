"""Operator 9: Bradley-Terry pairwise ranking of documents by quality, thresholded at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices, span_hash, rolling, staged, word_spans

FEATURES = [
    "log_words", "word_length", "upper", "digits", "other_script", "stops", "marks", "bang", "bar", "symbols", "repeats", "distinct",
    "line_words", "upper_words", "mark_words", "spaces", "controls", "one_letter",
]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures per text, from its bytes and words alone. An empty text has zeros."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    hist = np.bincount(np.repeat(np.arange(n) * 256, sizes) + data, minlength=n * 256).reshape(n, 256).astype(float)
    of = lambda s: hist[:, list(s if isinstance(s, bytes) else bytes(s))].sum(1)
    start, end, row = word_spans(data, offsets)
    words = np.bincount(row, minlength=n).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(sizes, 1)
    h = span_hash(rolling(data), start, end) if len(start) else np.zeros(0, np.uint64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    last = data[end - 1] if len(start) else np.zeros(0, np.uint8)
    second = np.where(end - start > 1, data[np.minimum(start + 1, len(data) - 1)], 0) if len(start) else first
    capital = lambda b: (b >= 65) & (b <= 90)
    mark = (last >= 33) & (last <= 47) | (last >= 58) & (last <= 64) | (last >= 123) & (last <= 126)
    each = lambda m: np.bincount(row, weights=m, minlength=n) / per_word
    letters = np.maximum(of(range(65, 91)) + of(range(97, 123)), 1)
    out = np.stack(
        [
            np.log1p(words), (sizes - of(b" \t\n\r\x0b\x0c")) / per_word, of(range(65, 91)) / letters, of(range(48, 58)) / per_byte, of(range(128, 256)) / per_byte,
            of(b".,;:?") / per_word, of(b"\"'()[]{}<>/\\-_=+~^`@") / per_word, of(b"!") / per_word, of(b"|") / per_word, of(b"#$%&*") / per_word,
            each(same), np.bincount(row[order], weights=fresh, minlength=n) / per_word, np.minimum(words / (hist[:, 10] + 1), 200) / 200, each(capital(first) & capital(second)), each(mark), of(b" ") / per_byte, of([*range(0, 9), *range(14, 32), 127]) / per_byte, each(end - start == 1),
        ],
        axis=1,
    )
    out[sizes == 0] = 0
    return out


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<float>) of every text, whole."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                x = text_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class BradleyTerry:
    """score(x) = sigmoid(scale * (w . z - cut) + logit(threshold)), z the standardised features."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float
    threshold: float = 0.7

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, pairs: int = 200_000, ridge: float = 1e-3, seed: int = 11) -> BradleyTerry:
    """Learn from preference pairs (a row of label 1 beats a row of label 0): logistic loss on feature differences, by
    Newton steps. The cut is the score quantile at the share of label 0 among the rows. With one label alone the
    weights are 0 and every score is on the label's side of the threshold."""
    x = x.astype(float)
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    std = np.where(std < 1e-9, 1, std)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(mean, std, np.zeros(len(mean)), 0.0 if len(good) or not len(x) else 1.0, 1.0, threshold)
    z = np.clip((x - mean) / std, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)
    cut = float((s[k - 1] + s[min(k, len(s) - 1)]) / 2)
    return BradleyTerry(mean, std, w, cut, 2.0 / max(float(s.std()), 1e-9), threshold)


HELD = 2  # rows whose crc32(id) mod 4 is this are never learned from


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD, F.lit(False))


def labelled(labels: DataFrame, sample: int = 30_000) -> DataFrame:
    """(doc_id, y): at most about ``sample`` labelled ids, by hash of the id. Held-out and null-label rows never."""
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = min(1.0, sample / max(1, lab.count()))
    return lab.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def training_rows(features: DataFrame, labels: DataFrame, sample: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, for the driver: one row per labelled id, the least one where rows share the id."""
    lab = labelled(labels, sample)
    rows = features.join(lab, "doc_id").groupBy("doc_id").agg(F.min(F.struct("features", "y")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return x, rows["y"].to_numpy()


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 30_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Features come from the text alone. Null and empty texts have zero features and a score like any other; repeated
    rows have equal scores, and a repeated id is learned from once. ``sample`` bounds the labelled ids that are learned from;
    all else covers every row. An empty table gives no rows.
    """
    feats = staged(featurise(docs), "features")
    x, y = training_rows(feats, labels, sample)
    model = fit(x, y, threshold)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            f = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f))], ["doc_id", "score"])

    scored = feats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 30_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``; see ``score_documents``.

    Features of the sampled labelled texts alone go to the driver; then one pass scores and filters, without a shuffle.
    """
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled(labels, sample).select("doc_id")), "doc_id", "left_semi")
    model = fit(*training_rows(featurise(asked), labels, sample), threshold)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(at))
            score = [model.score(text_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)) for i, j in slices(offsets)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= threshold))

    return docs.mapInArrow(run, docs.schema)
