"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each text becomes a set of hashed indicators, from the whole text: word unigrams and bigrams, byte
3-grams of the words' ends and shapes, and n-grams of repetition marks (a word that equals the one
before it, a four-word sequence seen earlier in the text) with the coarse share of such marks. An
indicator is scaled by the log-count ratio of the two classes, a linear model is fitted to the scaled
indicators by dual coordinate descent on the hinge loss, and its weights are pulled towards their mean
size. A logistic curve over the margins of the fitting rows turns margins into scores.

Fitting reads at most ``sample`` labelled rows of each class (default 6,000; those with the smallest
hash of the id); scoring reads every row. Ids, languages, sources and labels never enter a score.

Defined results: a null text is empty and gets a score like any other; a null id is not held out and
cannot have a label; a document labelled more than once counts once, as good only if all its labels
are good; null labels are left out; with one class or none there is nothing to learn and every score is the
share of good labels (0.5 without labels); repeated rows and ties score alike; an empty table gives
an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._io import stash

#: Width of the hashed indicators.
BITS = 18
SAMPLE = 6000
#: Bytes of fitting rows' indicators that the driver takes; those of an ordinary text are about 2 kB.
MOST_BYTES = 128 << 20
FOLDS = 5
THRESHOLD = 0.3
#: How far weights stay apart from their mean size.
BETA = 0.5
#: Fitting rows that must have an indicator for it to count.
LEAST_SEEN = 3

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * _MUL
    return ((x ^ (x >> np.uint64(29))) * _ODD) >> np.uint64(64 - BITS)


def _classes() -> np.ndarray:
    """Byte to shape: small letter or any byte beyond ASCII, capital, digit, else the byte itself."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1] = out[128:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    return out


_SHAPE = _classes()


def features(text: str) -> np.ndarray:
    """The distinct indicators of a text, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode().split()
    n = len(words)
    if not n:
        return _mix(np.zeros(1, np.uint64), 1).astype(np.int64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    hashes = np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen))
    h = hashes[ids]
    raw = np.frombuffer(b" ".join(seen), np.uint8)
    shape = np.r_[np.uint64(32), _SHAPE[raw], np.uint64(32)]
    found = [_mix(hashes, 2), _mix(shape[:-2] * np.uint64(65536) + shape[1:-1] * np.uint64(256) + shape[2:], 3)]
    if n > 1:
        found.append(_mix(h[:-1] * np.uint64(31) + h[1:], 4))
    echo = np.zeros(n, np.uint64)
    echo[1:] = ids[1:] == ids[:-1]
    again = np.zeros(n, np.uint64)
    if n >= 4:
        a = ids.astype(np.uint64)
        grams = ((a[:-3] * _MUL + a[1:-2]) * _MUL + a[2:-1]) * _MUL + a[3:]
        first = np.unique(grams, return_index=True)[1]
        again[: n - 3] = 1
        again[first] = 0
    for salt, mark in ((5, echo), (6, again)):
        if n >= 3:
            found.append(_mix(np.unique(mark[:-2] * np.uint64(4) + mark[1:-1] * np.uint64(2) + mark[2:]), salt))
        found.append(_mix(np.asarray([10 * int(mark.sum()) // n], np.uint64), salt + 10))
    # Shares of the words that end in a sign, or are one.
    last = np.fromiter((w[-1] for w in seen), np.uint8, len(seen))[ids]
    signs = (last < 128) & ~np.isin(last, np.frombuffer(b".,;:!?'\")0123456789", np.uint8)) & (_SHAPE[last] > 3)
    found.append(_mix(np.asarray([10 * int(signs.sum()) // n], np.uint64), 7))
    return np.unique(np.concatenate(found)).astype(np.int64)


def _fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


class Model:
    """Weights of the indicators, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights.astype(np.float32), slope, offset

    def score(self, text: str) -> float:
        f = features(text)
        margin = float(self.weights[f].sum()) / len(f) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


class _Scaled:
    """Rows of ratios, each scaled to the length of its set, so that long texts do not outweigh short ones; made when they are asked for, as all take several times the sets."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio

    def __getitem__(self, i: int) -> np.ndarray:
        f = self.rows[i]
        return self.ratio[f] / len(f) ** 0.5

    def __len__(self) -> int:
        return len(self.rows)


def train(rows: list[np.ndarray], good: np.ndarray, c: float = 1.0, epochs: int = 12) -> Model:
    """Log-count ratios, dual coordinate descent on the hinge loss, and the logistic curve."""
    width = 1 << BITS
    if good.all() or not good.any():
        share = 0.5 if not len(good) else float(good.mean())
        return Model(np.zeros(width), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counts = [np.ones(width), np.ones(width)]
    for f, g in zip(rows, good):
        counts[int(g)][f] += 1
    ratio = np.log(counts[1] / (2 + good.sum())) - np.log(counts[0] / (2 + (~good).sum()))
    ratio[counts[0] + counts[1] - 2 < LEAST_SEEN] = 0  # too rare to tell the classes apart
    y = np.where(good, 1.0, -1.0)
    scaled = _Scaled(rows, ratio)
    box = c * np.where(good, len(good) / (2.0 * good.sum()), len(good) / (2.0 * (~good).sum()))
    w, _ = descend(rows, scaled, y, box, width, epochs)
    pulled = (1 - BETA) * np.abs(w).mean() + BETA * w
    weights = pulled * ratio
    margins = np.array([weights[f].sum() / len(f) ** 0.5 for f in rows])
    slope, offset = _curve(margins, good)
    return Model(weights, slope, offset)


def descend(rows: list[np.ndarray], scaled: list[np.ndarray] | _Scaled, y: np.ndarray, box: np.ndarray, width: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, dual variables) of the hinge-loss model by dual coordinate descent: min w.w/2 + sum(box * max(0, 1 - y w.x))."""
    square = np.array([max(float(scaled[i] @ scaled[i]), 1e-12) for i in range(len(rows))])
    w, alpha, rng = np.zeros(width), np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            row = scaled[i]
            slack = y[i] * float(w[rows[i]] @ row) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), box[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return w, alpha


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the margin, with softened targets, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    size = float(np.abs(margins).mean()) or 1.0
    x = np.c_[margins / size, np.ones(len(margins))]
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(theta[0] / size), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """A model of the labelled rows that are not held out; ``sample`` rows of each class at most, and ``most_bytes`` of their indicators."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_good")).filter(_fold(F.col("_id")) != 0)
    picked = [known.filter(F.col("_good") == g).orderBy(F.xxhash64("_id"), "_id").limit(sample) for g in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows of 12 bytes at most
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    found = docs.select(F.col(id_col).cast("long").alias("_id"), text).join(chosen, "_id").select("_id", "_good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [features(t.as_py()).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["_id", "_good", "f"])

    found = stash(found.mapInArrow(run, "_id long, _good int, f binary"), "classifier-sample")
    # Very long texts have large sets: of each class as many rows come as fit half of ``most_bytes``, by the hash of the id.
    size = Window.partitionBy("_good").orderBy(F.xxhash64("_id"), "_id", "f").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_size", F.sum(F.octet_length("f")).over(size)).filter(F.col("_size") <= most_bytes // 2)
    # Two rows of one id may both come; ordering by the set as well keeps the fit the same on every run.
    got = found.select("_id", "f", "_good").toArrow().sort_by([(c, "ascending") for c in ("_id", "f", "_good")])
    sets = [np.frombuffer(f.as_buffer(), "<u4") for f in got["f"]]  # views of the table
    return train(sets, got["_good"].to_numpy() == 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``carried`` holds the columns named in ``carry``."""
    beside = ["doc_id", "carried"] if carry else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.score(t.as_py()) for t in b.column(len(beside))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(beside)], pa.array(out, pa.float64())], [*beside, "score"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *([F.struct(*carry).alias("carried")] if carry else []), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = StructType([*(rows.schema[c] for c in beside), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).select(
        *beside, F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
