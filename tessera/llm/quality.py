"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics.  Class means
and covariances come from sums that partitions compute and Spark adds up, so
all labelled rows count and no vector leaves its executor.  Covariances shrink
towards their pooled form and a multiple of the identity; scores are the
logistic of the difference of Gaussian log densities, whose Cholesky factors
are computed once.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, fold, give_back, small_batches, written

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "punctuation", "letters", "distinct_words", "line_repeats", "compression", "word_entropy", "short_lines")
#: Weight of the pooled covariance, and of the scaled identity.
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.01
#: A class's mean and covariance are fitted on standardised statistics, clipped here.
CLIP = 6.0

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower or non-ASCII, 3 digit, 4 symbol, 5 punctuation, 6 space
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[128:] = 2
_KIND[ord("0") : ord("9") + 1] = 3
for _c in b"#*$%&|<>{}[]\\^~_=+@/":
    _KIND[_c] = 4
for _c in b".,;:!?\"'()-":
    _KIND[_c] = 5
for _c in b" \t\n\x0b\x0c\r":
    _KIND[_c] = 6


def _logit(part: float, whole: float, usual: float, weight: float) -> float:
    """Log odds of a share, drawn towards its usual value in prose as if ``weight`` more units had been seen.

    A text of a few words then looks usual instead of extreme.
    """
    return math.log((part + weight * usual) / (max(whole - part, 0.0) + weight * (1.0 - usual)))


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; null counts as empty, and an empty text has a vector too."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=7) if raw else np.zeros(7, dtype=np.int64)
    words = WORD.findall(text)
    n, solid = len(words), max(len(raw) - int(kinds[6]), 0)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    entropy = math.log(n) - sum(c * math.log(c) for c in counts.values()) / n if n else 0.0
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    packed = len(zlib.compress(raw, 1)) if raw else 8
    return [
        math.log(n + 20.0),
        math.log((solid + 50.0) / (n + 10.0)),
        _logit(float(kinds[1]), solid, 0.03, 60.0),
        _logit(float(kinds[3]), solid, 0.005, 200.0),
        _logit(float(kinds[4]), solid, 0.002, 100.0),
        _logit(float(kinds[5]), solid, 0.03, 60.0),
        _logit(float(kinds[1] + kinds[2]), solid, 0.95, 60.0),
        _logit(float(len(counts)), n, 0.8, 20.0),
        _logit(float(len(lines) - len(set(lines))), len(lines), 0.03, 5.0),
        math.log((packed + 60.0) / (len(raw) + 120.0)),
        (entropy + 3.0) / (math.log1p(n) + 3.0),
        _logit(float(sum(len(x) < 40 for x in lines)), len(lines), 0.1, 4.0),
    ]


@dataclass
class QuadraticDiscriminant:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d, inverse Cholesky factors
    constants: np.ndarray  # 2, log prior minus half the log determinant

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        side = []
        for k in (0, 1):
            y = (z - self.means[k]) @ self.factors[k].T
            side.append(self.constants[k] - 0.5 * np.einsum("ij,ij->i", y, y))
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def _moments(rows: DataFrame, center: np.ndarray | None, scale: np.ndarray | None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum and sum of outer products, added up by Spark."""
    d = len(FEATURES)

    def state():
        sums = {}

        def each(b):
            for x, y in zip(b["x"], b["y"], strict=True):
                x = np.array(x)
                if center is not None:
                    x = np.clip((x - center) / scale, -CLIP, CLIP)
                s = sums.setdefault(int(y), np.zeros(1 + d + d * d))
                s += np.concatenate(([1.0], x, np.outer(x, x).ravel()))

        def finish():
            if sums:
                yield {"y": [y for y, s in sums.items() for _ in s], "at": [i for s in sums.values() for i in range(len(s))], "value": [float(v) for s in sums.values() for v in s]}

        each.finish = finish
        return each

    got = arrow_map(rows, None, "y int, at int, value double", state).groupBy("y", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for y in {r["y"] for r in got}:
        s = np.zeros(1 + d + d * d)
        for r in got:
            if r["y"] == y:
                s[r["at"]] = r["value"]
        out[y] = (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d))
    return out


def fit(rows: DataFrame, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> QuadraticDiscriminant | None:
    """From (x, y), a vector and 0 or 1, all rows counted; None if a class is missing.

    The first pass gives centre and scale, the second the classes' moments.
    """
    first = _moments(rows, None, None)
    if set(first) != {0, 1}:
        return None
    n = sum(m[0] for m in first.values())
    center = sum(m[1] for m in first.values()) / n
    spread = np.diag(sum(m[2] for m in first.values())) / n - center**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    d, parts = len(FEATURES), _moments(rows, center, scale)
    covs, means = {}, {}
    for y, (m, s, o) in parts.items():
        means[y] = s / m
        covs[y] = (o - np.outer(s, s) / m) / max(m - 1, 1)
    total = sum(m[0] for m in parts.values())
    pool = sum(covs[y] * parts[y][0] for y in parts) / total
    factors, constants = [], []
    for y in (0, 1):
        c = (1 - pooled) * covs[y] + pooled * pool
        c = (1 - identity) * c + identity * (np.trace(c) / d) * np.eye(d) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(parts[y][0] / total) - np.log(np.diag(low)).sum())
    return QuadraticDiscriminant(center, scale, np.array([means[0], means[1]]), np.array(factors), np.array(constants))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: about a hundred bytes that stand for the text from here on."""
    return arrow_map(docs.select("doc_id", "text"), lambda b: {"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]}, "doc_id long, x array<double>")


def training_rows(measured: DataFrame, labels: DataFrame, label: str, parts: int, out: int) -> DataFrame:
    """(x, y) of labelled rows whose fold isn't ``out``; rows that repeat an id count as often as they stand."""
    y = labels.where((fold("doc_id", parts) != out) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return written(measured.join(y, "doc_id").select("x", "y"), "quality-train")


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored like any other.  Labels other than 0 and 1
    are left aside; with a class missing every score is 0.5.  Rows that repeat
    an id are each scored; a null id is never held out and never learnt from.
    Texts are read once and never shuffled.
    """
    small_batches(docs.sparkSession)
    measured = written(vectors(docs), "quality-vectors")
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(measured, labels, "quality", parts, out)))

    def score(b):
        m = shared.value
        x = np.array(b["x"]).reshape(-1, len(FEATURES))
        return {"doc_id": b["doc_id"], "score": [0.5] * len(x) if m is None else m.score(x).tolist()}

    held = F.coalesce(fold("doc_id", parts) == out, F.lit(False))
    made = arrow_map(measured, score, "doc_id long, score double")
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, parts: int = 3, out: int = 1) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns kept.

    Text is scored where it stands: the score is a column of the same scan, so
    no join is needed and rows with null or repeated ids keep their own answers.
    """
    small_batches(docs.sparkSession)
    measured = written(vectors(docs), "quality-vectors")
    model = fit(training_rows(measured, labels, "quality", parts, out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def keep(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            if m is not None and b.num_rows:
                x = np.array([statistics(t) for t in b.column(columns.index("text")).to_pylist()])
                b = b.filter(pa.array(m.score(x) >= 0.5))
            yield b
            b = None
        give_back()

    return docs.mapInArrow(keep, docs.schema)
