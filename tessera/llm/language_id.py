"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts become normalised vectors of hashed 1- to 3-grams; document frequencies
cover all training rows.  Each language has several centroids, clustered from a
bounded sample by spherical k-means; a text takes the language of the centroid
with the highest cosine, and a text farther than that centroid's own members
are is marked as rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, hash_share, small_batches, written

DIMENSIONS = 8192
CENTROIDS = 4
#: Centroids are clustered from about this many documents of a language at most, chosen by a hash of their ids.
SAMPLE_BOUND = 1000
#: A text is rejected below its centroid's lowest hundredth of cosines, less this.
SLACK = 0.15
UNKNOWN = "und"

_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None without a letter.  Whatever isn't a letter counts as one gap."""
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _alpha()[a]
    if not letter.any():
        return None
    a = np.where(letter, a, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.concatenate(([32], a[keep], [32])).astype(np.uint64)
    pair = a[:-1] * np.uint64(1000003) + a[1:]
    triple = pair[:-1] * np.uint64(1000003) + a[2:]
    out = np.zeros(DIMENSIONS)
    for h in (a * np.uint64(0x9E3779B97F4A7C15), pair * np.uint64(0xC2B2AE3D27D4EB4F), triple * np.uint64(0x165667B19E3779F9)):
        out += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64), minlength=DIMENSIONS)
    return out


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text)
    if c is None:
        return None
    v = np.sqrt(c) * idf
    n = math.sqrt(float(v @ v))
    return v / n if n else None


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's centroid; fewer centroids if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


@dataclass
class CentroidModel:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray  # one row for each of langs
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, whether the distance rejects it."""
        v = vector(text, self.idf) if len(self.langs) else None
        if v is None:
            return UNKNOWN, 0.0, True
        cos = self.centroids @ v
        i = int(cos.argmax())
        return self.langs[i], float(min(1.0, max(0.0, cos[i]))), bool(cos[i] < self.floors[i])


def fit(rows: DataFrame, centroids: int = CENTROIDS, bound: int = SAMPLE_BOUND) -> CentroidModel:
    """From (doc_id, text, lang).  Document frequencies over all rows, centroids from the bounded sample."""

    def state():
        df, n = np.zeros(DIMENSIONS + 1), 0

        def each(b):
            for t in b["text"]:
                c = counts(t)
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1

        def finish():
            at = np.flatnonzero(df)
            if len(at):
                yield {"at": at.tolist(), "n": df[at].astype(np.int64).tolist()}

        each.finish = finish
        return each

    got = arrow_map(rows.select("text"), None, "at int, n long", state).groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in got:
        df[r["at"]] = r["n"]
    idf = np.log((df[-1] + 1.0) / (df[:-1] + 1.0)) + 1.0

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(bound / n)).otherwise(share)
    sample = written(rows.where(hash_share("doc_id") < share), "lang-sample")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = [v for t in pdf["text"] if (v := vector(t, idf)) is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        x = np.stack(x)
        c, at = spherical_kmeans(x, centroids)
        cos = np.einsum("ij,ij->i", x, c[at])
        floors = [float(np.quantile(cos[at == j], 0.01)) - SLACK if (at == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": [row.astype(np.float32).tolist() for row in c], "floor": floors})

    made = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, floor double").orderBy("lang").collect()
    return CentroidModel(idf, [r["lang"] for r in made], np.array([r["centroid"] for r in made]).reshape(-1, DIMENSIONS), np.array([r["floor"] for r in made]))


def languages(docs: DataFrame, parts: int = 4, out: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing can be learnt.  Rows with a null lang or a null id teach
    nothing; rows that repeat an id are judged one by one.
    """
    small_batches(docs.sparkSession)
    train = docs.where((fold("doc_id", parts) != out) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(fit(train, **options))

    def state():
        m = shared.value

        def each(b):
            got = [m.predict(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return each

    made = arrow_map(docs.select("doc_id", "text"), None, "doc_id long, lang_pred string, score double, rejected boolean", state)
    return made.select("doc_id", F.coalesce(fold("doc_id", parts) == out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
