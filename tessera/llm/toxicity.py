"""Toxic passages by maximum-scoring segment search.

Words and word beginnings get log-odds of toxic against clean documents under
an informative Dirichlet prior.  A linear scan then finds every maximal scoring
segment of a text (the disjoint passages that no longer or shorter neighbour
beats), Karlin-Altschul statistics tell which passages chance would not give in
a text of that length, and the significant ones add up to the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, hash_share, small_batches, written

TOKEN = re.compile(r"\w+")
#: The classifier is fitted on about this many labelled documents of a class at most, chosen by a hash of their ids.
LABELLED_BOUND = 20_000
#: Lengths of word beginnings that stand in for words without weights, longest first.
PREFIXES = (8, 7, 6, 5, 4)
#: Weight of the prior in pseudo-documents; least z and least log-odds of a scoring token, and fewest toxic documents that hold it.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_TOXIC = 50.0, 3.5, 2.0, 3
#: What a token without evidence costs: it keeps the expected score of clean text below zero.
DRIFT = 0.2
#: Log-odds count as this at most, so that one word alone proves little.
MOST_SCORE = 8.0


def segments(scores: list[tuple[int, float]], drift: float, length: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) in linear time.

    ``scores`` lists the positive tokens (position, score) of a text of
    ``length`` tokens; every other token counts ``-drift``.  Segments are
    joined backwards over a stack while that raises their score.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, prefix sum before, prefix sum after
    gained = 0.0
    for n, (at, s) in enumerate(scores):
        before = gained - drift * (at - n)
        gained += s
        first, last, low, high = at, at, before, before + s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class ToxicModel:
    weights: dict[str, float]
    drift: float
    lam: float  # Karlin-Altschul lambda and K of the background
    k: float
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.stems = {w[1:5] for w in self.weights if w[0] == "^"}

    def _scores(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and place and score of those that score."""
        get, found = self.weights.get, []
        words = TOKEN.findall((text or "").lower())
        for i, w in enumerate(words):
            s = get(w)
            if s is None and self.stems and w[:4] in self.stems:
                s = next((x for n in PREFIXES if (x := get("^" + w[:n]))), None)
            if s:
                found.append((i, s))
        return len(words), found

    def highest(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of the best segment, 0 without one."""
        n, found = self._scores(text)
        return n, max((s for _, _, s in segments(found, self.drift, n)), default=0.0)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens; (first, last token, score in nats beyond chance) of each significant passage."""
        n, found = self._scores(text)
        if not found:
            return n, []
        chance = math.log(self.k * max(n, 1) + 1.0)
        out = [(a, b, self.lam * s - chance) for a, b, s in segments(found, self.drift, n)]
        return n, [x for x in out if x[2] > 0]

    def evidence(self, text: str | None) -> float:
        return sum(s for _, _, s in self.passages(text)[1])

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.evidence(text) + self.offset))))


def _words(text: str | None) -> Counter:
    return Counter(TOKEN.findall((text or "").lower()))


def sampled(rows: DataFrame, bound: int = LABELLED_BOUND) -> DataFrame:
    """About ``bound`` rows of each y at most, by a hash of doc_id: the same rows each time."""
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    keep = F.lit(False)
    for y, c in n.items():
        keep = F.when(F.col("y") == y, hash_share("doc_id") < bound / c).otherwise(keep)
    return rows.where(keep)


def fit(rows: DataFrame) -> ToxicModel | None:
    """From (doc_id, text, y); None if a class is missing."""
    rows = written(rows, "toxic-train")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if set(sizes) != {0, 1}:
        return None

    clean, toxic = sizes[0], sizes[1]

    def weigh(features, least_z: float = LEAST_Z) -> list:
        """The tokens that ``features`` draws from a document and that clearly speak for toxicity.

        ``features`` gives tokens with how often they occur; documents count for
        the odds, occurrences in clean ones for the background.
        """

        def state():
            counts: dict[str, list[int]] = {}

            def each(b):
                for text, y in zip(b["text"], b["y"], strict=True):
                    for w, n in features(text).items():
                        c = counts.get(w)
                        if c is None:
                            c = counts[w] = [0, 0, 0]
                        c[y] += 1
                        c[2] += 0 if y else n

            def finish():
                if counts:
                    yield {"token": list(counts), **{k: [c[i] for c in counts.values()] for i, k in enumerate(("clean", "toxic", "times"))}}

            each.finish = finish
            return each

        counted = arrow_map(rows.select("text", "y"), None, "token string, clean long, toxic long, times long", state).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "times")])
        prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / F.lit(clean + toxic)
        odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR - F.col(y) - prior))
        scored = counted.where("toxic > 0").withColumn("weight", odds("toxic", toxic) - odds("clean", clean))
        scored = scored.withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
        return scored.where((F.col("z") >= least_z) & (F.col("weight") >= LEAST_ODDS) & (F.col("toxic") >= LEAST_TOXIC)).orderBy(F.desc("z"), "token").collect()

    best = weigh(_words)
    known = {r["token"] for r in best}

    def beginnings(text):
        out: Counter = Counter()
        for w, times in _words(text).items():
            if w not in known:
                out.update({"^" + w[:n]: times for n in PREFIXES if len(w) >= n})
        return out

    # beginnings are judged by the other words alone, else a toxic word would taint all that begin like it
    best += weigh(beginnings, LEAST_Z + 1.5)
    weights = {r["token"]: min(MOST_SCORE, float(r["weight"])) for r in best}

    # Background: how often a token of a clean document scores, and how high its best segments come, by clean documents.
    lengths = arrow_map(rows.where("y = 0").select("text"), lambda b: {"n": [sum(_words(t).values()) for t in b["text"]]}, "n long")
    tokens = float(lengths.agg(F.sum("n")).first()[0] or 0) + 1.0
    model = ToxicModel(weights, DRIFT, _lambda([((r["times"] + 0.5) / tokens, weights[r["token"]]) for r in best], DRIFT), 1.0)

    def highest(b):
        n, m = zip(*[model.highest(t) for t in b["text"]], strict=True) if b["text"] else ((), ())
        return {"n": list(n), "below": [k * math.exp(-model.lam * x) for k, x in zip(n, m, strict=True)]}

    # The highest of n tokens' segments stays below x with probability exp(-K n exp(-lambda x)): the likeliest K.
    got = arrow_map(rows.where("y = 0").select("text"), highest, "n long, below double").where("n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum("below").alias("below")).first()
    model.k = got["texts"] / got["below"] if got["below"] else 1.0

    def evidence(b):
        return {"y": b["y"], "x": [model.evidence(t) for t in b["text"]]}

    got = arrow_map(rows.select("text", "y"), evidence, "y int, x double").select("y", F.round("x", 1).alias("x")).groupBy("y", "x").count().collect()
    model.slope, model.offset = _logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([float(r["count"]) for r in got]))
    return model


def _lambda(rates: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    if not rates:
        return 1.0
    p, s = np.array([r[0] for r in rates]), np.array([r[1] for r in rates])
    rest = max(1e-9, 1.0 - p.sum())
    f = lambda x: float((p * np.exp(x * s)).sum() + rest * math.exp(-drift * x) - 1.0)
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic with a small ridge, both classes weighing alike; the slope is positive."""
    x = np.minimum(x, 50.0)
    w = n * np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum())
    a = np.array([0.5, -1.0])
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ a, -50, 50)))
        g = rows.T @ (w * (p - y)) + 1e-4 * np.array([a[0], 0.0])
        h = (rows * (w * p * (1 - p))[:, None]).T @ rows + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(h, g)
        a = a - np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-9:
            break
    return (max(float(a[0]), 1e-3), float(a[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0, bound: int = LABELLED_BOUND) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) for every row of ``docs``.

    ``passages`` holds first and last token and the score of each significant
    passage.  Null and empty texts have none and get the lowest score; with a
    class missing from the labels every score is 0.  Labels other than 0 and 1
    are left aside, rows that repeat an id are scored one by one, and a null id
    is never held out and never learnt from.
    """
    small_batches(docs.sparkSession)
    y = labels.where((fold("doc_id", parts) != out) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    model = fit(docs.select("doc_id", "text").join(F.broadcast(sampled(y, bound)), "doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def state():
        m = shared.value

        def each(b):
            got = [(0, []) if m is None else m.passages(t) for t in b["text"]]
            xs = [sum(s for _, _, s in p) for _, p in got]
            scores = [0.0 if m is None else 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, m.slope * x + m.offset)))) for x in xs]
            return {"doc_id": b["doc_id"], "score": scores, "n_passages": [len(p) for _, p in got], "passages": [[{"first": a, "last": z, "score": s} for a, z, s in p] for _, p in got]}

        return each

    schema = "doc_id long, score double, n_passages int, passages array<struct<first:int,last:int,score:double>>"
    scored = arrow_map(docs.select("doc_id", "text"), None, schema, state)
    held = F.coalesce(fold("doc_id", parts) == out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")
