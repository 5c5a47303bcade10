"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become weighted sets of five-word shingles; consistent weighted samples
agree in two sets as often as their weighted Jaccard similarity says.  Bands of
samples propose pairs, samples that disagree too often discard most of the
wrong ones, and exact weighted Jaccard similarity decides.  Links form classes
by connected components.

Equal texts are one node from the start.  In a bucket of a wide band every node
is compared with one other, which joins most of what is alike.  In buckets of the
narrow bands, the nodes outside the largest class (strangers) meet all nodes of
the bucket, in cells of bounded size: first the pairs that agree best are
verified, then, with the classes that this gives, every agreeing pair of two
classes, inside its cell, so that no pair is sent anywhere.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, bitmap, discard, in_bitmap, join_groups, small_batches, written
from .components import connected_components, merged

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES = 64
#: Wide bands of consecutive samples; narrow bands of random subsets of samples.
WIDE, NARROW, NARROW_ROWS = 16, 64, 8
#: Pairs whose samples agree so rarely that this share of links does are not verified.
LOST = 1e-4
#: A cell holds about so many strangers and so many nodes of a bucket.
STRANGERS, BLOCK = 128, 256
#: Of each stranger and cell so many pairs, those that agree best, are verified before all the others.
BEST = 2
#: Texts of more shingles than this are verified pair by pair, so that a cell's memory stays bounded.
LONG = 8192
#: Word document frequencies are kept by hash in a table of this size.
IDF_SLOTS = 1 << 16
_POOL_BITS = 12


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as texts have needed them."""

    base = 0xD6E8FEB86659FD93
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(cls.base, -1, 1 << 64)
            cls.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, cls.base, dtype=np.uint64))))
            cls.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, inverse, dtype=np.uint64))))
        return cls.up, cls.down


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each blank-separated word, from running sums over the bytes."""
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    a = np.frombuffer(raw, dtype=np.uint8)
    solid = np.empty(len(a) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not(_BLANK[a], out=solid[1:-1], casting="unsafe")
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.upto(len(a) + 1)
    sums = np.empty(len(a) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _pools() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    n = 1 << _POOL_BITS
    r = np.maximum(rng.gamma(2.0, 1.0, n), 1e-3).astype(np.float32)
    return r, (1.0 / r).astype(np.float32), rng.random(n, dtype=np.float32), np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)


_R, _INVERSE_R, _BETA, _LOG_C = _pools()
_SEEDS = np.random.default_rng(7).integers(1, 2**32, SAMPLES, dtype=np.int64).astype(np.uint32)[:, None]
_SUBSETS = [tuple(int(i) for i in np.random.default_rng(100 + j).choice(SAMPLES, NARROW_ROWS, replace=False)) for j in range(NARROW)]


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sorted packed shingles of word hashes: 48 bits of hash, 16 bits of weight in 1/1024.

    The weight is (1 + ln tf) times the mean idf of the shingle's words, which
    lies between 1 and 2.  A text of fewer than five words is one shingle.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = min(SHINGLE, n)
    m = n - width + 1
    h = np.zeros(m, dtype=np.uint64)
    w = idf[(words & np.uint64(IDF_SLOTS - 1)).astype(np.int64)]
    weight = np.zeros(m, dtype=np.float64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : m + i]
        weight += w[i : m + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h, first, tf = np.unique(h >> np.uint64(16), return_index=True, return_counts=True)
    q = np.minimum(np.rint(1024.0 * (1.0 + np.log(tf)) * weight[first] / width), 65535).astype(np.uint64)
    return (h << np.uint64(16)) | q


def signature(packed: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples, each folded to 32 bits.

    For each sample and shingle, r and beta come from one pool and c from
    another, indexed by a hash of both; the same shingle gets the same numbers in
    every text.
    """
    best = np.full(SAMPLES, np.inf, dtype=np.float32)
    out = np.zeros(SAMPLES, dtype=np.uint64)
    rows = np.arange(SAMPLES)
    shift, mask = np.uint32(32 - _POOL_BITS), np.uint32((1 << _POOL_BITS) - 1)
    for i in range(0, len(packed), 512):
        p = packed[i : i + 512]
        log_w = np.log((p & np.uint64(65535)).astype(np.float32) / np.float32(1024))
        h = (p >> np.uint64(32)).astype(np.uint32) ^ (p >> np.uint64(16)).astype(np.uint32)
        x = h[None, :] ^ _SEEDS
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        a = (x & mask).astype(np.intp)
        r, beta = _R.take(a), _BETA.take(a)
        t = _INVERSE_R.take(a)
        t *= log_w
        t += beta
        np.floor(t, out=t)
        beta -= t  # beta - t
        beta -= np.float32(1)
        beta *= r  # -r (t - beta + 1)
        x >>= shift
        beta += _LOG_C.take(x.astype(np.intp))
        at = beta.argmin(axis=1)
        low = beta[rows, at]
        value = (p[at] >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) + t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = np.where(low < best, value >> np.uint64(32), out)
        best = np.minimum(best, low)
    return out.astype(np.uint32)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two packed shingle arrays; 0 if one is empty."""
    return _overlap(*_unpacked(a), *_unpacked(b))


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles, weights and their sum."""
    weight = (packed & np.uint64(65535)).astype(np.int64)
    return packed >> np.uint64(16), weight, int(weight.sum())


def _overlap(a: np.ndarray, wa: np.ndarray, ta: int, b: np.ndarray, wb: np.ndarray, tb: int) -> float:
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    least = int(np.minimum(wa[hit], wb[at[hit]]).sum())
    return least / (ta + tb - least)


def least_agreement(threshold: float) -> int:
    """The most samples that all but LOST of the pairs of similarity ``threshold`` agree in."""
    below = 0.0
    for n in range(SAMPLES + 1):
        below += math.comb(SAMPLES, n) * threshold**n * (1 - threshold) ** (SAMPLES - n)
        if below > LOST:
            return n
    return SAMPLES


def word_idf(texts: DataFrame) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) / ln(N + 2) by word hash, from all documents: 2 for a word of one document, 1 for one of all.

    Divided by ln(N + 2), a word of a given share of rarity weighs the same in
    corpora of every size, and an edited word cannot outweigh what copies share.
    """

    def state():
        df, mark = np.zeros(IDF_SLOTS + 1, dtype=np.int64), np.zeros(IDF_SLOTS, dtype=bool)

        def each(b):
            for t in b["text"]:
                mark[(word_hashes(_raw(t)) & np.uint64(IDF_SLOTS - 1)).astype(np.int64)] = True
                at = np.flatnonzero(mark)
                mark[at] = False
                df[at] += 1
                df[-1] += 1

        def finish():
            at = np.flatnonzero(df)
            yield {"at": at.tolist(), "n": df[at].tolist()}

        each.finish = finish
        return each

    got = arrow_map(texts.select("text"), None, "at int, n long", state).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(IDF_SLOTS + 1)
    df[got["at"].to_numpy()] = got["n"].to_numpy()
    n = df[-1]
    return 1.0 + np.log((n + 1) / (np.minimum(df[:-1], n) + 1)) / np.log(n + 2)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _node(raw: bytes) -> bytes:
    """What texts with the same words share."""
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def _bands(sigs: np.ndarray, columns: list[tuple[int, ...]], base: int) -> np.ndarray:
    """64-bit bucket keys of each row of ``sigs`` in each band; the low bits are the number of the band."""
    out = np.empty((len(sigs), len(columns)), dtype=np.int64)
    for k, cols in enumerate(columns):
        h = np.full(len(sigs), base + k, dtype=np.uint64)
        for c in cols:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + sigs[:, c].astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = ((h & ~np.uint64(NARROW - 1)) | np.uint64(k)).view(np.int64)
    return out


def _buckets(nodes: DataFrame, columns: list[tuple[int, ...]], base: int, name: str) -> DataFrame:
    """(bucket, node, first) of buckets with two nodes or more."""

    def explode(b):
        sigs = np.frombuffer(b"".join(b["sig"]), dtype=np.uint32).reshape(-1, SAMPLES)
        keys = _bands(sigs, columns, base)
        return {"bucket": keys.ravel().tolist(), "node": [x for x in b["node"] for _ in columns]}

    rows = written(arrow_map(nodes.select("node", "sig"), explode, "bucket long, node binary"), f"{name}-rows")
    sizes = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, f"{name}-sizes")
    out = written(join_groups(rows, sizes, "bucket", "n", "inner").select("bucket", "node", "first"), f"{name}-members")
    discard(rows, sizes)
    return out


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough."""
    sa = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    sb = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))

    def keep(t):
        x, y = (np.frombuffer(b"".join(t[c]), dtype=np.uint32).reshape(-1, SAMPLES) for c in ("sa", "sb"))
        at = np.flatnonzero((x == y).sum(axis=1) >= least)
        return {"a": [t["a"][i] for i in at], "b": [t["b"][i] for i in at]}

    return arrow_map(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb"), keep, "a binary, b binary")


def _cells(narrow: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, block, chunk, node, class, sig, size, here, asks, stranger): the cells of all buckets of two classes or more.

    A bucket's nodes are dealt to blocks and its strangers, the nodes outside its
    largest class, to chunks; a cell holds the nodes of a block (``here``) and
    the strangers of a chunk (``asks``), so that every stranger meets every node
    in one cell, and a task's rows are bounded whatever the size of the bucket.
    """
    classed = written(narrow.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("class")), "minhash-classed")
    classes = classed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("main")).where("classes > 1")
    mixed = written(mixed.select("bucket", "n", F.col("main.class").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / STRANGERS).alias("chunks")), "minhash-mixed")
    rows = join_groups(classed, mixed, "bucket", "n", "inner").join(nodes, "node").withColumn("stranger", F.col("class") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), "chunks"))
    cells = F.expr("""
        transform(sequence(0L, chunks - 1), c -> named_struct('block', own, 'chunk', c, 'here', true, 'asks', stranger AND c = turn))
    """)
    others = F.expr("""
        transform(filter(sequence(0L, blocks - 1), b -> stranger AND b <> own), b -> named_struct('block', b, 'chunk', turn, 'here', false, 'asks', true))
    """)
    return rows.select("bucket", "node", "class", "sig", "size", "stranger", F.explode(F.concat(cells, others)).alias("cell")).select("bucket", "cell.*", "node", "class", "sig", "size", "stranger")


class _Rows:
    """Columns of the rows of whole cells, sorted by cell and node, and where the cells begin."""

    def __init__(self, t: pa.Table, starts: list[int]):
        self.starts, self.ends = starts, [*starts[1:], len(t)]
        self.place = [t[c].to_numpy() for c in ("bucket", "block", "chunk")]
        self.sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(-1, SAMPLES)
        self.names, self.size = t["node"].to_pylist(), t["size"].to_numpy()
        self.kind = t["class"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.stranger, self.here, self.asks = (t[c].to_numpy() for c in ("stranger", "here", "asks"))
        self.vecs = t["vec"] if "vec" in t.column_names else None

    def pairs(self, a: int, z: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strangers, others, and number and places of agreeing samples, of the agreeing pairs of two classes in rows a to z.

        Of two strangers the first by name asks.
        """
        q, i = a + np.flatnonzero(self.asks[a:z]), a + np.flatnonzero(self.here[a:z])
        ok = (self.kind[q][:, None] != self.kind[i][None, :]) & ~(self.stranger[i][None, :] & (i[None, :] < q[:, None]))
        x, y = np.nonzero(ok)
        q, i = q[x], i[y]
        same = self.sigs[q] == self.sigs[i]
        agree = same.sum(axis=1)
        good = np.flatnonzero(agree >= least)
        return q[good], i[good], agree[good], same[good]

    def first_met(self, a: int, z: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same pairs, but each only in the first of the narrow bands that bring it together."""
        q, i, agree, same = self.pairs(a, z, least)
        band = int(self.place[0][a]) & (NARROW - 1)
        if len(q) and band:
            new = (same.astype(np.float32) @ _IN_SUBSET[:, :band]).max(axis=1) < NARROW_ROWS - 0.5
            q, i, agree = q[new], i[new], agree[new]
        return q, i, agree


_IN_SUBSET = np.zeros((SAMPLES, NARROW), dtype=np.float32)
for _j, _s in enumerate(_SUBSETS):
    _IN_SUBSET[list(_s), _j] = 1.0

_CELL = ("bucket", "block", "chunk")


def _by_cell(cells: DataFrame, each, schema: str) -> DataFrame:
    """``each(rows)`` over whole cells; it returns columns of ``schema``."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        held = []
        for b in batches:
            t = pa.Table.from_batches([*held, b])
            keys = np.stack([t[c].to_numpy() for c in _CELL])
            starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            held = t.slice(int(starts[-1]) if len(starts) else 0).to_batches()
            if len(starts):
                yield made(t.slice(0, int(starts[-1])), [0, *starts[:-1].tolist()])
        if held:
            yield made(pa.Table.from_batches(held), [0])

    def made(t, starts):
        got = each(_Rows(t, starts))
        return pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "node").mapInArrow(run, schema)


def _best_pairs(cells: DataFrame, least: int) -> DataFrame:
    """(a, b): of each stranger and cell the BEST agreeing pairs."""

    def best(r):
        a, b = [], []
        for start, end in zip(r.starts, r.ends, strict=True):
            q, i, agree, _ = r.pairs(start, end, least)
            order = np.lexsort((i, -agree, q))
            q, i = q[order], i[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            for x, y in zip(q[rank < BEST].tolist(), i[rank < BEST].tolist(), strict=True):
                a.append(min(r.names[x], r.names[y]))
                b.append(max(r.names[x], r.names[y]))
        return {"a": a, "b": b}

    return _by_cell(cells, best, "a binary, b binary").distinct()


def _needed(cells: DataFrame, least: int) -> DataFrame:
    """Rows of cells with a pair to verify there, and (other not null) pairs with a long text."""
    names = (*_CELL, "node", "other", "class", "here", "asks", "stranger")

    def need(r):
        out = {n: [] for n in names}
        for start, end in zip(r.starts, r.ends, strict=True):
            q, i, _ = r.first_met(start, end, least)
            long = (r.size[q] > LONG) | (r.size[i] > LONG)
            rows = np.unique(np.concatenate((q[~long], i[~long])))
            for x in rows.tolist():
                out["node"].append(r.names[x])
                out["other"].append(None)
            for x, y in zip(q[long].tolist(), i[long].tolist(), strict=True):
                out["node"].append(r.names[x])
                out["other"].append(r.names[y])
            both = np.concatenate((rows, q[long]))
            for k, v in (*zip(_CELL, r.place, strict=True), ("class", r.kind), ("here", r.here), ("asks", r.asks), ("stranger", r.stranger)):
                out[k] += v[both].tolist()
        return out

    return _by_cell(cells, need, "bucket long, block long, chunk long, node binary, other binary, class int, here boolean, asks boolean, stranger boolean")


_LINK = "src binary, dst binary, similarity double"


def _cell_links(needed: DataFrame, nodes: DataFrame, vectors: DataFrame, threshold: float, least: int) -> DataFrame:
    """Links between the classes of each cell; pairs whose classes its other links have joined are left out."""
    rows = needed.where("other IS NULL").drop("other").join(nodes, "node").join(vectors, "node")

    def judge(r):
        src, dst, sim = [], [], []
        for start, end in zip(r.starts, r.ends, strict=True):
            q, i, agree = r.first_met(start, end, least)
            known, into = {}, {}

            def root(k, into=into):
                while into.get(k, k) != k:
                    k = into[k]
                return k

            def vec(k, known=known):
                if k not in known:
                    known[k] = _unpacked(np.frombuffer(r.vecs[k].as_py(), dtype=np.uint64))
                return known[k]

            order = np.lexsort((i, q, -agree))
            for x, y in zip(q[order].tolist(), i[order].tolist(), strict=True):
                a, b = root(int(r.kind[x])), root(int(r.kind[y]))
                if a == b:
                    continue
                s = _overlap(*vec(x), *vec(y))
                if s >= threshold:
                    into[a] = b
                    src.append(r.names[x])
                    dst.append(r.names[y])
                    sim.append(s)
        return {"src": src, "dst": dst, "similarity": sim}

    return _by_cell(rows, judge, _LINK)


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, similarity) of the pairs that are similar enough."""
    va = vectors.select(F.col("node").alias("a"), F.col("vec").alias("va"))
    vb = vectors.select(F.col("node").alias("b"), F.col("vec").alias("vb"))

    def judge(t):
        s = [weighted_jaccard(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(t["va"], t["vb"], strict=True)]
        at = [i for i, x in enumerate(s) if x >= threshold]
        return {"src": [t["a"][i] for i in at], "dst": [t["b"][i] for i in at], "similarity": [s[i] for i in at]}

    return arrow_map(pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb"), judge, "src binary, dst binary, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, node, kept, class_size, links, similarity) for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class; ``kept`` marks that row.
    ``node`` tells texts apart that differ in more than the blanks between words.
    Texts with the same words are in one class, so all texts without words are
    (null counts as empty); a text of fewer than five words is like no other.
    ``links`` counts the verified links of the row's text to other texts (enough of
    them to join its class, not all pairs), ``similarity`` is the highest of them,
    null without one.
    Null ids count last; rows that repeat the smallest id are all marked; an empty
    table gives an empty result.
    """
    out = _classes(docs, threshold)
    return out.select("doc_id", "class_id", F.hex("node").alias("node"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "class_size", "links", "similarity")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node, class, class_id, class_size, links, similarity) for every row; ``class`` tells classes apart that share a smallest id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(word_idf(texts))

    def sign(b):
        table, nodes, sigs = idf.value, [], []
        for t in b["text"]:
            raw = _raw(t)
            words = word_hashes(raw)
            nodes.append(_node(raw))
            sigs.append(signature(weighted_shingles(words, table)).tobytes() if len(words) else None)
        return {"doc_id": b["doc_id"], "node": nodes, "sig": sigs}

    signed = written(arrow_map(texts, sign, "doc_id long, node binary, sig binary"), "minhash-signed")
    groups = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    groups = written(groups, "minhash-groups")
    nodes, least = groups.where("sig IS NOT NULL").select("node", "sig"), least_agreement(threshold)

    wide = [tuple(range(i * (SAMPLES // WIDE), (i + 1) * (SAMPLES // WIDE))) for i in range(WIDE)]
    members = _buckets(nodes, wide, 0, "minhash-wide")
    near = written(members.select("node").distinct().join(nodes, "node"), "minhash-near")
    bits = spark.sparkContext.broadcast(bitmap(near, "node"))

    def vector_state():
        table, have, sent = idf.value, bits.value, set()

        def each(b):
            out, vecs = [], []
            for t in b["text"]:
                raw = _raw(t)
                node = _node(raw)
                if in_bitmap(have, node) and node not in sent:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(node)
                    out.append(node)
                    vecs.append(weighted_shingles(word_hashes(raw), table).tobytes())
            return {"node": out, "vec": vecs}

        return each

    vectors = arrow_map(texts.select("text"), None, "node binary, vec binary", vector_state)
    vectors = written(vectors.groupBy("node").agg(F.first("vec").alias("vec")), "minhash-vectors")
    sized = written(near.join(vectors.select("node", (F.length("vec") / 8).cast("long").alias("size")), "node"), "minhash-sized")

    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    found = [written(_verified(_agreeing(pairs, near, least), vectors, threshold), "minhash-links")]
    discard(members)
    labels = connected_components(found[0])

    narrow = _buckets(near, _SUBSETS, 1000, "minhash-narrow").select("bucket", "node")
    # first the best pairs, one by one, which join most of what is left; then all others, cell by cell
    found.append(written(_verified(_best_pairs(_cells(narrow, labels, sized), least), vectors, threshold), "minhash-links"))
    labels = merged(labels, found[1])
    needed = written(_needed(_cells(narrow, labels, sized), least), "minhash-needed")
    far = needed.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    rest = _cell_links(needed, sized, vectors, threshold, least).unionByName(_verified(far, vectors, threshold))
    found.append(written(rest, "minhash-links"))
    labels = merged(labels, found[2])

    links = found[0].unionByName(found[1]).unionByName(found[2])
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity"))
    links = links.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("links"), F.max("similarity").alias("similarity"))
    classed = groups.join(labels, "node", "left").join(links, "node", "left").select("node", "first_id", "copies", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "similarity")
    classed = written(classed, "minhash-linked")
    heads = written(classed.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")), "minhash-heads")
    out = written(join_groups(classed, heads, "class", "members", "inner").drop("members"), "minhash-classes")
    discard(vectors, near, sized, needed, classed, heads, *found)
    return join_groups(signed.select("doc_id", "node"), out.drop("first_id"), "node", "copies", "inner").drop("copies")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class, all columns of ``docs`` kept; one row for each class.

    The kept ids are joined to the texts by id and node, the one place where
    texts are shuffled, as classes may share an id or have none; rows of a class
    that repeat its kept id leave one row.
    """
    keep = _classes(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = keep.select(F.col("doc_id").alias("__keep"), F.col("node").alias("__of"), F.col("class").alias("__class")).distinct()

    def nodes(texts: pa.Array) -> pa.Array:
        return pa.array([_node(_raw(t)) for t in texts.to_pylist()], pa.binary())

    marked = docs.withColumn("__node", F.arrow_udf(nodes, T.BinaryType())("text"))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__node") == F.col("__of")))
    once = Window.partitionBy("__class").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)
