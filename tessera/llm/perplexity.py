"""Quality rules: an n-gram language model and perplexity bands for each language.

The model is modified Kneser-Ney over characters, blanks between words included,
so that its n-grams of ORDER code points reach across words.  Spark counts the
n-grams of all documents and works out discounts, backoff weights and
probabilities by joins of n-grams with their contexts and their suffixes; nothing
of it is bounded by an alphabet or held in one process.  A document is scored
with its own part left out: an n-gram counts once less than it occurs, and one
that no other document holds counts as unseen, else junk would predict itself.

Scoring keeps the model in sorted arrays of 64-bit hashes with the log
probabilities beside them.  The HELD most frequent n-grams are broadcast; the
documents' other n-grams are joined to the rest of the model by hash.

A document whose mean log probability per character lies outside its language's
band is rejected; the band comes from the middle and the spread of all distinct
texts that pass the base rules, and widens for short texts, whose means vary more.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, bitmap, discard, in_bitmap, small_batches, written

ORDER = 5
#: So many n-grams are broadcast for scoring, 12 bytes each; which ones changes the work, not the results.
HELD = 1 << 20
#: A task that counts n-grams hands over what it has when it holds so many.
FLUSH = 1 << 20
#: The low bits of a hash are left to the number of a text in its batch.
SLOTS = 1 << 10
#: Least probability.
LEAST = 1e-12
#: Stands before and after every text; blanks of texts are single spaces.
MARK = "\n"
#: Half width of a band: this many robust deviations of the language, and of a text of its length.
BAND = 8.0
#: Deviations count as this at least, in log perplexity per character, also where all texts of a language agree.
LEAST_SPREAD = 0.005
#: Of fewer texts one lies at the middle and the lesser of two deviations is 0, whatever the texts are.
LEAST_TEXTS = 3
#: Log perplexities are rounded to so many places: their last bits depend on the batch a text is in.
PLACES = 9
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = frozenset("#*$%&|<>")


def grams(texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts between marks, which code points they end at, and where each text's begin; and the code points.

    A text of n characters has n + 1 n-grams, one that ends at each character and
    one at the mark after it.  The hash depends on the language too.
    """
    lead = MARK * (ORDER - 1)
    a = np.frombuffer("".join([lead + t + MARK for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter((len(t) + ORDER for t in texts), dtype=np.int64, count=len(texts))
    ends = np.ones(len(a), dtype=bool)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    for i in range(ORDER - 1):
        ends[begin + i] = False
    h = np.repeat(np.fromiter((_lang_seed(x) for x in langs), dtype=np.uint64, count=len(langs)), sizes)
    for i in range(ORDER - 1, -1, -1):  # the n-gram that ends at a place
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h[i:] += a[: len(a) - i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h &= ~np.uint64(SLOTS - 1)
    at = np.flatnonzero(ends)
    first = begin - np.arange(len(texts)) * (ORDER - 1)
    return h[at], at, first, a


_SEEDS: dict[str, int] = {}


def _lang_seed(lang: str) -> int:
    if lang not in _SEEDS:
        _SEEDS[lang] = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    return _SEEDS[lang]


def base_statistics(text: str | None, known: dict[str, int] | None = None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the words of a whole text and their numbers in ``known``."""
    text = text or ""
    words = WORD.findall(text)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif WORD.search(line):
                seen.add(line)
    known = {} if known is None else known
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return len(words), sum(map(len, words)), n_symbols, dup, repeated_words(words, ids=code), words, code


def repeated_words(words: list[str], width: int = 5, ids: np.ndarray | None = None) -> int:
    """Words in windows of ``width`` words that the text holds twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if ids is None:
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    a, most = ids, int(ids.max()) + 1
    rough = a[:n].astype(np.uint64)
    for i in range(1, width):
        rough = (rough ^ (rough >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[i : n + i].astype(np.uint64)
    rough.sort()
    if not (rough[1:] == rough[:-1]).any():
        return 0
    code = a[:n].copy()
    for i in range(1, width):  # exact: each step renumbers pairs of (prefix, next word)
        code = code * most + a[i : n + i]
        if i < width - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[at] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    start = np.flatnonzero(again)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, g, h, c): each n-gram of all documents, its hash and how often it occurs.

    Texts that repeat in one language count once, in tables of any size.  A text
    whose digest no other row has is counted where it stands; the others, and what
    the filter of their digests takes for one of them, meet by digest, one of each
    from a task, and are counted there.
    """
    known = docs.where("text IS NOT NULL").select("text", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    copied = written(known.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "perplexity-copied")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(copied, "key"))
    discard(copied)

    def pick(batches):
        sent = set()
        for b in batches:
            at = []
            for i, (lang, key) in enumerate(zip(b.column("lang").to_pylist(), b.column("key").to_pylist(), strict=True)):
                if in_bitmap(bits.value, key) and (lang, key) not in sent:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add((lang, key))
                    at.append(i)
            if at:
                yield b.take(pa.array(at))

    once = known.mapInArrow(pick, known.schema).dropDuplicates(["lang", "key"])
    counted = _counted(known, bits).unionByName(_counted(once, None))
    return counted.groupBy("lang", "h").agg(F.max("g").alias("g"), F.sum("c").alias("c"))


def _counted(known: DataFrame, left_out) -> DataFrame:
    """(lang, g, h, c), several rows for an n-gram, of the (text, lang, key) whose key isn't in the bitmap ``left_out``."""

    def state():
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def each(b):
            by_lang: dict[str, list[str]] = {}
            for text, lang, key in zip(b["text"], b["lang"], b["key"], strict=True):
                words = WORD.findall(text) if left_out is None or not in_bitmap(left_out.value, key) else ()
                if words:
                    by_lang.setdefault(lang, []).append(" ".join(words))
            out = {"lang": [], "g": [], "h": [], "c": []}
            for lang, texts in by_lang.items():
                h, at, _, a = grams(texts, [lang] * len(texts))
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                have, counts = held.get(lang, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
                place = np.minimum(np.searchsorted(have, h), max(len(have) - 1, 0))
                old = have[place] == h if len(have) else np.zeros(len(h), dtype=bool)
                counts[place[old]] += n[old]
                new = np.flatnonzero(~old)
                # a new n-gram goes out once with its text, and once more, at the end, with what was counted later
                ends = at[first[new]]
                text = np.lib.stride_tricks.sliding_window_view(a, ORDER)[ends - ORDER + 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                out["lang"] += [lang] * len(new)
                out["g"] += [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                out["h"] += h[new].view(np.int64).tolist()
                out["c"] += n[new].tolist()
                where = np.searchsorted(have, h[new])
                held[lang] = np.insert(have, where, h[new]), np.insert(counts, where, 0)
            if sum(len(k) for k, _ in held.values()) > FLUSH:
                for got in finish():
                    for k in out:
                        out[k] += got[k]
                held.clear()
            return out

        def finish():
            for lang, (keys, counts) in held.items():
                at = np.flatnonzero(counts)
                yield {"lang": [lang] * len(at), "g": [None] * len(at), "h": keys[at].view(np.int64).tolist(), "c": counts[at].tolist()}

        each.finish = finish
        return each

    return arrow_map(known, None, "lang string, g string, h long, c long", state)


def _counts(c: Column) -> list[Column]:
    """How many n-grams count 1, 2, and 3 or more."""
    return [F.sum((c == 1).cast("long")).alias("n1"), F.sum((c == 2).cast("long")).alias("n2"), F.sum((c >= 3).cast("long")).alias("n3")]


def _discount(c: Column) -> Column:
    """Of an n-gram that counts ``c``."""
    return F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).when(c == 1, F.col("d1")).otherwise(F.lit(0.0))


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from how many n-grams of an order count 1, 2, 3 and 4; half a count where that says nothing."""
    n = level.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"c{k}") for k in (1, 2, 3, 4)])
    y = F.when((F.col("c1") > 0) & (F.col("c2") > 0), F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(F.lit(0.5))
    d = [F.when(F.col(f"c{k}") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")))).otherwise(F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)]
    return n.select("lang", *d)


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(lang, n, g, c, p, q, z, h) of every n-gram of 1 to ORDER characters.

    ``c`` is its adjusted count: occurrences of the longest, different characters
    before it for the shorter ones.  ``p`` is its interpolated probability, ``q``
    the same if one occurrence is taken away, and ``z`` if all are, along with the
    shorter n-grams that occur nowhere else.  ``h`` is the hash of the longest.
    """
    levels = {ORDER: counted.select("lang", "g", "h", "c")}
    for n in range(ORDER - 1, 0, -1):
        above = levels[n + 1]
        levels[n] = written(above.groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count(F.lit(1)).alias("c")), "kn-level")
    # below the shortest: all characters of the language and one more are equally likely
    lower = levels[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p")).select("lang", F.lit("").alias("g"), "p", F.col("p").alias("q"))
    out = []
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("ctx", F.substring("g", 1, n - 1) if n > 1 else F.lit("")).withColumn("suf", F.substring("g", 2, n - 1) if n > 1 else F.lit(""))
        totals = level.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *_counts(F.col("c")))
        below = lower.select("lang", F.col("g").alias("suf"), F.col("p").alias("lp"), F.col("q").alias("lq"))
        rows = level.join(totals, ["lang", "ctx"]).join(below, ["lang", "suf"]).join(discounts(level), "lang")
        c = F.col("c")
        mass = lambda a, b, d: F.col("d1") * a + F.col("d2") * b + F.col("d3") * d
        p = (c - _discount(c) + mass(F.col("n1"), F.col("n2"), F.col("n3")) * F.col("lp")) / F.col("total")
        # one occurrence less: the n-gram counts one less, or is gone and so is one of its suffix
        n1, n2, n3 = F.col("n1"), F.col("n2"), F.col("n3")
        left = c - 1
        less = mass(n1 - (c == 1).cast("int") + (c == 2).cast("int"), n2 - (c == 2).cast("int") + (c == 3).cast("int"), n3 - (c == 3).cast("int"))
        under = F.when(c == 1, F.col("lq")).otherwise(F.col("lp"))
        q = F.when(F.col("total") > 1, (left - _discount(left) + less * under) / (F.col("total") - 1)).otherwise(under)
        gone = mass(n1 - (c == 1).cast("int"), n2 - (c == 2).cast("int"), n3 - (c >= 3).cast("int"))
        z = F.when(F.col("total") > c, gone * F.col("lq") / (F.col("total") - c)).otherwise(F.col("lq"))
        made = rows.select("lang", F.lit(n).alias("n"), "g", "c", F.greatest(p, F.lit(LEAST)).alias("p"), F.greatest(q, F.lit(LEAST)).alias("q"), F.greatest(z, F.lit(LEAST)).alias("z"), F.col("h") if n == ORDER else F.lit(None).cast("long").alias("h"))
        out.append(written(made, "kn-order"))
        lower = out[-1]
    discard(*[levels[n] for n in range(1, ORDER)])
    model = out[0]
    for o in out[1:]:
        model = model.unionByName(o)
    return model


@dataclass
class NGramModel:
    """Sorted hashes of n-grams of ORDER characters, how often they occur, and their log probabilities with one occurrence or all left out."""

    keys: np.ndarray
    counts: np.ndarray
    logq: np.ndarray
    logz: np.ndarray

    def cost(self, h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of n-grams that a document holds so many times each, and whether they are held here."""
        if not len(self.keys):
            return np.zeros(len(h)), np.zeros(len(h), dtype=bool)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ok = self.keys[i] == h
        logp = np.where(times >= self.counts[i], self.logz[i], self.logq[i]).astype(np.float64)
        return np.where(ok, times * logp, 0.0), ok


def held_part(longest: DataFrame, held: int) -> tuple[NGramModel, DataFrame | None]:
    """The most frequent n-grams as arrays, at most ``held``; and the rows of the rest, None if there are none.

    Whole counts go together: all n-grams that count at least some number are held.
    """
    histogram = {r["k"]: r["n"] for r in longest.groupBy(F.least("c", F.lit(4096)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    floor, total = 1 << 62, 0
    for k in sorted(histogram, reverse=True):
        if total + histogram[k] > held:
            break
        floor, total = k, total + histogram[k]
    rows = longest.where(F.col("c") >= floor).select("h", F.least("c", F.lit((1 << 31) - 1)).cast("int").alias("c"), "logq", "logz").toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    rest = longest.where(F.col("c") < floor) if floor > min(histogram, default=floor) else None
    return NGramModel(h[order], *[rows[c].to_numpy()[order] for c in ("c", "logq", "logz")]), rest


SCORED = "row long, doc_id long, lang string, digest binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, sum double, tail array<long>, times array<int>"


def scored(docs: DataFrame, longest: DataFrame, held: int = HELD) -> DataFrame:
    """Base statistics and mean negative log probability per character of every whole text; null without a word."""
    model, rest = held_part(longest, held)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def costs(norms: list[str], langs: list[str]):
        """Of each text: number of n-grams, summed log probabilities, and hashes and times of what isn't held."""
        h, _, first, _ = grams(norms, langs)
        sizes = np.diff(np.append(first, len(h)))
        pairs, times = np.unique(h | np.repeat(np.arange(len(norms), dtype=np.uint64), sizes), return_counts=True)
        h, owner = pairs & ~np.uint64(SLOTS - 1), (pairs & np.uint64(SLOTS - 1)).astype(np.int64)
        cost, ok = shared.value.cost(h, times)
        sums, missing = np.bincount(owner, weights=cost, minlength=len(norms)), np.flatnonzero(~ok)
        missing = missing[np.argsort(owner[missing], kind="stable")]
        edges = np.searchsorted(owner[missing], np.arange(len(norms) + 1))
        far = [(h[m].view(np.int64).tolist(), times[m].tolist()) for m in (missing[a:z] for a, z in zip(edges, edges[1:], strict=False))]
        return zip(sizes.tolist(), sums.tolist(), far, strict=True)

    def each(b):
        rows, norms, at = [], [], []
        known: dict[str, int] = {}
        for i, text in enumerate(b["text"]):
            *row, words, _ = base_statistics(text, known)
            rows.append(row)
            if words:
                norms.append(" ".join(words))
                at.append(i)
        n = len(b["text"])
        sums, sizes, tails, times = [None] * n, [0] * n, [[]] * n, [[]] * n
        for k in range(0, len(at), SLOTS):
            part = at[k : k + SLOTS]
            for i, (size, total, (h, count)) in zip(part, costs(norms[k : k + SLOTS], [b["lang"][i] for i in part]), strict=True):
                sizes[i], sums[i], tails[i], times[i] = size, total, h, count
        cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
        digest = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in b["text"]]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"row": [0] * n, "doc_id": b["doc_id"], "lang": b["lang"], "digest": digest, **dict(zip(names, cols, strict=True)), "n_grams": sizes, "sum": sums, "tail": tails, "times": times}

    found = arrow_map(docs.select("doc_id", "text", F.coalesce(F.col("lang"), F.lit("")).alias("lang")), each, SCORED)
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "perplexity-scored")
    more = F.lit(0.0)
    if rest is not None:
        asked = found.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("k"))
        logp = F.when(F.col("k") >= F.col("c"), F.col("logz")).otherwise(F.col("logq")).cast("double")
        late = asked.join(rest.hint("merge"), "h").groupBy("row").agg(F.sum(F.col("k") * logp).alias("more"))
        found, more = found.join(late, "row", "left"), F.coalesce("more", F.lit(0.0))
    ppl = F.round(-(F.col("sum") + more) / F.col("n_grams"), PLACES)
    return found.select("doc_id", "lang", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.when(F.col("n_grams") > 0, ppl).alias("log_ppl"))


def perplexity_rules(docs: DataFrame, band: float = BAND, held: int = HELD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, low, high) for every row.

    A null or empty text has no words and fails the base rules.  Rows with a null
    lang are modelled as a language of their own; one with fewer than LEAST_TEXTS
    distinct texts that pass the base rules has no spread and an unbounded band (null).  Copies of a text count once for the band,
    and its deviations as LEAST_SPREAD at least.  Rows that repeat a text in one
    language are judged alike.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    counted = written(count_ngrams(docs), "perplexity-ngrams")
    longest = kneser_ney(counted).where(F.col("n") == ORDER)
    longest = written(longest.select("h", "c", F.log("q").cast("float").alias("logq"), F.log("z").cast("float").alias("logz")), "perplexity-model")
    discard(counted)
    found = written(scored(docs, longest, held), "perplexity")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    good = found.where("NOT base_failed AND log_ppl IS NOT NULL").groupBy("lang", "digest").agg(F.min("log_ppl").alias("log_ppl"), F.min("word_chars").alias("word_chars"))
    good = written(good, "perplexity-texts")
    middle = good.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10000).alias("middle"))
    away = F.abs(F.col("log_ppl") - F.col("middle"))
    length = F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)).cast("double"))
    spread = good.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("middle").alias("middle"),
        F.count(F.lit(1)).alias("texts"),
        (1.4826 * F.percentile_approx(away, 0.5, 10000)).alias("wide"),
        (1.4826 * F.percentile_approx(away * length, 0.5, 10000)).alias("noise"),
    )
    half = F.lit(band) * F.greatest(F.lit(LEAST_SPREAD), F.col("wide"), F.col("noise") / length)
    half = F.when(F.col("texts") >= LEAST_TEXTS, half)
    out = found.join(F.broadcast(spread), "lang", "left")
    low, high = F.col("middle") - half, F.col("middle") + half
    verdict = F.coalesce((F.col("log_ppl") >= low) & (F.col("log_ppl") <= high), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(verdict, F.lit(True))).alias("kept"), "log_ppl", low.alias("low"), high.alias("high"),
    )
