"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks, so that equal passages of different
documents give equal chunks wherever they stand.  Chunks that occur more than
once are encoded once and joined back by their digest; all others are encoded
where they are.  What lies between two chunks is repaired by re-encoding a
window over the join until the window's ids agree with the ids of both sides.

Three passes: count chunk digests; encode documents without shared chunks and
send the others' chunks away; encode the shared chunks once and assemble.

A vocabulary whose tokens may span blanks (byte-level ones join a blank to the
word after it) has no chunks to reuse, and each text is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, in_bitmap, join_groups, small_batches, written

#: A cut where the hash of the last WINDOW characters has these bits clear: 2048 characters apart on average.
WINDOW, CUT_BITS = 32, 11
LEAST_CHUNK, MOST_CHUNK = 256, 8192
#: Where a text may be cut without a token changing: the tokenizer drops these and no token spans them.
SYNC = " \n"
WORDS_CACHED = 300_000

_TOKENIZERS: dict[str, tuple] = {}


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """One vocabulary in one process; words met before are remembered up to a bound."""

    def __init__(self, path: str):
        # one thread a worker: Spark runs as many workers as there are cores, and threads hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        self.words: dict[str, bytes] = {}
        #: whether chunks may be encoded apart
        self.reusable = breaks_at_blanks(self.tok)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Encoder(path)
        return _TOKENIZERS[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        """The library's own encoding of each text."""
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same, by words: no token of this tokenizer spans a blank or line end."""
        known = self.words
        if len(known) > WORDS_CACHED:
            known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn({w for ws in split for w in ws if w not in known})
        return [b"".join([known[w] for w in ws]) for ws in split]

    def _learn(self, new: set[str]) -> None:
        """Remember words, many to a call, with a bar between them; words that hold a bar go alone."""
        alone = [w for w in new if "|" in w or not w]
        self.words.update(zip(alone, self.plain(alone), strict=True))
        rest = [w for w in new if w and "|" not in w]
        bar, size = np.frombuffer(self.plain(["|"])[0], dtype=self.kind), self.kind().itemsize
        for part in [rest[i : i + 256] for i in range(0, len(rest), 256)]:
            ids = self.plain([" | ".join(part)])[0]
            at = np.flatnonzero(self.array(ids) == bar[0]) if len(bar) == 1 else np.zeros(0, dtype=np.int64)
            if len(at) != len(part) - 1:  # a vocabulary in which a bar isn't a token of its own
                self.words.update(zip(part, self.plain(part), strict=True))
                continue
            starts, ends = [0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(ids)]
            for w, a, z in zip(part, starts, ends, strict=True):
                self.words[w] = ids[a:z]

    def array(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, dtype=self.kind)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) where the vocabulary names no decoder: token names joined by blanks."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids, skip_special_tokens=False)
        return " ".join([self.names[i] for i in ids])


#: Normalizers that treat the two sides of a blank alike, wherever it stands.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Nmt"}


def breaks_at_blanks(tok) -> bool:
    """Whether no token of this tokenizer holds or spans a blank or line end, so that a text may be encoded in parts there."""
    spec = json.loads(tok.to_str())
    flat = lambda x, key: [] if x is None else [y for z in x[key] for y in flat(z, key)] if x["type"] == "Sequence" else [x]
    for n in flat(spec["normalizer"], "normalizers"):
        blanks = n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        if n["type"] not in _LOCAL and not blanks:
            return False
    for t in spec["added_tokens"]:
        if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]):
            return False
    first = next(iter(flat(spec["pre_tokenizer"], "pretokenizers")), None)
    drops = first is not None and (first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (first["type"] == "Split" and first["behavior"] == "Removed"))
    if not drops or spec["model"]["type"] != "BPE":
        return False
    names = lambda x: [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(x)]
    sides = ["a", "B7", "é", "'s", "'", "-", "x.", "...", "\u4e2d", "\u0301", "7", "_", "don't"]
    return all(names(a + c + b) == names(a) + names(b) for a in sides for b in sides for c in (" ", "\n", "  ", " \n"))


def cuts(text: str) -> list[int]:
    """Where chunks end.  Depends only on the WINDOW characters before, but for the least and most length of a chunk."""
    n = len(text)
    if n <= LEAST_CHUNK:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step, b = 1, 0xD6E8FEB86659FD93
    while step < WINDOW:  # h[i] becomes the polynomial hash of the 2 * step characters up to i
        g = h * np.uint64(b)
        h = h.copy()
        h[step:] += g[:-step]
        b, step = b * b % (1 << 64), step * 2
    at = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for c in at.tolist():
        while c - last > MOST_CHUNK:
            last += MOST_CHUNK
            out.append(last)
        if c - last >= LEAST_CHUNK:
            out.append(c)
            last = c
    while n - last > MOST_CHUNK:
        last += MOST_CHUNK
        out.append(last)
    if n > last:
        out.append(n)
    return out


def parts(text: str) -> tuple[list[str], list[str]]:
    """Gaps and cores: gap, core, gap, ..., core, gap make up the text.

    A core is what a chunk holds between its first and last sync character,
    both included; a chunk without two of them is all gap.
    """
    gaps, cores, pending, last = [], [], "", 0
    for c in cuts(text):
        chunk = text[last:c]
        last = c
        a = min((i for s in SYNC if (i := chunk.find(s)) >= 0), default=-1)
        z = max(chunk.rfind(s) for s in SYNC)
        if a < 0 or a == z:
            pending += chunk
        else:
            gaps.append(pending + chunk[:a])
            cores.append(chunk[a : z + 1])
            pending = chunk[z + 1 :]
    return [*gaps, pending], cores


def digest(core: str) -> bytes:
    return hashlib.blake2b(core.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def first_word(core: str) -> str:
    return core[:80].replace("\n", " ").split(" ")[1] if " " in core[1:80] or "\n" in core[1:80] else core[1:].replace("\n", " ").split(" ")[0]


def last_word(core: str) -> str:
    return core[:-1].replace("\n", " ").rsplit(" ", 1)[-1]


def assemble(enc: Encoder, docs: list[tuple[list[str], list[tuple[bytes, str, str]]]]) -> list[bytes]:
    """Ids of documents from gaps and encoded cores (ids, first word, last word).

    Each gap is re-encoded together with the words next to it.  The window's
    ids must begin with the ids of the word before and end with those of the
    word after, and these must be what the cores hold there; a document where
    that fails is None, for ``repaired``.
    """
    windows, words = [], []
    for gaps, cores in docs:
        for i, gap in enumerate(gaps):
            before, after = cores[i - 1][2] if i else "", cores[i][1] if i < len(cores) else ""
            windows.append((before + " " if i else "") + gap + (" " + after if i < len(cores) else ""))
            words += [before, after]
    made, sides = enc.plain(windows), enc.encode(words)
    out, k = [], 0
    for gaps, cores in docs:
        pieces, good = [], True
        for i in range(len(gaps)):
            w, a, z = made[k], sides[2 * k], sides[2 * k + 1]
            k += 1
            good = good and w.startswith(a) and w.endswith(z) and len(w) >= len(a) + len(z)
            if i:
                good = good and cores[i - 1][0].endswith(a)
            pieces.append(w[len(a) : len(w) - len(z)])
            if i < len(cores):
                good = good and cores[i][0].startswith(z)
                pieces.append(cores[i][0])
        out.append(b"".join(pieces) if good else None)
    return out


def repaired(enc: Encoder, text: str) -> bytes:
    """Ids of a text whose chunk joins disagree: each window takes in whole cores on the side that disagrees, until both agree.

    The widest window is the whole text.
    """
    gaps, cores = parts(text)
    ids, n = enc.plain(cores), len(cores)
    windows: list[tuple[int, int, bytes]] = []  # first and last gap re-encoded, their ids
    i = 0
    while i <= n:
        low = high = i
        while True:
            while windows and windows[-1][1] >= low:
                low = min(low, windows.pop()[0])
            before, after = last_word(cores[low - 1]) if low else "", first_word(cores[high]) if high < n else ""
            body = "".join([gaps[k] + (cores[k] if k < high else "") for k in range(low, high + 1)])
            w = enc.plain([(before + cores[low - 1][-1] if low else "") + body + (cores[high][0] + after if high < n else "")])[0]
            a, z = enc.plain([before, after])
            left = not low or (a and w.startswith(a) and ids[low - 1].endswith(a))
            right = high == n or (z and w.endswith(z) and ids[high].startswith(z))
            if left and right and len(w) >= len(a) + len(z):
                break
            both = left and right  # the sides overlap
            low, high = low - (both or not left) if low else 0, high + (both or not right) if high < n else n
        windows.append((low, high, w[len(a) : len(w) - len(z)]))
        i = high + 1
    return b"".join([w + (ids[high] if high < n else b"") for _, high, w in windows])


ENCODED = "doc_id long, n_tokens long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _results(enc: Encoder, doc_ids: list, ids: list[bytes], form: str) -> dict[str, list]:
    lists = [enc.array(x).tolist() for x in ids]
    out = {"doc_id": doc_ids, "n_tokens": [len(x) for x in lists]}
    if form == ENCODED:
        return out | {"ids": lists}
    out["ids_sha256"] = [hashlib.sha256(" ".join([enc.digits[i] for i in x]).encode()).hexdigest() for x in lists]
    out["decoded_sha256"] = [hashlib.sha256(enc.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in lists]
    return out


def encode(docs: DataFrame, path: str | None = None, form: str = ENCODED) -> DataFrame:
    """The ids of every row's whole text, as the tokenizers library gives them without special tokens.

    ``form`` ENCODED returns doc_id, n_tokens and ids; DIGESTS returns digests of
    the ids and of the decoded text instead.  Documents whose chunk joins
    disagree are repaired (see ``repaired``).  A null text counts as empty and
    has no tokens; rows that repeat an id are encoded one by one; an empty
    table gives an empty result.
    """
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = "n_tokens long, ids_sha256 string, decoded_sha256 string" if form == DIGESTS else "n_tokens long, ids array<int>"
    if not Encoder.of(path).reusable:

        def whole_state():
            enc = Encoder.of(path)
            return lambda b: _results(enc, b["doc_id"], enc.plain(b["text"]), form)

        return arrow_map(texts, None, f"doc_id long, {done}", whole_state)

    def count(b):
        hs: dict[bytes, int] = {}
        for t in b["text"]:
            for core in parts(t)[1]:
                h = digest(core)
                hs[h] = hs.get(h, 0) + 1
        return {"h": list(hs), "n": list(hs.values())}

    counted = arrow_map(texts.select("text"), count, "h binary, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = written(counted.where("n > 1"), "bpe-shared")
    bits = spark.sparkContext.broadcast(bitmap(shared, "h"))

    names = [x.split()[0] for x in done.split(", ")]
    schema = f"kind int, doc_id long, {done}, gaps array<string>, cores array<struct<h:binary,ids:binary,first:string,last:string>>, h binary, text string, key binary"
    blank = {n: None for n in ("doc_id", *names, "gaps", "cores", "h", "text", "key")}

    def split_state():
        enc, sent, have = Encoder.of(path), set(), bits.value

        def each(b):
            rows, whole, later, texts_of = [], [], [], []
            cut = [(i, t, *parts(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)]
            own = []
            for i, t, gaps, cores in cut:
                hs = [digest(c) for c in cores]
                marks = [h if in_bitmap(have, h) else None for h in hs]
                (later if any(marks) else whole).append((i, t, gaps, cores, marks))
                own += [c for c, m in zip(cores, marks, strict=True) if m is None]
                for c, m in zip(cores, marks, strict=True):
                    if m is not None and m not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(m)
                        rows.append(blank | {"kind": 2, "h": m, "text": c})
            ids = dict(zip(own, enc.encode(own), strict=True))
            made = assemble(enc, [(gaps, [(ids[c], first_word(c), last_word(c)) for c in cores]) for _, _, gaps, cores, _ in whole])
            made = [m if m is not None else repaired(enc, w[1]) for m, w in zip(made, whole, strict=True)]
            got = _results(enc, [w[0] for w in whole], made, form)
            for k in range(len(whole)):
                rows.append(blank | {"kind": 0, "doc_id": got["doc_id"][k], **{n: got[n][k] for n in names}})
            for i, t, gaps, cores, marks in later:
                rows.append(blank | {"kind": 1, "doc_id": i, "key": digest(t), "gaps": gaps, "cores": [{"h": m, "ids": None if m else ids[c], "first": first_word(c), "last": last_word(c)} for c, m in zip(cores, marks, strict=True)]})
            return {n: [r[n] for r in rows] for n in ("kind", *blank)}

        return each

    split = written(arrow_map(texts, None, schema, split_state).withColumn("row", F.monotonically_increasing_id()), "bpe-split")

    def encode_state():
        enc = Encoder.of(path)
        return lambda b: {"h": b["h"], "ids": enc.encode(b["text"])}

    once = split.where("kind = 2").select("h", "text").dropDuplicates(["h"])
    # chunks that only the filter took for shared have no count: they occur once
    book = arrow_map(once, None, "h binary, ids binary", encode_state)
    book = written(book.join(shared, "h", "left").select("h", "ids", F.coalesce("n", F.lit(1)).alias("n")), "bpe-book")

    waiting = split.where("kind = 1").select("row", "doc_id", "key", "gaps", "cores")
    refs = waiting.select("row", F.posexplode("cores").alias("at", "core")).where("core.h IS NOT NULL").select("row", "at", F.col("core.h").alias("h"))
    found = join_groups(refs, book, "h", "n", "inner").groupBy("row").agg(F.collect_list(F.struct("at", "ids")).alias("found"))

    def assemble_state():
        enc = Encoder.of(path)

        def each(b):
            docs_in, sources = [], []
            for gaps, cores, found in zip(b["gaps"], b["cores"], b["found"], strict=True):
                ids = {f["at"]: f["ids"] for f in found}
                docs_in.append((gaps, [(c["ids"] if c["h"] is None else ids[k], c["first"], c["last"]) for k, c in enumerate(cores)]))
            made = assemble(enc, docs_in)
            out = _results(enc, b["doc_id"], [m or b"" for m in made], form)
            for k, m in enumerate(made):
                if m is None:
                    out["n_tokens"][k] = None
            return out | {"key": b["key"]}

        return each

    joined = waiting.join(found, "row").select("doc_id", "key", "gaps", "cores", "found")
    late = written(arrow_map(joined, None, f"doc_id long, {done}, key binary", assemble_state), "bpe-late")
    failed = late.where("n_tokens IS NULL").select("doc_id", "key")
    out = split.where("kind = 0").select("doc_id", *names).unionByName(late.where("n_tokens IS NOT NULL").drop("key"))
    return out if failed.isEmpty() else out.unionByName(_repair(texts, failed, path, form, done))


def _repair(texts: DataFrame, failed: DataFrame, path: str, form: str, done: str) -> DataFrame:
    """Results of the documents whose joins failed, from their texts, which are found by digest."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(failed, "key"))

    def find(b):
        keys = [digest(t) for t in b["text"]]
        at = [k for k, key in enumerate(keys) if in_bitmap(bits.value, key)]
        return {"key": [keys[k] for k in at], "text": [b["text"][k] for k in at]}

    def state():
        enc = Encoder.of(path)
        return lambda b: _results(enc, b["doc_id"], [repaired(enc, t) for t in b["text"]], form)

    found = arrow_map(texts.select("text"), find, "key binary, text string").dropDuplicates(["key"])
    return arrow_map(failed.join(found, "key").select("doc_id", "text"), None, f"doc_id long, {done}", state)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids); null ids decode to an empty text."""
    path = path or default_path()

    def state():
        enc = Encoder.of(path)
        return lambda b: {"doc_id": b["doc_id"], "decoded": [enc.decode(x or []) for x in b["ids"]]}

    return arrow_map(encoded.select("doc_id", "ids"), None, "doc_id long, decoded string", state)
