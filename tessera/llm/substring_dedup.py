"""Exact removal of long repeated byte strings over the whole corpus.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere
else.  Each window of WIDTH bytes has an anchor, the leftmost least hash of its
GRAM-byte strings, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a run.  Only runs whose anchor string
occurs elsewhere go on, and equal runs are settled at once.

Of the other runs, the suffixes that start at their anchors, and the reversed
prefixes that end there, are sorted over the whole corpus: tasks exchange
front-coded sorted runs of them, and loser trees merge these without comparing a
known prefix again (``suffix_merge``).  Two runs share the window that begins l
bytes before the anchor if their prefixes share l bytes and their suffixes
WIDTH - l.  So a neighbour in either order shows windows that repeat, and the
longest prefix shared with a neighbour bounds those that can.  The few windows in
between, which no neighbour shows and no bound excludes, are settled by digests.

A suffix for every byte would send each byte about WIDTH / 8 times; anchors send
one suffix and one prefix for every 170 bytes.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, discard, hash_share, in_bitmap, join_groups, small_batches, written
from .suffix_merge import common_prefix, front_code, merge, read_run

WIDTH, GRAM = 400, 64
#: Windows start at most this far before their anchor.
REACH = WIDTH - GRAM
#: A task sorts so many runs at a time; a part of the order is to hold so many, of PARTS parts at most.
SORTED, PART_ROWS, PARTS = 20_000, 20_000, 1024
#: Splitters are drawn from so many sampled keys for each part.
SAMPLED = 16
#: Stands between the two sides of a key; no byte of UTF-8.
SEPARATOR = b"\xff"


def _text_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: anchor hash, anchor place, first and last window start."""
    n = len(raw)
    if n < WIDTH:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    h = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    step, b = 1, 0xD6E8FEB86659FD93
    while step < GRAM:  # h[i] becomes the hash of the 2 * step bytes from i
        g = h[: len(h) - step] * np.uint64(b)
        g += h[step:]
        h = g
        step, b = step * 2, b * b % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    w = REACH + 1
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = len(h) - w + 1
    pad = np.full((-len(packed)) % w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks = np.concatenate((packed, pad)).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
    last = np.concatenate((first[1:] - 1, [m - 1]))
    at = anchor[first]
    return h[at].view(np.int64), at, first, last


def _cover(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a union of half-open intervals."""
    out: list[list[int]] = []
    for a, z in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def order_keys(raw: bytes, before: int) -> tuple[bytes, bytes]:
    """Keys of a run's bytes, whose anchor stands at ``before``, in the orders of suffixes and of reversed prefixes.

    Either side follows the other, so that equal sides are spread over the parts too.
    """
    left, right = raw[:before][::-1], raw[before:]
    return right + SEPARATOR + left, left + SEPARATOR + right


def shared_sides(order: int, a: bytes, b: bytes, known: int) -> tuple[int, int]:
    """Lengths of the prefixes that two runs' reversed prefixes and suffixes share, from keys that share ``known`` bytes."""
    x, y = a.index(SEPARATOR), b.index(SEPARATOR)
    first = min(known, x, y)
    second = known - x - 1 if x == y and known > x else common_prefix(a[x + 1 :], b[y + 1 :])
    return (second, first) if order == 0 else (first, second)


_SHOWN = "rid long, order int, best int, low array<int>, high array<int>, edge binary, at_end boolean"


def neighbours(strings: DataFrame) -> DataFrame:
    """(rid, left, right, shown): the longest prefix and suffix that a run shares with any other, and what its neighbours show.

    ``strings`` has (rid, low, high, bytes) of distinct runs; ``shown`` lists
    offsets from and to which windows repeat.  Splitters come from a sample of
    bounded size, tasks exchange front-coded sorted runs, and the ends of the
    parts, two strings each, meet on the driver.
    """
    spark = strings.sparkSession
    total = strings.count()
    parts = max(1, min(PARTS, -(-total // PART_ROWS)))
    sample = strings.where(hash_share("rid") < min(1.0, SAMPLED * parts / max(total, 1))).select("high", "bytes").limit(2 * SAMPLED * parts).collect()
    splitters = []
    for order in (0, 1):
        keys = sorted(order_keys(r["bytes"], r["high"])[order] for r in sample)
        splitters.append([keys[len(keys) * i // parts] for i in range(1, parts)] if keys else [])
    shared = spark.sparkContext.broadcast(splitters)

    def sort_state():
        held: list[tuple[bytes, int, int]] = []

        def runs_of():
            out = {"order": [], "part": [], "run": []}
            for order in (0, 1):
                keyed = sorted((order_keys(raw, before)[order], rid) for raw, before, rid in held)
                keys = [k for k, _ in keyed]
                edges = [0, *[bisect.bisect_left(keys, x) for x in shared.value[order]], len(keys)]
                for part, (x, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    if x < z:
                        out["order"].append(order)
                        out["part"].append(part)
                        out["run"].append(front_code(keys[x:z], [i for _, i in keyed[x:z]]))
            held.clear()
            return out

        def each(b):
            held.extend(zip(b["bytes"], b["high"], b["rid"], strict=True))
            return runs_of() if len(held) >= SORTED else None

        def finish():
            if held:
                yield runs_of()

        each.finish = finish
        return each

    sent = arrow_map(strings.select("rid", "high", "bytes"), None, "order int, part int, run binary", sort_state)

    def merged(t: pa.Table) -> pa.Table:
        order, out = t["order"][0].as_py(), {x.split()[0]: [] for x in _SHOWN.split(", ")}
        before = None  # the last string: key, rid, and what it and its predecessor share

        def put(rid, sides, edge=None, at_end=None):
            out["rid"].append(rid)
            out["order"].append(order)
            out["best"].append(max((s[1 - order] for s in sides), default=0))
            out["low"].append([WIDTH - right for _, right in sides])
            out["high"].append([left for left, _ in sides])
            out["edge"].append(edge)
            out["at_end"].append(at_end)

        for key, rid, known in merge([read_run(x.as_py()) for x in t["run"]]):
            if before is None:
                put(rid, [], key, False)
                sides = []
            else:
                sides = [shared_sides(order, before[0], key, known)]
                put(before[1], before[2] + sides)
            before = (key, rid, sides)
        put(before[1], before[2])
        put(before[1], [], before[0], True)
        types = {"rid": pa.int64(), "order": pa.int32(), "best": pa.int32(), "low": pa.list_(pa.int32()), "high": pa.list_(pa.int32()), "edge": pa.binary(), "at_end": pa.bool_()}
        return pa.table({c: pa.array(out[c], types[c]) for c in out})

    shown = written(sent.groupBy("order", "part").applyInArrow(merged, _SHOWN), "repeat-shown")
    stitched = []
    for order in (0, 1):
        ends = sorted((bytes(r["edge"]), r["at_end"], r["rid"]) for r in shown.where((F.col("order") == order) & F.col("edge").isNotNull()).collect())
        for (a, _, i), (b, _, j) in zip(ends, ends[1:], strict=False):
            if i != j:  # the last of a part and the first of the next, or the only two of a part
                left, right = shared_sides(order, a, b, common_prefix(a, b))
                stitched += [(x, order, (left, right)[1 - order], [WIDTH - right], [left]) for x in (i, j)]
    more = spark.createDataFrame(stitched, "rid long, order int, best int, low array<int>, high array<int>")
    shown = shown.where("edge IS NULL").select("rid", "order", "best", "low", "high").unionByName(more)
    return shown.groupBy("rid").agg(
        F.max(F.when(F.col("order") == 1, F.col("best"))).alias("left"), F.max(F.when(F.col("order") == 0, F.col("best"))).alias("right"),
        F.flatten(F.collect_list(F.arrays_zip("low", "high"))).alias("shown"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_key, spans): (start, end) of bytes to remove, half-open, for each distinct text that has any; they may overlap.

    ``text_key`` is the BLAKE2b-128 digest of the text's bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    # Anchor hashes alone are counted first, so that only runs whose anchor occurs twice are described and sent.
    def hashes(b):
        seen: dict[int, int] = {}
        for t in b["text"]:
            for k in runs(t.encode("utf-8", "surrogatepass"))[0].tolist():
                seen[k] = seen.get(k, 0) + 1
        return {"kh": list(seen), "n": list(seen.values())}

    twice_ = written(arrow_map(texts, hashes, "kh long, n long").groupBy("kh").agg(F.sum("n").alias("n")).where("n > 1").select("kh"), "repeat-anchors")
    # big-endian bytes of the hash, as the bitmap reads them
    known = spark.sparkContext.broadcast(bitmap(twice_.select(F.unhex(F.lpad(F.hex("kh"), 16, "0")).alias("key")), "key"))
    discard(twice_)

    def anchors(b):
        out, bits_ = {k: [] for k in ("kh", "u", "dk", "at", "lo", "hi")}, known.value
        for t in b["text"]:
            raw = t.encode("utf-8", "surrogatepass")
            kh, at, lo, hi = runs(raw)
            if not len(kh):
                continue
            place = (kh.view(np.uint64) >> np.uint64(32)) % np.uint64(32 * len(bits_))
            pick = np.flatnonzero((bits_[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
            if not len(pick):
                continue
            dk = _text_key(raw)
            for k, a, x, z in zip(kh[pick].tolist(), at[pick].tolist(), lo[pick].tolist(), hi[pick].tolist(), strict=True):
                out["u"].append(hashlib.blake2b(raw[x : z + WIDTH], digest_size=16, salt=(a - x).to_bytes(8, "big")).digest())
                out["at"].append(a)
                out["lo"].append(x)
                out["hi"].append(z)
                out["kh"].append(k)
                out["dk"].append(dk)
        return out

    rows = written(arrow_map(texts, anchors, "kh long, u binary, dk binary, at int, lo int, hi int"), "repeat-runs")
    same = written(rows.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("kh").alias("kh"), F.min(F.struct("dk", "at", "lo", "hi")).alias("one")), "repeat-groups")
    equal = same.where("n > 1").select("u", "n")
    whole = join_groups(rows.select("u", "dk", "lo", "hi"), equal, "u", "n", "inner").select("dk", "lo", "hi").distinct()

    # anchors that stand in runs of several kinds, of which one is alone in its kind
    kinds = same.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("alone")).where("kinds > 1 AND alone > 0")
    kinds = written(kinds.select("kh", "kinds"), "repeat-kinds")
    open_ = join_groups(same.select("kh", "n", "one.*"), kinds, "kh", "kinds", "inner").select("kh", "dk", "at", "lo", "hi", (F.col("n") > 1).alias("settled"))
    open_ = written(open_.withColumn("rid", F.monotonically_increasing_id()), "repeat-open")

    bits = spark.sparkContext.broadcast(bitmap(open_.select("dk").distinct(), "dk"))

    def pick_state():
        have, sent = bits.value, set()

        def each(b):
            keys, raws = [], []
            for t in b["text"]:
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) >= WIDTH:
                    dk = _text_key(raw)
                    if in_bitmap(have, dk) and dk not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(dk)
                        keys.append(dk)
                        raws.append(raw)
            return {"dk": keys, "raw": raws}

        return each

    picked = arrow_map(texts, None, "dk binary, raw binary", pick_state).dropDuplicates(["dk"])
    asked = open_.groupBy("dk").agg(F.collect_list(F.struct("rid", "kh", "at", "lo", "hi", "settled")).alias("asked"))

    def strings_of(b):
        out = {k: [] for k in ("rid", "kh", "dk", "at", "low", "high", "settled", "bytes")}
        for dk, raw, asked in zip(b["dk"], b["raw"], b["asked"], strict=True):
            for q in asked:
                for k in ("rid", "kh", "at", "settled"):
                    out[k].append(q[k])
                out["dk"].append(dk)
                out["low"].append(q["at"] - q["hi"])
                out["high"].append(q["at"] - q["lo"])
                out["bytes"].append(raw[q["lo"] : q["hi"] + WIDTH])
        return out

    strings = arrow_map(picked.join(asked.hint("merge"), "dk").select("dk", "raw", "asked"), strings_of, "rid long, kh long, dk binary, at int, low int, high int, settled boolean, bytes binary")
    strings = written(strings, "repeat-strings")
    found = neighbours(strings)

    def judge(b):
        """Offsets of windows that repeat, that may, and of the latter those that nothing has shown yet."""
        out = {k: [] for k in ("least", "most", "shown", "unknown")}
        for low, high, left, right, shown in zip(b["low"], b["high"], b["left"], b["right"], b["shown"], strict=True):
            least, most = max(low, WIDTH - right), min(high, left)
            cover = _cover([(max(low, x["low"]), min(high, x["high"]) + 1) for x in shown if max(low, x["low"]) <= min(high, x["high"])])
            gaps, at = [], least
            for x, z in cover:
                if at < x:
                    gaps.append((at, x))
                at = max(at, z)
            if at <= most:
                gaps.append((at, most + 1))
            out["least"].append(least)
            out["most"].append(most)
            out["shown"].append([{"x": x, "z": z - 1} for x, z in cover])
            out["unknown"].append([{"x": x, "z": z - 1} for x, z in gaps])
        return {k: b[k] for k in ("rid", "kh", "dk", "at", "settled")} | out

    spans_ = "array<struct<x:int,z:int>>"
    judged = strings.select("rid", "kh", "dk", "at", "low", "high", "settled").join(found, "rid")
    judged = written(arrow_map(judged, judge, f"rid long, kh long, dk binary, at int, settled boolean, least int, most int, shown {spans_}, unknown {spans_}"), "repeat-judged")
    here = judged.where("NOT settled")
    partly = here.select("dk", "at", F.explode("shown").alias("s")).select("dk", "at", "s.x", "s.z")

    # windows that no neighbour shows and no bound excludes: all windows of their anchors that may repeat are compared by digest
    open_kinds = here.where("size(unknown) > 0").select("kh").distinct().join(kinds, "kh")
    open_kinds = written(open_kinds, "repeat-unknown")
    if not open_kinds.isEmpty():
        some = join_groups(judged.where("least <= most"), open_kinds, "kh", "kinds", "inner").select("rid", "least", "most", "unknown", F.col("settled").alias("known"))

        def windows(b):
            out = {k: [] for k in ("window", "rid", "offset", "wanted")}
            for rid, high, raw, least, most, known, unknown in zip(b["rid"], b["high"], b["bytes"], b["least"], b["most"], b["known"], b["unknown"], strict=True):
                for l in range(least, most + 1):
                    out["window"].append(hashlib.blake2b(raw[high - l : high - l + WIDTH], digest_size=16, salt=l.to_bytes(8, "big")).digest())
                    out["rid"].append(rid)
                    out["offset"].append(l)
                    out["wanted"].append(not known and any(u["x"] <= l <= u["z"] for u in unknown))
            return out

        seen = written(arrow_map(strings.select("rid", "high", "bytes").join(some, "rid"), windows, "window binary, rid long, offset int, wanted boolean"), "repeat-windows")
        twice = seen.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("asked")).where("n > 1 AND asked").select("window", "n")
        hits = join_groups(seen.where("wanted"), written(twice, "repeat-twice"), "window", "n", "inner").select("rid", F.col("offset").alias("x"), F.col("offset").alias("z"))
        partly = partly.unionByName(hits.join(here.select("rid", "dk", "at"), "rid").select("dk", "at", "x", "z"))
    partly = partly.select("dk", (F.col("at") - F.col("z")).alias("start"), (F.col("at") - F.col("x") + WIDTH).alias("end"))
    out = whole.select("dk", F.col("lo").alias("start"), (F.col("hi") + WIDTH).alias("end")).unionByName(partly).withColumnRenamed("dk", "text_key")
    out = written(out.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeat-spans")
    discard(rows, same, kinds, open_, strings, judged, open_kinds)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, changed boolean"
CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, changed boolean"


def remove_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """What is left of every row's whole text once repeated bytes are removed.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), the spans
    and remaining bytes, or a digest of these, and whether anything was removed.  Null texts count as empty;
    texts shorter than WIDTH bytes stay as they are; equal texts of WIDTH bytes
    or more are removed entirely in all rows, also where rows repeat an id.
    """
    spark = docs.sparkSession
    spans = repeated_spans(docs)
    bits = spark.sparkContext.broadcast(bitmap(spans, "text_key"))
    names = (("kept_sha256",) if digests else ("spans", "kept")) + ("changed",)
    schema = RESULT if digests else CLEANED

    def finish(doc_ids, raws, spans_of):
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", *names)}
        for i, raw, s in zip(doc_ids, raws, spans_of, strict=True):
            gone = _cover([(x["start"], x["end"]) for x in s])
            kept, last = [], 0
            for a, z in gone:
                kept.append(raw[last:a])
                last = z
            kept = b"".join([*kept, raw[last:]])
            out["doc_id"].append(i)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(gone))
            out["changed"].append(bool(gone))
            if digests:
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            else:
                out["spans"].append([{"start": a, "end": z} for a, z in gone])
                out["kept"].append(kept)
        return out

    # Texts without a span end here; only the others are sent to meet their spans, equal texts once.
    results = ", ".join(f"{x.split()[0]} {x.split(None, 1)[1]}" for x in schema.split(", ")[1:])
    first = f"doc_id long, text_key binary, raw binary, {results}"

    def split_state():
        have, sent = bits.value, set()

        def each(b):
            clean, held = [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                dk = _text_key(raw) if len(raw) >= WIDTH else None
                if dk is None or not in_bitmap(have, dk):
                    clean.append((i, raw))
                else:
                    held.append((i, dk, None if dk in sent else raw))
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(dk)
            got = finish([c[0] for c in clean], [c[1] for c in clean], [[] for _ in clean])
            n, rest = len(held), len(clean)
            out = {k: got[k] + [None] * n for k in got}
            out["text_key"] = [None] * rest + [h[1] for h in held]
            out["raw"] = [None] * rest + [h[2] for h in held]
            out["doc_id"] = [c[0] for c in clean] + [h[0] for h in held]
            return out

        return each

    split = written(arrow_map(docs.select("doc_id", "text"), None, first, split_state), "repeat-split")
    waiting = split.where("text_key IS NOT NULL")
    raws = waiting.where("raw IS NOT NULL").select("text_key", "raw").dropDuplicates(["text_key"])
    cut = arrow_map(raws.join(spans, "text_key", "left"), lambda b: finish(b["text_key"], b["raw"], [s or [] for s in b["spans"]]), schema.replace("doc_id long", "doc_id binary"))
    cut = cut.withColumnRenamed("doc_id", "text_key")
    copies = waiting.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    cut = written(cut.join(copies, "text_key"), "repeat-cut")
    late = join_groups(waiting.select("text_key", "doc_id"), cut, "text_key", "copies", "inner").drop("text_key", "copies")
    columns = [x.split()[0] for x in schema.split(", ")]
    return split.where("text_key IS NULL").select(*columns).unionByName(late.select(*columns))
