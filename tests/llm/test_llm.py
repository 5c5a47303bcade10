"""Text operators against brute force on small fixtures, with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, components, exact_dedup, language_id, minhash, mixing, perplexity, quality, substring_dedup, suffix_merge, toxicity, url_filter
from tessera.llm.common import bitmap, in_bitmap, join_groups

from ..conftest import ROOT, SF, same_rows

WORDS = re.compile("[^ \t\n\x0b\x0c\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORDS.findall(t or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text."""
    long = prose(99, 6000)
    rows = [
        (1, "a b c d e f g h", "en", "s1"), (2, "a  b\tc d e\nf g h", "en", "s2"), (3, None, "en", "s1"), (4, "", None, None), (5, " \n ", "fr", "s1"),
        (6, "1234 5678 !!!", "en", "s3"), (None, "a b c d e f g h", "en", "s1"), (7, long, "en", "s2"), (8, long + " tail", "en", "s2"),
        (9, "x", None, None), (9, "x", None, None), (10, prose(1, 80), "en", "s1"), (11, prose(1, 80) + " more", "en", "s3"), (12, "<|endoftext|> it's A 42nd test é́", "en", "s1"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def clashing(df):
    """Extra columns with names that operators use themselves."""
    for c in ("size", "key", "digest", "node", "n", "h", "row", "kept", "score", "taken", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_tasks_give_their_memory_back():
    """What a task of long texts and many small objects took is with the system again when it ends, as its worker lives on."""
    code = """
import re, sys
from types import SimpleNamespace
import pyarrow as pa
from pyspark.sql.types import StringType, StructField, StructType
from tessera.llm.common import arrow_map

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(8):
        yield pa.RecordBatch.from_pydict({"text": pa.array([f"{k} {i} " * 40 for i in range(40_000)])})

run = arrow_map(SimpleNamespace(mapInArrow=lambda f, schema: f), lambda b: {"text": [t.upper() for t in b["text"]]}, StructType([StructField("text", StringType())]))
next(run(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])))
before = mb()
for _ in run(batches()):
    pass
del _
print(mb() - before)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    assert grown < 16


# op1


def brute_segments(scores):
    """All maximal segments by their definition: the best segment, then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (i, j, total)
    if best is None:
        return []
    i, j, s = best
    return [*brute_segments(scores[:i]), (i, j, s), *[(a + j + 1, b + j + 1, x) for a, b, x in brute_segments(scores[j + 1 :])]]


def test_segments_are_all_maximal_ones():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 14)
        at = sorted(r.sample(range(n), r.randint(0, n)))
        found = [(i, r.choice([0.37, 1.13, 2.71, 0.91])) for i in at]
        dense = [-0.41] * n
        for i, s in found:
            dense[i] = s
        got = toxicity.segments(found, 0.41, n)
        want = brute_segments(dense)
        assert [(a, b, pytest.approx(s)) for a, b, s in got] == want


def test_toxicity(spark, odd, empty, labels):
    bad = ["vile", "nasty"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 2]} " + prose(i + 500, 10) if i % 3 == 0 else ""), "en", "s") for i in range(240)]
    y = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(clashing(frame(spark, rows)), y).toPandas()
    assert len(got) == 240 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ((held.doc_id % 3 == 0).astype(int) == held.predicted).mean() > 0.97
    assert toxicity.toxicity_scores(odd, y).count() == 14
    assert toxicity.toxicity_scores(empty, labels.limit(0)).count() == 0
    assert set(toxicity.toxicity_scores(odd, labels.limit(0)).toPandas().predicted) == {0}


# op2


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        norm = re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_dedup(spark, odd, empty, docs):
    for df in (odd, clashing(docs), empty):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = exact_dedup.dedup_report(df).collect()
        assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == brute_exact(rows)
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({re.sub("[ \t\n\x0b\x0c\r]+", " ", r.text or "") for r in odd.collect()})


def test_digest_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    a, b = frame(spark, [(1, "x y", "en", "s"), (2, "z", "en", "s")]), frame(spark, [(5, "x  y", "en", "s"), (6, "new", "en", "s"), (7, "new", "en", "s")])
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert {r.doc_id for r in exact_dedup.dedup_report(a, first).where("kept").collect()} == {1, 2}
    first.close()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup_report(b, again).collect()} == {(5, 1, False), (6, 6, True), (7, 6, False)}
    assert again.read().count() == 3 and exact_dedup.DigestIndex(spark, path).buckets == 4
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    plan = again.read().join(again.read().hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# op3


def test_languages(spark, odd, empty, docs):
    got = language_id.languages(clashing(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    out = {r.doc_id: r for r in language_id.languages(odd.where("doc_id IS NOT NULL")).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (3, 4, 5, 6)) and out[1].lang_pred != "und"
    assert language_id.languages(empty).count() == 0


def brute_counts(text):
    """Hashed n-gram counts, one n-gram at a time."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    chars = [" "]
    for i, c in enumerate(letters):
        if c != " " or (i and letters[i - 1] != " "):
            chars.append(c)
    chars = [ord(c) for c in [*chars, " "]]
    out, mask = Counter(), (1 << 64) - 1
    for n, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * 1000003 + c) & mask
            h = h * seed & mask
            out[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 51] += 1
    return out


def test_languages_by_brute_force(spark, docs):
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").limit(120).collect()
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = language_id.fit(df.where(F.col("doc_id").isin([r.doc_id for r in train])))
    made = [brute_counts(r.text) for r in train if any(c.isalpha() for c in r.text)]
    df_of, n = Counter(k for c in made for k in c), len(made)
    assert all(model.idf[k] == pytest.approx(math.log((n + 1) / (df_of[k] + 1)) + 1) for k in range(language_id.DIMENSIONS))
    got = {r.doc_id: r for r in language_id.languages(df).collect()}
    for r in rows:
        v = {k: math.sqrt(c) * model.idf[k] for k, c in brute_counts(r.text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * c[k] for k, x in v.items()) / size for c in model.centroids]
        assert got[r.doc_id].score == pytest.approx(max(cos), abs=1e-6) and got[r.doc_id].lang_pred == model.langs[int(np.argmax(cos))]


def test_samples_of_huge_groups_are_not_empty(spark):
    """A share of one in 10^9 still takes rows: hashes are told apart to 53 bits."""
    from tessera.llm.common import hash_share

    x = spark.range(20_000).select(hash_share("id").alias("x")).toPandas().x
    assert x.between(0, 1).all() and x.nunique() == 20_000 and abs(x.mean() - 0.5) < 0.01


# op4


def test_bpe_equals_the_library(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    shared = prose(3, 2500)
    copies = frame(spark, [(100 + i, prose(i, 300) + " " + shared + prose(i, 20), "en", "s") for i in range(6)])
    for df in (odd, clashing(docs), copies, empty):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        want = sorted((str(i), tok.encode(t, add_special_tokens=False).ids) for i, t in rows)
        got = bpe.encode(df)
        assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == want
        texts = sorted(tok.decode(ids, skip_special_tokens=False) for _, ids in want)
        assert sorted(r.decoded for r in bpe.decode(got).collect()) == texts
    dig = {r.doc_id: r for r in bpe.encode(copies, form=bpe.DIGESTS).collect()}
    one = tok.encode(copies.first().text, add_special_tokens=False).ids
    assert dig[100].n_tokens == len(one) and dig[100].ids_sha256 == hashlib.sha256(" ".join(map(str, one)).encode()).hexdigest()


def test_joins_that_disagree_are_repaired(spark, monkeypatch):
    """A vocabulary that joins blanks to words, taken by force for one that breaks there, still gives the library's ids."""
    from tokenizers import Tokenizer

    path = bpe.default_path().replace("word_bpe_49k", "byte_bpe_50k")
    tok = Tokenizer.from_file(path)
    shared = prose(3, 2500)
    rows = [(i, prose(i, 300) + " " + shared + prose(i, 20), "en", "s") for i in range(4)] + [(9, "one  two\n three", "en", "s"), (10, None, "en", "s")]
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    assert not bpe.Encoder.of(path).reusable and bpe.Encoder.of(bpe.default_path()).reusable
    assert {r.doc_id: r.ids for r in bpe.encode(frame(spark, rows), path).collect()} == want
    forced = bpe.Encoder(path)
    for _, t, *_ in rows:
        assert forced.array(bpe.repaired(forced, t or "")).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_failed_joins_find_their_texts(spark, monkeypatch):
    """Documents whose shared chunks don't join come back through their texts, copies and null ids too."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    texts = [prose(i, 100) + " " + prose(3, 2500) for i in range(3)]
    failed = spark.createDataFrame([(1, bytearray(bpe.digest(texts[0]))), (None, bytearray(bpe.digest(texts[0]))), (2, bytearray(bpe.digest(texts[1])))], "doc_id long, key binary")
    all_ = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = bpe._repair(all_, failed, bpe.default_path(), bpe.ENCODED, "n_tokens long, ids array<int>").collect()
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert {r.doc_id: r.ids for r in got} == {1: ids[0], None: ids[0], 2: ids[1]} and len(got) == 3


def test_windows_widen_until_they_agree():
    """Cores whose ids are wrong at their ends are taken into the window, and the rest is kept."""
    enc = bpe.Encoder(bpe.default_path())
    text = " ".join(prose(k, 800) for k in range(4))
    cores = bpe.parts(text)[1]
    want, right, bad = enc.plain([text])[0], enc.plain, {cores[1], cores[4], cores[-1]}
    enc.plain = lambda texts: [b"\0\0" if t in bad else x for t, x in zip(texts, right(texts), strict=True)]
    assert len(cores) > 6 and bpe.repaired(enc, text) == want


def test_chunks_are_defined_by_content():
    body = prose(8, 6000)
    a, b = set(bpe.parts(body)[1]), set(bpe.parts(prose(9, 40) + " " + body)[1])
    assert len(a & b) >= len(a) - 2
    for t in (body, "", "x" * 30_000, " " * 500, "ab\n" * 5000):
        gaps, cores = bpe.parts(t)
        assert "".join(g + c for g, c in zip(gaps, [*cores, ""], strict=True)) == t


# op5


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        level = left / w if w else 0
        new = {s for s in sizes if s not in capped and 3 * sizes[s] <= level * weight[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= new


def test_mixing(spark, odd, empty, docs):
    for df in (docs, odd.where("doc_id IS NOT NULL"), clashing(docs)):
        size = [(r.doc_id, r.source, len(words(r.text))) for r in df.collect()]
        per = Counter()
        for _, s, n in size:
            per[s] += n
        want = brute_targets(dict(per))
        got = mixing.mix(df).collect()
        assert sorted((r.doc_id, str(r.source), r.size) for r in got) == sorted((i, str(s), n) for i, s, n in size)
        taken = Counter()
        for r in got:
            assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) < 1 for s in per)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df, range_rows=7).collect()))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(docs).collect())


# op6


def brute_base(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_perplexity_rules(spark, odd, empty, docs):
    for df in (docs, odd, clashing(docs)):
        want = sorted((str(r.doc_id), *brute_base(r.text)) for r in df.collect())
        got = perplexity.perplexity_rules(df).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert perplexity.perplexity_rules(empty).count() == 0
    strange = frame(spark, [(i, prose(i, 100), "en", "s") for i in range(60)] + [(99, " ".join("qxzj" * 3 for _ in range(3)) + " " + " ".join(random.Random(i).choice("QZXJKVW#") * 7 + str(i) for i in range(90)), "en", "s")])
    kept = {r.doc_id: r.kept for r in perplexity.perplexity_rules(strange).collect()}
    assert not kept[99] and all(kept[i] for i in range(60))


def test_copies_do_not_set_the_band(spark):
    """Copies that are most of a language neither switch its band off nor narrow it to themselves."""
    rows = [(i, prose(500, 60), "en", "s") for i in range(90)] + [(100 + i, prose(600 + i, 60), "en", "s") for i in range(40)]
    junk = [(200, " ".join(f"zq{k}xjw{k}vk" for k in range(60)), "en", "s")]
    kept = {x.doc_id: x.kept for x in perplexity.perplexity_rules(frame(spark, rows + junk)).collect()}
    assert not kept[200] and all(kept[i] for i, *_ in rows)


def brute_kneser_ney(texts, order):
    """Plain and left-out probabilities of each n-gram by the definition of modified Kneser-Ney, from distinct texts."""
    c = {order: Counter()}
    for t in set(texts):
        s = "\n" * (order - 1) + " ".join(words(t)) + "\n"
        c[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])

    def discount(n):
        k = Counter(c[n].values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        d = [max(0.0, min(float(i), i - (i + 1) * y * k[i + 1] / k[i])) if k[i] else 0.5 for i in (1, 2, 3)]
        return lambda x: 0.0 if x <= 0 else d[min(x, 3) - 1]

    d = {n: discount(n) for n in c}
    followers = {n: defaultdict(dict) for n in c}
    for n in c:
        for g, x in c[n].items():
            followers[n][g[:-1]][g[-1]] = x

    def prob(n, g, left_out):
        if n == 0:
            return 1 / (len(c[1]) + 1)
        after = dict(followers[n][g[:-1]])
        gone = left_out and c[n][g] == 1
        if left_out:
            after[g[-1]] -= 1
        total = sum(after.values())
        lower = prob(n - 1, g[1:], gone)
        if not total:
            return lower
        x = after[g[-1]]
        return (x - d[n](x) + sum(map(d[n], after.values())) * lower) / total

    def unseen(n, g):
        after = {k: v for k, v in followers[n][g[:-1]].items() if k != g[-1]}
        lower = prob(n - 1, g[1:], True)
        return sum(map(d[n], after.values())) * lower / sum(after.values()) if after else lower

    return {(n, g): (x, prob(n, g, False), prob(n, g, True), unseen(n, g)) for n in c for g, x in c[n].items()}


SCRIPTS = {
    "ru": "она читала старую книгу у окна и думала о море которое видела летом когда ветер гнал волны к берегу",
    "zh": "他们 在 河边 走 了 很久 看见 一只 白色 的 鸟 从 水面 上 飞 起来 然后 消失 在 远处 的 山 后面",
    "el": "το παιδί έτρεχε στον δρόμο και γελούσε με τους φίλους του μέχρι που νύχτωσε και γύρισε σπίτι",
    "en": "the boy ran down the road and laughed with his friends until night came and he went home again",
}


def script_prose(lang, seed, n=60):
    r, w = random.Random(seed), SCRIPTS[lang].split()
    return " ".join(r.choice(w) for _ in range(n))


def test_kneser_ney_equals_its_definition(spark, docs):
    rows = [(i, script_prose(lang, i, 12), lang, "s") for i, lang in enumerate(["ru", "zh", "en", "en", "el", "ru"])] + [(9, None, "en", "s"), (10, " ", "xx", "s"), (11, "a", "en", "s"), (12, "a", "en", "s")]
    counted = perplexity.count_ngrams(frame(spark, rows))
    got = {(r.lang, r.n, r.g): (r.c, r.p, r.q, r.z) for r in perplexity.kneser_ney(counted).collect()}
    want = {}
    for lang in {"ru", "zh", "en", "el"}:
        made = brute_kneser_ney([t for _, t, x, _ in rows if x == lang and words(t)], perplexity.ORDER)
        want |= {(lang, n, g): v for (n, g), v in made.items()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-9) for k in want)
    # what follows a context sums to one: seen characters, and what backing off leaves to the others
    per = defaultdict(float)
    for (lang, n, g), (_, p, *_) in got.items():
        if n == 1:
            per[lang] += p
    assert all(0.9 < x <= 1 + 1e-9 for x in per.values())


def test_copies_count_once_in_tables_of_any_size(spark):
    """Few copies among thousands of rows count as they do among a few, also with null and repeated ids, and by language."""
    copies = [(i % 3 or None, f"{t} copy", lang, "s") for i, t in enumerate(["ab", "cd", "ef"] * 2) for lang in ("en", None)] + [(7, "x y", "en", "s")] * 2 + [(8, "x  y", "en", "s"), (9, None, "en", "s")]
    for others in (0, 3000):
        rows = copies + [(100 + i, f"t{i}", "en", "s") for i in range(others)]
        want = Counter()
        for t, lang in {(t, lang or "") for _, t, lang, _ in rows if t}:
            s = "\n" * (perplexity.ORDER - 1) + " ".join(words(t)) + "\n"
            want.update((lang, s[k : k + perplexity.ORDER]) for k in range(len(s) - perplexity.ORDER + 1))
        assert {(r.lang, r.g): r.c for r in perplexity.count_ngrams(frame(spark, rows)).collect()} == want


def test_scores_are_those_of_the_model(spark, docs):
    rows = [(r.doc_id, r.text, r.lang, "s") for r in docs.limit(40).collect()] + [(1000 + i, script_prose("ru", i), "ru", "s") for i in range(5)]
    df, made = frame(spark, rows), {}
    for lang in {x for *_, x, _ in rows}:
        made[lang] = brute_kneser_ney([t for _, t, x, _ in rows if x == lang and words(t)], perplexity.ORDER)
    want, n = {}, perplexity.ORDER
    for i, t, lang, _ in rows:
        if words(t):
            s = "\n" * (n - 1) + " ".join(words(t)) + "\n"
            own = Counter(s[k : k + n] for k in range(len(s) - n + 1))
            want[i] = -sum(k * math.log(made[lang][n, g][3 if k >= made[lang][n, g][0] else 2]) for g, k in own.items()) / (len(s) - n + 1)
    # all n-grams broadcast, some, and none: the rest is joined
    for held in (1 << 20, 300, 0):
        got = {r.doc_id: r.log_ppl for r in perplexity.perplexity_rules(df, held=held).collect()}
        assert {i: x for i, x in got.items() if x is not None} == pytest.approx(want, abs=1e-5)


def test_bands_reject_junk_of_every_script(spark):
    """Shuffled characters and foreign text are rejected in each script, its prose is kept."""
    rows, junk = [], set()
    for k, lang in enumerate(SCRIPTS):
        rows += [(100 * k + i, script_prose(lang, i), lang, "s") for i in range(50)]
        mixed = list(script_prose(lang, 7))
        random.Random(k).shuffle(mixed)
        other = script_prose("zh" if lang != "zh" else "ru", 3)
        rows += [(100 * k + 90, "".join(mixed), lang, "s"), (100 * k + 91, other, lang, "s")]
        junk |= {100 * k + 90, 100 * k + 91}
    got = {r.doc_id: r.kept for r in perplexity.perplexity_rules(frame(spark, rows)).collect()}
    assert {i for i, x in got.items() if not x} == junk


# op7


def test_quality(spark, odd, empty, docs, labels):
    got = quality.quality_scores(clashing(docs), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((got.quality == got.predicted)).mean() > 0.93 and got.score.between(0, 1).all()
    assert set(got[got.held_out].doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    assert quality.quality_scores(odd, labels).count() == 14
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}


def test_quality_by_brute_force(spark, docs, labels):
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    rows = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs.collect()}
    train = [i for i in rows if i in y and zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([rows[i] for i in train])
    center, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = {i: np.clip((v - center) / scale, -quality.CLIP, quality.CLIP) for i, v in rows.items()}
    parts = [np.array([z[i] for i in train if y[i] == k]) for k in (0, 1)]
    covs = [np.cov(p.T) for p in parts]
    pool = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(train)
    logs = []
    for p, c in zip(parts, covs, strict=True):
        c = (1 - quality.SHRINK_POOLED) * c + quality.SHRINK_POOLED * pool
        c = (1 - quality.SHRINK_IDENTITY) * c + (quality.SHRINK_IDENTITY * np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
        inverse, (_, log_det), mean = np.linalg.inv(c), np.linalg.slogdet(c), p.mean(axis=0)
        logs.append({i: math.log(len(p) / len(train)) - 0.5 * log_det - 0.5 * (v - mean) @ inverse @ (v - mean) for i, v in z.items()})
    for r in quality.quality_scores(docs, labels).collect():
        odds = logs[1][r.doc_id] - logs[0][r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, odds)))), abs=1e-6)


# op8


def brute_repeats(raws, width=400):
    count = Counter(r[p : p + width] for r in raws for p in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for p in range(len(r) - width + 1):
            if count[r[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if len(r) else b""
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark, odd, empty):
    passage = prose(41, 120)
    rows = [(i, prose(i, 90) + passage[i * 20 :] + prose(i + 50, 90), "en", "s") for i in range(8)]
    rows += [(20, passage, "en", "s"), (21, passage[:399], "en", "s"), (22, "ab " * 400, "en", "s"), (23, prose(77, 200), "en", "s"), (24, prose(77, 200), "en", "s"), (25, "é" * 450 + passage[5:430], "en", "s")]
    for df in (frame(spark, rows), odd, clashing(frame(spark, rows))):
        have = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        want = sorted((str(i), *w) for (i, _), w in zip(have, brute_repeats([x for _, x in have]), strict=True))
        got = substring_dedup.remove_repeats(df, digests=True).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert substring_dedup.remove_repeats(empty).count() == 0
    full = substring_dedup.remove_repeats(frame(spark, rows)).where("doc_id = 23").first()
    assert full.kept == b"" and [(s.start, s.end) for s in full.spans] == [(0, full.n_bytes)]


def test_repeats_across_parts_and_between_neighbours(spark, monkeypatch):
    """Passages that start, end and overlap at random places, many in one family, sorted in many small runs and parts."""
    r, stock = random.Random(17), prose(90, 500)
    rows = []
    for i in range(60):
        pieces = [prose(1000 + i, r.randint(5, 60))]
        for _ in range(r.randint(1, 3)):
            a = r.randrange(len(stock) - 500)
            pieces += [stock[a : a + r.randint(300, 900)], prose(2000 + 7 * i + r.randint(0, 6), r.randint(0, 40))]
        rows.append((i, "".join(pieces), "en", "s"))
    rows += [(100, stock[100:1300], "en", "s"), (101, None, "en", "s"), (102, "\0" * 1200, "en", "s"), (103, "x" + "\0" * 700, "en", "s")]
    want = sorted((i, *w) for (i, *_), w in zip(rows, brute_repeats([(t or "").encode() for _, t, *_ in rows]), strict=True))
    for sorted_, part in ((20_000, 20_000), (7, 5)):
        monkeypatch.setattr(substring_dedup, "SORTED", sorted_)
        monkeypatch.setattr(substring_dedup, "PART_ROWS", part)
        got = substring_dedup.remove_repeats(frame(spark, rows), digests=True).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
        assert all(x.changed == (x.n_removed > 0) for x in got)


def test_merging_never_compares_a_known_prefix(monkeypatch):
    """Front-coded runs come back whole, merge in order, and the lengths of shared prefixes are exact."""
    r, compared = random.Random(3), []
    plain = suffix_merge.common_prefix
    monkeypatch.setattr(suffix_merge, "common_prefix", lambda a, b, start=0: compared.append((a[:start] == b[:start], plain(a, b, start) - start)) or plain(a, b, start))
    for _ in range(80):
        keys = [[bytes(r.choice(b"ab") for _ in range(r.randint(1, r.choice([3, 90, 200])))) for _ in range(r.randint(1, 25))] for _ in range(r.randint(0, 9))]
        made = [suffix_merge.front_code(sorted(ks), [i * 1000 + j for j in range(len(ks))]) for i, ks in enumerate(keys)]
        got = list(suffix_merge.merge([suffix_merge.read_run(b) for b in made]))
        assert [k for k, *_ in got] == sorted(k for ks in keys for k in ks) and len({i for _, i, _ in got}) == len(got)
        assert all(n == plain(x[0], k) for x, (k, _, n) in zip(got, got[1:], strict=False))
    assert all(known for known, _ in compared)


# op9


def test_url_rules(spark):
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "http://X.EXAMPLE.com/de/1?q=1#f", None), (3, "https://a.net/es/x", ""), (4, "https://a.net/de/x", '<link rel="canonical" href="https://b.net/fr/y">'),
        (5, "https://c.net/zz", "<meta http-equiv=refresh content='0; url=/es/moved'>"), (6, None, "x"), (7, "nohost", ""), (8, "http://www.example.com/en/3", ""), (9, "http://d.net/q", '<LINK HREF=//a.net/de/x REL=canonical>'),
        (10, "http://net/es/", ""), (11, "http://planet/es/", ""), (12, "http://e.net", ""), (12, "http://e.net", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(clashing(pages)).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("x.example.com", "/de/1", "com/", "allow")
    assert got[3] == ("a.net", "/es/x", "net/es/", "block")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block") and got[9][2:] == (None, "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("www.example.com", "/en/3", "www.example.com/en/", "allow")
    assert got[10][2] == "net/es/" and got[11][2:] == (None, "allow") and got[12] == ("e.net", "", None, "allow")
    assert url_filter.judge(pages).count() == 13 and url_filter.judge(pages.limit(0)).count() == 0
    redirects = spark.createDataFrame([("http://e.net", "http://a.net/es/x")], "from_url string, to_url string")
    assert {r.verdict for r in url_filter.judge(pages, redirects).where("page_id = 12").collect()} == {"block"}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randint(0, 60), 100 + r.randint(0, 60)) for _ in range(50)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {(x.node, x.component) for x in got.collect()} == {(n, find(n)) for n in parent}
    more = components.merged(got, spark.createDataFrame([(0, 500), (500, 100 + 0)], "src long, dst long"))
    assert {x.component for x in more.where("node IN (0, 500, 40)").collect()} == {0}


# op10


def weighted_sets(rows):
    """Weight by five-word shingle of each text: (1 + ln tf) times the mean over its words of 1 + ln((N + 1) / (df + 1)) / ln(N + 2)."""
    texts = [words(t) for _, t in rows]
    df, n = Counter(w for ws in texts for w in set(ws)), len(texts)
    idf = {w: 1 + math.log((n + 1) / (c + 1)) / math.log(n + 2) for w, c in df.items()}
    sets = []
    for ws in texts:
        tf = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else {}
        sets.append({g: (1 + math.log(c)) * sum(map(idf.get, g)) / len(g) for g, c in tf.items()})
    return sets


def weighted_similarity(a, b):
    if not a and not b:
        return 1.0
    least = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


def jaccard_classes(rows, threshold=0.8):
    sets = weighted_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if weighted_similarity(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted(sorted(map(str, g)) for g in groups.values())


def near_classes(df, threshold=0.8):
    got = defaultdict(list)
    for x in minhash.near_duplicates(df, threshold).collect():
        got[x.class_id].append(x.doc_id)
    return sorted(sorted(map(str, g)) for g in got.values())


def versions(seed, n=40, near=2, far=4, size=300):
    """One version of a text with ``near`` words edited, like all others, which have ``far`` edited and are like no other."""
    r = random.Random(seed)
    base, rows = [f"w{i}" for i in range(size)], []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(5, size - 5, 6), far if i else near):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w), "en", "s"))
    return rows


def test_near_duplicates(spark, odd, empty):
    rows, r = [], random.Random(4)
    for g in range(6):
        base = prose(g + 200, 300).split()
        for c in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"edit{g}{c}{r.random()}"
            rows.append((1000 * g + c, " ".join(w), "en", "s"))
    for df in (frame(spark, rows), odd, clashing(frame(spark, rows))):
        have = [(x.doc_id, x.text) for x in df.collect()]
        got = defaultdict(list)
        for x in minhash.near_duplicates(df).collect():
            got[x.class_id].append(x.doc_id)
            assert x.kept == (x.doc_id == x.class_id)
        assert sorted(sorted(map(str, g)) for g in got.values()) == jaccard_classes(have)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len(jaccard_classes([(x.doc_id, x.text) for x in odd.collect()]))


def test_strangers_look_past_failed_pairs(spark, monkeypatch):
    """The pair that agrees best is often no link, and the only link comes after it."""
    rows = versions(5)
    monkeypatch.setattr(minhash, "BEST", 1)
    assert near_classes(frame(spark, rows)) == jaccard_classes([(i, t) for i, t, *_ in rows])


def test_links_near_the_threshold(spark, monkeypatch):
    """Versions of a text at weighted similarities around 0.8, in small cells, and with all texts taken for long ones."""
    r, rows = random.Random(11), []
    base = [f"w{i}" for i in range(400)]
    for i in range(60):
        w = list(base)
        for k in r.sample(range(5, 395, 6), r.choice([4, 6, 7, 8, 9, 12, 16])):
            w[k] = f"e{i}x{k}" if i % 2 else f"w{r.randrange(400)}"
        rows.append((i, " ".join(w), "en", "s"))
    sets = weighted_sets([(i, t) for i, t, *_ in rows])
    near = [s for i in range(60) for j in range(i) if 0.75 < (s := weighted_similarity(sets[i], sets[j])) < 0.85]
    assert len(near) > 40
    want = jaccard_classes([(i, t) for i, t, *_ in rows])
    for name, value in (("BEST", 2), ("STRANGERS", 8), ("BLOCK", 8), ("LONG", 10)):
        monkeypatch.setattr(minhash, name, value)
        if name != "STRANGERS":
            assert near_classes(frame(spark, rows)) == want
    out = {x.doc_id: x for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    for i, x in out.items():
        best = max(weighted_similarity(sets[i], sets[j]) for j in range(60) if j != i)
        assert (x.links > 0) == (best >= 0.8) and x.class_size == sum(y.class_id == x.class_id for y in out.values())
        assert x.similarity is None or 0.799 < x.similarity < best + 0.002


def test_agreement_that_loses_hardly_a_link():
    assert minhash.least_agreement(0.8) == 38 and minhash.least_agreement(0.6) < minhash.least_agreement(0.9)


def test_classes_that_share_an_id_keep_a_row_each(spark):
    a, b, c, d = (prose(k, 60) for k in range(300, 304))
    rows = [(None, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (5, c, "en", "s"), (5, d, "en", "s"), (6, c, "en", "s")]
    kept = minhash.representatives(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted([("None", a), ("None", b), ("5", c), ("5", d)])


def test_samples_estimate_weighted_jaccard():
    idf = np.full(minhash.IDF_SLOTS, 1.1)
    a, b = prose(1, 400).split(), prose(2, 120).split()
    x = minhash.weighted_shingles(minhash.word_hashes(" ".join(a).encode()), idf)
    y = minhash.weighted_shingles(minhash.word_hashes(" ".join(a[:340] + b[:30]).encode()), idf)
    true = minhash.weighted_jaccard(x, y)
    agree = float((minhash.signature(x) == minhash.signature(y)).mean())
    spread = math.sqrt(true * (1 - true) / minhash.SAMPLES)
    assert abs(true - agree) < 4 * spread and minhash.weighted_jaccard(x, x) == 1.0
    assert len(minhash.word_hashes("  a b c \t a ".encode())) == 3


# shared helpers, pipeline and SQL


def test_bitmap_never_misses(spark):
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(300)]
    bits = bitmap(spark.createDataFrame([(bytearray(k),) for k in keys], "k binary"), "k")
    assert all(in_bitmap(bits, k) for k in keys)


def test_hot_groups_join_whole(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    out = join_groups(rows, groups, "k", "n", "inner")
    assert out.count() == 5000 and out.where("k = 0").select("n").distinct().collect()[0][0] == 1667


def test_queries_against_sql(spark, duck):
    from tessera.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(sql).df())


def test_pipeline_against_brute_force(spark, docs, labels):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "BPE encoding"]
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    seen, unique = set(), []
    for i, t, s in sorted(rows):
        n = re.sub("[ \t\n\x0b\x0c\r]+", " ", t)
        if n not in seen:
            seen.add(n)
            unique.append((i, t, s))
    first = {min(map(int, g)) for g in jaccard_classes([(i, t) for i, t, _ in unique])}
    kept = [u for u in unique if u[0] in first]
    total = sum(len(words(t)) for _, t, _ in kept)
    per = Counter()
    for _, t, s in kept:
        per[s] += len(words(t))
    targets = brute_targets(dict(per))
    out = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(bpe.default_path())
    texts = {i: t for i, t, _ in kept}
    assert {r.doc_id for r in out} <= set(texts) and sum(targets.values()) == pytest.approx(total)
    source = {i: s for i, _, s in kept}
    parts = Counter()
    for r in out:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        if r.ids_sha256 != hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest():
            parts[source[r.doc_id]] += 1  # the document where a source's budget ends
            assert r.n_tokens < len(ids)
    assert all(n == 1 for n in parts.values())


def test_stages_on_odd_and_empty_tables(spark, odd, empty, labels):
    """Nulls in every column, repeated rows and extra columns go through every stage; an empty table stays empty."""
    import corpus_pipeline

    y = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    for df in (odd, clashing(odd), empty):
        folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getConf().get('spark.checkpoint.dir')}/odd-{len(df.columns)}-{df.count()}"
        y.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        docs, n = df, df.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
            if k < 4:
                assert out.columns == df.columns
            if k < 3:
                assert out.count() <= docs.count()
            docs = out
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (docs.count() > 0) == (n > 0)


def test_one_very_long_text(spark):
    """A text of some megabytes, a copy with edits and one with a passage of it, through the operators that hold whole texts."""
    from tokenizers import Tokenizer

    r = random.Random(8)
    stock = [prose(k, 1) for k in range(900)]
    long = [r.choice(stock) for _ in range(400_000)]
    near = list(long)
    for k in r.sample(range(len(near)), 300):
        near[k] = "edited"
    rows = [(1, " ".join(long), "en", "s"), (2, " ".join(near), "en", "s"), (3, prose(5, 40) + " " + " ".join(long[1000:1200]), "en", "s"), (4, prose(6, 90), "en", "s")]
    df = frame(spark, rows)
    tok = Tokenizer.from_file(bpe.default_path())
    got = {x.doc_id: x.ids_sha256 for x in bpe.encode(df, form=bpe.DIGESTS).collect()}
    assert got == {i: hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t, *_ in rows}
    assert near_classes(df) == [["1", "2"], ["3"], ["4"]]
    gone = {x.doc_id: (x.n_bytes, x.n_removed) for x in substring_dedup.remove_repeats(df, digests=True).collect()}
    assert gone[1][1] > 0.5 * gone[1][0] and gone[3][1] > 400 and gone[4][1] == 0
    assert {x.doc_id: x.n_words for x in perplexity.perplexity_rules(df).collect()} == {i: len(words(t)) for i, t, *_ in rows}
