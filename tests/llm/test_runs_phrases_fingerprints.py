"""Periodic runs, collocations and fingerprints against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import collocations, periodicruns, queries, simhash, textcore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """All runs by every period, smallest periods first."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                out.setdefault((i, length), p)  # a multiple of the period has the same ends
            i = max(j, i + 1)
    return sorted(((a, n_, p) for (a, n_), p in out.items()), key=lambda r: (r[0], r[2]))


def noisy_words(draw):
    w = [draw.choice("abcde"[: draw.choice([1, 2, 3, 5])]) for _ in range(draw.randint(0, 40))]
    for _ in range(draw.randint(0, 2)):
        u = [draw.choice("abc") for _ in range(draw.randint(1, 7))]
        w += u * draw.randint(2, 9) + u[: draw.randint(0, len(u))] + [draw.choice("abz") for _ in range(draw.randint(0, 9))]
    return w * draw.choice([1, 1, 1, 2, 5])


def test_runs_are_all_found():
    draw = random.Random(3)
    docs = [noisy_words(draw) for _ in range(700)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["x", *["a"] * 5000, "y"], ["a", "b"] * 3000]
    for some in (docs[:350], docs[350:], docs[-1:], []):
        data, offsets = textcore.flat_text(pa.array([" ".join(w) for w in some], pa.string()))
        start, end, before = textcore.words(data, offsets)
        doc, *rest = periodicruns.find_runs(textcore.span_hash(textcore.prefix_hash(data), start, end), before)
        got = [[] for _ in some]
        for d, *r in zip(doc.tolist(), *(x.tolist() for x in rest), strict=True):
            got[d].append(tuple(r))
        assert got == [brute_runs(w) for w in some]


def planted(key, w):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_run_digests(spark):
    draw = random.Random(4)
    texts = [" ".join(noisy_words(draw)) for _ in range(150)] + [None, "", " \t\n ", "É é " * 9, "one"]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "a " * 7, "x", 1)], "doc_id long, text string, runs string, n_words long")
    got = periodicruns.digests(periodicruns.detect(df, reorder=queries.planted_order))
    want = []
    for r in df.collect():
        w = WORD.findall(r.text or "")
        w = planted(r.doc_id, w) if r.doc_id is not None else w
        runs = brute_runs(w)
        gone = {i for a, n, p in runs for i in range(a + p, a + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(runs), *four, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert periodicruns.detect(df.limit(0)).collect() == []
    assert periodicruns.detect(df.where("doc_id = 3")).first().collapsed is not None


def brute_phrases(rows, least, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        often = {x: a for x, a in own.items() if len(x) > 1 and a >= least}
        found = []
        for x, a in often.items():
            if any(100 * b >= 80 * a and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1)) for y, b in often.items() if len(y) > len(x)):
                continue
            score, _, l, r = min((2_000_000 * a // (own[x[:k]] + own[x[k:]]), k, own[x[:k]], own[x[k:]]) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # tries leave and burst all the time, ids run out, every word is heavy
        monkeypatch.setattr(collocations, "HELD", 40)
        monkeypatch.setattr(collocations, "BURST", 3)
        monkeypatch.setattr(collocations, "HEAVY", 1 << 40)
        monkeypatch.setattr(collocations, "MERGED", 10)
        monkeypatch.setattr(collocations, "STEP", 600)
    draw = random.Random(6)
    rows = []
    for k in range(90):
        words = [draw.choice(["Up", "down", "the", "É", "é", "a-b", "z"]) + draw.choice(["", "", ".", ",", "\n", ";"]) for _ in range(draw.randint(0, 60))]
        words += ["new york", "new york city hall", "in\tthe end"][: k % 4]
        rows.append((k, " ".join(words), draw.choice(["en", "fr", None, "en"]), "x"))
    rows += [rows[0], rows[0], (90, None, "en", "x"), (91, "", "de", "x"), (92, "!.. ,", "de", "x"), (93, "once upon a time", "de", "x"), (94, "long words " * 3000, "big", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, a string")
    got = collocations.collocations(df, min_count=5, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], 5, 25)


def test_collocations_without_frequent_words(spark):
    df = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(df).collect() == [] and collocations.collocations(df.limit(0)).collect() == []


def test_trie_counts_whatever_leaves():
    draw = np.random.default_rng(2)
    trie, want, got = collocations.HatTrie(held=200, burst=8), collections.Counter(), collections.Counter()
    for _ in range(30):
        ids = trie.number(draw.integers(0, 30, (90, 4)).astype(np.uint64).ravel()).reshape(-1, 4)
        rest = (ids[:, 1] << 42) | (ids[:, 2] << 21) | ids[:, 3]
        want.update(zip(ids[:, 0].tolist(), rest.tolist(), strict=True))
        trie.add(ids[:, 0], rest)
        if trie.full:
            for a, b, c in zip(*(x.tolist() for x in trie.spill()), strict=True):
                got[a, b] += c
            assert trie.size <= 100 and trie.size == sum(trie.sizes.values())
    assert trie.nodes
    for a, b, c in zip(*(x.tolist() for x in trie.spill(True)), strict=True):
        got[a, b] += c
    assert got == want and trie.size == 0


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    draw = random.Random(8)
    base = [[draw.choice("abcdefghijklmnop") + draw.choice("xyz") for _ in range(draw.randint(0, 300))] for _ in range(30)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for _ in range(draw.randint(0, 3)):
            v = list(w)
            for _ in range(draw.randint(0, 2)):
                if v:
                    v[draw.randrange(len(v))] = "Changed"
            texts.append("  ".join(v).upper())
    texts += [None, "", "  \n", "one", "ONE", "one two three", "É é", "w " * 700, "w " * 699]
    rows = [(7 * k % 1009, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[2], (None, texts[4], "x"), (None, "only a null key here", "x")], "doc_id long, text string, fp string")
    all_ = df.collect()
    fps = [brute_fingerprint(r.text) for r in all_]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(all_, roots, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", least.get(c)) for r, f, c in zip(all_, fps, roots, strict=True)), key=str)
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [300, 10**7, 10**9])
def test_every_plan_finds_all_links(monkeypatch, rows):
    """Plans for tables of very different sizes, buckets cut to blocks included, connect what links connect."""
    monkeypatch.setattr(simhash, "BLOCK", rows // 25)
    draw = np.random.default_rng(rows % 97)
    centres = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = []
    for k in range(300):
        f = int(centres[k % 12])
        for b in draw.choice(64, draw.integers(0, 7), replace=False).tolist():
            f ^= 1 << b
        fps.append(f)
    fp = np.unique(np.array([*fps, 0, 1, 2**64 - 1], np.uint64))
    bits = simhash._unpacked(fp).astype(float)
    plan = simhash.Plan(rows, bits.T @ bits * rows / len(fp), fp)
    assert sum(plan.thresholds) == simhash.DISTANCE - len(plan.parts) + 1 and sorted(b for p in plan.parts for b in p) == list(range(64))
    key, at, own = (np.concatenate(x) for x in zip(*plan.dealt(fp), strict=True))
    by = np.argsort(key, kind="stable")
    a, b = simhash.verified_links(key[by], fp[at][by], own[by])
    place = {f: i for i, f in enumerate(fp.tolist())}
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        parent[root(place[x])] = root(place[y])
    want = brute_components(fp.tolist())
    assert len({(root(i), want[i]) for i in range(len(fp))}) == len(set(want)) == len({root(i) for i in range(len(fp))})


def test_links_between_spark_partitions(spark):
    """A dense group of fingerprints gives fewer links than rows and stays one component."""
    fps = [(1 << a) | (1 << b) for a in range(24) for b in range(a)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(6)
    got = simhash.links(df).collect()
    assert len(got) < 5 * len(fps)
    from docmill.llm.components import connected_components

    roots = connected_components(spark.createDataFrame(got, "a long, b long"))
    assert roots.count() == len(fps) and roots.select(F.min("root"), F.max("root")).first()[0] == min(fps)
