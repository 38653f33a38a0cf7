"""Joins, repeats, archive, neighbours, language model and pipeline against brute force."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from docmill.llm import jaccardjoin, maskedlm, nndescent, suffixdedup, warc
from docmill.llm.components import connected_components


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (7, 9), (9, 7)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str), [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "é", "X", "x"]
    rows = []
    for _ in range(40):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(1, 9)):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                if own:
                    own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append(" ".join(own))
    rows += ["", None, "  \n", "a", "a", "A", "a b", "One two three four five", "one two three four five ", "long " * 30_000]
    rows = [(k if k % 31 else None, t) for k, t in enumerate(rows)]
    return [*rows, rows[7], rows[8]]


@pytest.mark.parametrize(("block", "small", "few"), [(2048, 128, 20_000), (3, 128, 0), (2048, 2, 0), (2048, 2, 20_000)])
def test_jaccard_join(spark, copies, monkeypatch, block, small, few):
    # the functions run in workers, which import the module anew: settings reach them by value
    real = jaccardjoin.linked_components
    monkeypatch.setattr(jaccardjoin, "linked_components", lambda *a: real(*a, block=block))
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in copies], "doc_id long, text string, n int, digest string")
    assert sorted(map(tuple, jaccardjoin.component_ids(df).collect()), key=str) == classes(copies)[0]


@pytest.mark.parametrize(("small", "few"), [(128, 20_000), (2, 20_000), (2, 0), (128, 0)])
def test_proposals_connect_all_links(monkeypatch, small, few):
    """Rounds of proposing and judging find every component, whichever way groups are looked at."""
    monkeypatch.setattr(jaccardjoin, "SMALL", small)
    monkeypatch.setattr(jaccardjoin, "FEW", few)
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = draw.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(12):
            own = base.copy()
            own[draw.integers(0, 40, draw.integers(0, 6))] = draw.integers(0, 2**63)
            sets.append(np.unique(own))
    link = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
    n = len(sets)
    label = np.arange(n)
    refused: set[tuple[int, int]] = set()
    for turn in range(200):
        members = jaccardjoin.Members(np.arange(n), np.array([len(s) for s in sets]), label, [jaccardjoin.parity_bitmap(s) for s in sets])
        found, whole = jaccardjoin.propose(members, [np.arange(n)], [np.zeros(n, int)], refused, turn == 0)
        if not found:
            break
        for i, j in found:
            if link(i, j):
                label[label == label[j]] = label[i]
            else:
                refused.add((i, j))
        if whole:
            break
    want = np.arange(n)
    for i in range(n):
        for j in range(i):
            if link(i, j):
                want[want == want[i]] = want[j]
    assert (np.unique(label, return_inverse=True)[1][:, None] == np.unique(label, return_inverse=True)[1][None, :]).tolist() == (want[:, None] == want[None, :]).tolist()


def test_one_of_each_class_stays(spark, copies):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in copies], "doc_id long, text string, most int, h string")
    kept = jaccardjoin.keep_one(df)
    assert kept.columns == df.columns
    _, root = classes(copies)
    have = collections.defaultdict(list)
    for i, (k, t) in enumerate(copies):
        have[root[i] if shingle_set(t) else ("empty", i)].append(k)
    want = [min((k for k in own if k is not None), default=None) for own in have.values()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccardjoin.keep_one(df.limit(0)).count() == 0


def cut_plain(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "most"), [(24, 1), (70, 1000), (400, 2)])
def test_repeats(spark, monkeypatch, length, most):
    draw = random.Random(length)
    texts = ["".join(draw.choice("abé ") for _ in range(draw.randint(0, 300))) for _ in range(60)]
    texts += ["ab" * 100, "a" * 150, "", None, "x" * (length - 1), texts[3], texts[3], "q" + "z" * 20_000]
    for _ in range(60):
        x, y = draw.choice(texts) or "", draw.choice(texts) or ""
        i = draw.randint(0, min(len(x), 300))
        texts.append((x[:i] + y[i // 2 : i // 2 + 400] + x[i : i + 400]))
    passage = "".join(draw.choice("abcdé ") for _ in range(900))  # one range with many contexts on either side
    texts += [texts[k] + passage + "".join(draw.choice("abé ") for _ in range(30)) for k in range(40)]
    long = "".join(draw.choice("abcdefghijkl ") for _ in range(300_000))  # read in pieces
    texts += [long, "!" + long[250_000:290_000]]
    real = suffixdedup.repeated_spans
    monkeypatch.setattr(suffixdedup, "repeated_spans", lambda *a: real(*a, most=most))
    df = spark.createDataFrame([(k if k % 17 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = suffixdedup.removal_digests(df, length).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(cut_plain([(t or "").encode() for t in texts], length))
    assert all(r.repeats_elsewhere or not r.n_removed for r in rows)
    assert all(r.n_chars == len(texts[r.doc_id] or "") for r in rows if r.doc_id is not None and not r.n_removed)
    left = suffixdedup.remove_repeats(df, length)
    assert left.columns == df.columns and left.where("text is null").count() == 1
    assert suffixdedup.removal_digests(df.limit(0), length).count() == 0


def test_archive(spark):
    rows = [(1, "u\nx", "a" * 150), (0, None, "a" * 150), (None, "u", "a" * 150), (0, "u", "a" * 150), (5, "u", None), (6, "", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "é", "é" * 60_000), (9, "v", "w" * 16_385)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.archive_digests(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and html == "a" * 150 and page != 0
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 0 if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_digests(df.limit(0)).count() == 0


def test_archive_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "FILE_RECORDS", 8)
    monkeypatch.setattr(warc, "SMALL", 100)
    sizes = [n for n in (0, 1, 99, 100, 101, 200, 399, 400, 799, 800, 801, 5000) for _ in range(30)]
    df = spark.createDataFrame([(k, "u", chr(97 + k % 26) * n) for k, n in enumerate(sizes)], "page_id long, url string, html string")
    warc.write_archive(df.repartition(3), f"file://{tmp_path}/a")
    files = [[len(block) for _, block in warc.parse_warc(gzip.decompress(f.read_bytes()))] for f in (tmp_path / "a" / "payloads").rglob("part-*")]
    assert all(sum(f) <= 800 or len(f) == 1 for f in files) and max(map(len, files)) <= 8
    assert sum(map(len, files)) == df.select("html").distinct().count()
    assert warc.read_records(spark, f"file://{tmp_path}/a").count() == len(sizes)


def test_archive_finds_a_changed_payload(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "payload" * 30)], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    (part,) = (tmp_path / "a" / "payloads").rglob("part-*")
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"payload", b"pAyload", 1)))
    for crc in (tmp_path / "a" / "payloads").rglob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="another digest"):
        warc.read_records(spark, f"file://{tmp_path}/a").collect()


def test_neighbours(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(3000, 16)).round(3)
    v[100:160] = v[100] + draw.normal(size=(60, 16)) * 0.01
    rows = [(k, v[k].tolist(), "x") for k in range(3000)]
    odd = [(5000, None, "x"), (5020, [0.0] * 16, "x"), (5040, [float("nan")] * 16, "x"), (5060, [1.0] * 3, "x"), (5061, [2.0] * 3, "x"), (7, [50.0] * 16, "x"), (None, [1.0] * 16, "x"), (5080, [1.0] * 15 + [None], "x"), rows[20]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, id string")
    got = nndescent.nearest(df).toPandas()
    # a repeated row (20) is a row of its own, and so is another vector of one id (7); lengths don't mix
    every = np.concatenate([v, [np.full(16, 50.0), v[20]]])
    name = np.array([*range(3000), 7, 20])
    s = every @ every.T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for q in range(0, 3000, 20):
        own = got[got.query_id == q].sort_values(["rank", "vec_id"])
        assert own["rank"].tolist() == sorted([*range(1, 21)] * (2 if q == 20 else 1))
        best = sorted(zip(-s[q], name, strict=True))[:20]
        hit += len({(round(x, 9), n) for x, n in zip(own.score, own.vec_id, strict=True)} & {(round(-x, 9), n) for x, n in best})
    assert hit / (150 * 20) >= 0.9 and set(got.query_id) == {*range(0, 3000, 20), 5060}
    assert got[got.query_id == 5060][["rank", "vec_id", "score"]].values.tolist() == [[1, 5061, 6.0]] and (got.vec_id == 7).sum() > 0
    few = nndescent.nearest(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, n int")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nndescent.nearest(df.limit(0)).count() == 0


def test_search_goes_on_to_the_end(spark):
    """A chain whose nodes are ever likelier: the best ones are many hops away; sizes follow the rows."""
    rows = spark.createDataFrame([(k, k, [1.0, k + 0.5]) for k in range(12)], "id long, key long, v array<double>")
    index = rows.select("id", "v").mapInArrow(nndescent._halves, "id long, norm double, half binary")
    graph = spark.createDataFrame([(k, k + 1, 1 + (k + 0.5) * (k + 1.5)) for k in range(11)], "a long, b long, s float")
    got = nndescent.search(rows, index, graph, spark.createDataFrame([(0,)], "q long"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [11, 10, 9]
    small, large = nndescent.sizes(nndescent.BASE), nndescent.sizes(16 * nndescent.BASE)
    assert large.repeats > small.repeats and large.degree > small.degree and large.reverse > small.reverse
    assert large.pool > 2 * small.pool and large.beam > 2 * small.beam


def test_language_model(spark):
    draw = random.Random(3)
    def text():
        return " ".join(w for _ in range(60) for w in (draw.choice(["red", "blue"]), draw.choice(["fox", "owl"]), "sees", draw.choice(["a", "the"]), "tree"))
    rows = [(k, text(), "x") for k in range(200)] + [(900, None, "x"), (901, " \n", "x"), (902, "Red FOX", "x"), (902, "Red FOX", "x"), (903, "tree " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    model = maskedlm.train(df.where("doc_id < 150"), stride=1)
    got = {r.doc_id: r for r in maskedlm.score(df, model).collect()}
    assert (got[900].n_words, got[900].log_likelihood, got[901].mean_log_likelihood) == (0, 0.0, None)
    # the same number from one place at a time
    net, vocabulary, number = model
    raw = np.frombuffer(b"red fox", np.uint8)
    ids = maskedlm.word_numbers(maskedlm.word_hashes(raw, np.array([0, len(raw)]))[0], vocabulary, number)
    plain = sum(float(net.log_probability(np.array([[0, 0, *(ids[k + 1 : k + 2] + 1), 0, 0][:4] if k == 0 else [0, ids[0] + 1, 0, 0]]), ids[k : k + 1])[0]) for k in range(2))
    assert math.isclose(got[902].log_likelihood, plain, rel_tol=1e-5)
    # held-out prose is likelier than the same words in another order, and than by shares alone
    mixed = [(k, " ".join(sorted(t.split(), key=lambda w: hashlib.md5((w + str(k)).encode()).hexdigest())), "x") for k, t, _ in rows[150:200]]
    other = maskedlm.score(spark.createDataFrame(mixed, df.schema), model).agg({"log_likelihood": "sum"}).first()[0]
    assert sum(got[k].log_likelihood for k in range(150, 200)) > other
    assert maskedlm.score(df.limit(0), maskedlm.train(df.limit(0))).count() == 0


def test_every_place_is_learnt_once():
    for n in (0, 1, 3, 1000):
        taken = [maskedlm.turn_places(turn, maskedlm.ROUNDS, maskedlm.STRIDE, n) for turn in range(maskedlm.ROUNDS)]
        assert sorted(np.concatenate(taken).tolist()) == list(range(n))


def test_frequent_words(spark):
    rows = [(k, 1000 // (k + 1)) for k in range(300)]
    counts = spark.createDataFrame(rows, "word long, n long").repartition(5)
    for most in (0, 1, 7, 50, 299, 300, 1000):
        few, more = ({r.word for r in maskedlm.frequent(counts, most, ties).collect()} for ties in (False, True))
        assert few <= set(range(most)) and more >= set(range(min(most, 300))), most
        for got in (few, more):  # no word stays out while one with a lower count is in
            least = min((1000 // (k + 1) for k in got), default=1 << 60)
            assert got >= {k for k, n in rows if n > least}
    assert maskedlm.frequent(counts.limit(0), 5, True).count() == 0


def test_rare_words_have_their_share(spark):
    often = " ".join(f"w{k} w{k} w{k}" for k in range(maskedlm.VOCABULARY))
    rare = " ".join([*(f"r{k} r{k}" for k in range(300)), *(f"s{k}" for k in range(300))])
    df = spark.createDataFrame([(1, often), (2, rare)], "doc_id long, text string")
    model = maskedlm.train(df)
    said = [f"{c}{k}" for c in "rs" for k in range(300)]
    asked = spark.createDataFrame([*enumerate(said), (900, "never"), (901, "seen"), (None, "r1 s1"), (None, "r1 s1"), (903, None)], "doc_id long, text string")
    spaced = np.frombuffer(" ".join(said).encode(), np.uint8)
    bucket = maskedlm.word_hashes(spaced, np.array([0, len(spaced)]))[0] % np.uint64(maskedlm.BUCKETS)
    held = collections.Counter()
    for w, b in zip(said, bucket.tolist(), strict=True):
        held[b] += 1 + (w[0] == "r")
    for known in (0, 7, maskedlm.KNOWN):
        got = maskedlm.score(asked, model, known=known).collect()
        p = {r.doc_id: math.exp(r.log_likelihood) for r in got if r.doc_id is not None}
        ids = np.arange(len(model[1]) + maskedlm.BUCKETS)
        whole = np.exp(model[0].log_probability(np.zeros((len(ids), 2 * maskedlm.SIDE), np.int64), ids))
        for k, (w, b) in enumerate(zip(said, bucket.tolist(), strict=True)):
            assert math.isclose(p[k], whole[len(model[1]) + b] * (1 + (w[0] == "r")) / (held[b] + 1), rel_tol=1e-4)
        assert len(got) == asked.count() and len({r.log_likelihood for r in got if r.doc_id is None}) == 1


def test_sql_queries(spark):
    from docmill.llm.queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns), name
        order = sorted(names)
        assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=str), name
