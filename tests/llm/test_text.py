"""Text primitives, tokenization, token files, packing, quality and toxicity against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docmill.llm import bpe, packing, quality, textcore, tokenfile, toxicity, wordbpe

ALPHABET = "abcZAJ ÉéßİΣσς'.,!… ̸́̌=0129²Ⅷ  \x1c\x85日本語🙂؀한글«»×÷-_\n\t<|"
SPECIAL = ["it's we're l'eau'S I'LL x'll <|endoftext|>Ab<|startoftext|>", "<|ENDOFTEXT|> a", "aaaaaaa" * 50, "", "J̌ Å Ǩ", "ǰ", "a.̸b ≠ .", "z-A", "ÎÏ ÿÞ"]


def noise(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(n)] + SPECIAL


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.default_path())


@pytest.mark.parametrize("kind", [wordbpe.LibraryEncoder, bpe.MergeEncoder])
def test_encoders_equal_the_library(library, kind):
    texts = noise(4000)
    data, offsets = textcore.flat_text(pa.array([*texts, None]))
    ids, counts = kind(wordbpe.default_path()).encode(data, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    want = [x.ids for x in library.encode_batch([*texts, ""], add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want


def test_the_dictionary_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_UNITS", 3)
    enc = wordbpe.LibraryEncoder(wordbpe.default_path())
    for text in ("one two three four five", "six one", "two nine ten"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    texts = [*noise(60, 3), None, "word " * 60_000, "same text here", "same text here"]
    rows = [(k if k % 23 else None, t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, key string, n_tokens long")  # names that clash on purpose


def test_round_trip_digests(docs, library):
    got = sorted(map(tuple, bpe.round_trip_digests(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0
    assert bpe.decode_documents(bpe.encode_documents(docs.where("doc_id = 70"))).first().text.startswith("word</w> word</w>")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    ids[n // 2 : n // 2 + 3] = high - 1
    segment = next(tokenfile.segments(tokenfile.write_segment(np.array([5]), np.array([n]), ids) + b"\n"))
    assert (segment.ids() == ids).all() and (segment.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_token_files(docs, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_TEXT_BYTES", 50_000)
    got = tokenfile.token_file_digests(docs).toPandas()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in tokenfile.token_file_digests(docs).collect()) == collections.Counter((r.doc_id, crc(r.text)) for r in docs.collect())
    got = got.sort_values("start")
    assert got.start.iloc[0] == 0 and (got.start.diff().iloc[1:] == got.n_tokens.shift().iloc[1:]).all()
    keys = got.doc_id.dropna().tolist()
    assert keys == sorted(keys) and got.doc_id.isna().sum() == sum(r.doc_id is None for r in docs.collect())
    assert tokenfile.token_file_digests(docs.limit(0)).count() == 0


def test_packing(docs, library):
    got = packing.pack_documents(docs, capacity=256).toPandas().sort_values(["sequence_id", "offset"])
    for _, own in got.groupby("sequence_id"):
        assert own.length.sum() <= 256 and own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    sizes = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert got.length.sum() == sum(sizes)
    assert len(got) == sum(-(-n // 256) for n in sizes)
    assert got.sequence_id.nunique() <= -(-sum(sizes) // 256) + 2
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r.doc_id, a // 256, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for a in range(0, len(ids), 256))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs, capacity=256).collect()) == want
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_two_pieces_replace_one():
    # greedy filling takes 6 and 3; 3 gives way to 2 and 2, which fill the bin
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]
    draw = np.random.default_rng(1).integers(1, 101, 2000)
    bins = packing.best_two_fit(draw, 100)
    assert sorted(k for b in bins for k in b) == list(range(2000)) and all(draw[b].sum() <= 100 for b in bins)
    assert len(bins) <= -(-draw.sum() // 100) * 1.03


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {k for i in range(n - 2) if count[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark):
    draw = random.Random(2)
    texts = ["", None, "\n\n", "a b c a b c", "x\nx\n x\nx", "é é é é", "w " * 90_000, *("".join(draw.choice("ab é#\n\t|") for _ in range(draw.randint(0, 400))) for _ in range(200))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r[0]: tuple(r)[1:7] for r in quality.quality(df).collect()}
    assert got == {k: plain_quality(t) for k, t in enumerate(texts)}
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df.limit(0)).count() == 0


def plain_kept(text):
    """The whole verdict: base rules, the band of the text's length, and the share of chunks outside theirs."""
    import zstandard

    raw = (text or "").encode()
    if plain_quality(text)[5]:
        return False
    ratio = lambda part: len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
    own = [(low, high) for least, low, high in quality.BANDS if len(raw) >= least][-1:]
    if own and not own[0][0] <= ratio(raw) <= own[0][1]:
        return False
    chunks = [raw[i : i + 1024] for i in range(0, len(raw) - 1024, 1024)] + [raw[-1024:]] if len(raw) >= 1024 else []
    return sum(not 0.32 <= ratio(c) <= 0.75 for c in chunks) <= len(chunks) / 4


def test_kept_equals_a_plain_rewrite(spark):
    draw, rng = random.Random(9), np.random.default_rng(9)
    word = lambda: "".join(draw.choice(["ri", "sto", "wal", "un", "gre", "sev", "la", "qui", "of", "é"]) for _ in range(draw.randint(1, 4)))
    texts = ["", None, "w " * 900]
    for n in [20, 49, 50, 51, 60, 90, 150, 151, 300, 700, 3000, 20_000] * 4:
        words = [word() for _ in range(n)]
        texts += [" ".join(words), " ".join(words[: n // 3] * 3), " ".join(base64.b64encode(rng.bytes(draw.randint(6, 30))).decode() for _ in range(n))]
        texts += [texts[-3] + " " + texts[-1][: len(texts[-3]) * draw.randint(1, 9) // 10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    want = {k: plain_kept(t) for k, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < sum(not plain_quality(t)[5] for t in texts)
    assert sorted(r.doc_id for r in quality.keep_good(df).select("doc_id").collect()) == [k for k, w in want.items() if w]


def test_compression_bands():
    draw = random.Random(5)
    prose = " ".join("".join(draw.choice(["ri", "sto", "wal", "un", "gre", "sev", "la", "qui", "of", "the", "a"]) for _ in range(draw.randint(1, 4))) for _ in range(600)).encode()
    secret = bytes(np.random.default_rng(0).integers(33, 127, 4000, dtype=np.uint8))
    texts = [prose, b"buy now " * 500, np.random.default_rng(0).bytes(4000), secret]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole, odd = quality.compression(data, offsets)
    assert quality.in_bands(np.diff(offsets), whole, odd)[:3].tolist() == [True, False, False]


def test_incompressible_text_is_rejected():
    draw, rng = random.Random(6), np.random.default_rng(6)
    word = lambda: "".join(draw.choice(["ri", "sto", "wal", "un", "gre", "sev", "la", "qui", "of", "the", "a"]) for _ in range(draw.randint(1, 4)))
    prose = " ".join(word() for _ in range(60_000)).encode()
    greek = " ".join("".join(draw.choice("αειοντσρκλμπυηδ") for _ in range(draw.randint(2, 9))) for _ in range(3000)).encode()
    kana = "".join(chr(draw.randint(0x3042, 0x3093)) for _ in range(9000)).encode()
    lines = lambda s, n, by: by.join(s[i : i + n] for i in range(0, len(s), n))
    encoded = [lines(base64.b64encode(rng.bytes(n * 3 // 4)), 76, b"\n") for n in (512, 1500, 4000, 27_000, 270_000)]
    noisy = [lines(bytes(rng.integers(33, 127, n, dtype=np.uint8)), 20, b" ") for n in (512, 3000, 21_000, 200_000)]
    part = [prose[:1024] + encoded[2][:1020], prose[:4096] + encoded[2][:4000]]
    clean = [t[:n] for t in (prose, greek, kana) for n in (129, 255, 513, 1023, 2049, 9000)] + [prose[:270_000]]
    texts = [*encoded, *noisy, *part, *clean]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    kept = quality.in_bands(np.diff(offsets), *quality.compression(data, offsets)).tolist()
    assert kept == [False] * (len(texts) - len(clean)) + [True] * len(clean)


def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(7)
    plain = ["the", "river", "stone", "walk", "green", "lamp", "seven", "quiet", "moon", "glass"]
    def text(bad):
        words = [draw.choice(plain) for _ in range(draw.randint(20, 80))]
        for _ in range(bad):
            words[draw.randrange(len(words))] = draw.choice(["vile", "scumbag", "rottenest", "rottenly"])
        return " ".join(words)
    rows = [(k, text(draw.randint(2, 8) if k % 5 == 0 else 0), int(k % 5 == 0)) for k in range(600)]
    df = spark.createDataFrame([*rows, (None, None, None), (9999, None, None), rows[5]], "doc_id long, text string, toxic int")
    labels = df.where("doc_id < 300").select("doc_id", "toxic", "text")
    model = toxicity.fit_labelled(df.select("doc_id", "text"), labels)
    assert (np.diff(model.cuts) >= 0).all()
    got = {r.doc_id: r for r in toxicity.severity(df, model).collect()}
    held = [(got[k].rejected, bool(t)) for k, _, t in rows if k >= 300]
    assert all(a == b for a, b in held) and got[9999].rejected is False
    mild, harsh = (toxicity.severity(spark.createDataFrame([(1, " ".join(["vile"] * n + ["river"] * 50))], "doc_id long, text string"), model).first().severity for n in (2, 12))
    assert mild < harsh
    nothing = toxicity.fit_labelled(df.select("doc_id", "text"), labels.limit(0))
    assert toxicity.severity(df, nothing).where("rejected").count() == 0
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0 and toxicity.drop_toxic(df, model).columns == df.columns


def test_plain_units_share_the_librarys_calls(library, monkeypatch):
    enc = wordbpe.LibraryEncoder(wordbpe.default_path())
    calls, own = [], enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: calls.extend(texts) or own(texts))
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(600)), "it's 7 naïve, 日本 w!"]
    data, offsets = textcore.flat_text(pa.array(texts))
    ids, counts = enc.encode(data, offsets)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)
    assert len(calls) < 20  # not one a word


def test_units_that_come_back_stay_when_the_dictionary_is_full(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_UNITS", 40)
    enc = wordbpe.LibraryEncoder(wordbpe.default_path())
    asked, own = [], enc.encode_new
    monkeypatch.setattr(enc, "encode_new", lambda keys: asked.extend(keys) or own(keys))
    for k in range(12):
        text = "often again " + " ".join(f"{chr(97 + k)}q{chr(97 + j)}" for j in range(25))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.count(b"often") == asked.count(b"again") == 1
    assert len(enc.known) <= 40 + 27
