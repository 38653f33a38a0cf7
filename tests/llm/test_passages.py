"""Passages of many words and few bytes that occur in two documents."""

import collections
import random
import re

import pytest

from docmill.llm import suffixdedup, wordwindows
from tests.llm.test_joins import cut_plain


def cut_words_plain(texts, size):
    """Per text, which bytes a stretch of ``size`` words covers that starts anywhere else too."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[tuple(t[a:b] for a, b in s[i : i + size]) for i in range(len(s) - size + 1)] for t, s in zip(texts, spans, strict=True)]
    count = collections.Counter(w for ws in windows for w in ws)
    out = []
    for t, s, ws in zip(texts, spans, windows, strict=True):
        gone = bytearray(len(t))
        for i, w in enumerate(ws):
            if count[w] > 1:
                a, b = s[i][0], s[i + size - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode())
    return out


def test_stage_removes_short_passages_of_over_50_words(spark):
    import corpus_pipeline

    draw = random.Random(3)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n))
    passage, fifty = prose(51), prose(50)
    assert len(passage) < 400 and len(fifty) < 400
    texts = [f"{prose(90)} {passage} {prose(80)}", f"{prose(70)}\n{passage}\n{prose(60)}", f"{prose(70)}. {fifty} {prose(60)}", f"{prose(60)}; {fifty} {prose(70)}", prose(200), None]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert [left[k].text for k in range(6)] == [t.replace(passage, "") if t else t for t in texts]
    assert all(r.n_chars == len(r.text or "") for r in left.values())


@pytest.mark.parametrize("size", [1, 7, 51])
def test_word_windows(spark, size):
    draw = random.Random(size)
    words = ["a", "bé", "ccc", "d d", "-"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", "\n", "  ", "\t\r\n", "\x0b"]) for _ in range(n))
    own = lambda n: " ".join("".join(draw.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    texts = ["", None, " \n", "a", "la " * 120, text(60), own(60), own(40)]
    texts += [text(draw.randint(0, 120)) for _ in range(30)] + [own(120) for _ in range(10)]
    for _ in range(40):
        x, y = (draw.choice(texts) or "").split(), (draw.choice(texts) or "").split()
        i = draw.randint(0, len(x))
        texts.append("\n".join(x[:i] + y[i // 2 : i // 2 + draw.randint(0, 80)] + [own(1)]))
    texts += [texts[5], texts[6], texts[7]]
    long = own(80_000)  # read in pieces
    assert len(long) > wordwindows.STEP
    at = [m.start() for m in re.finditer(" ", long)]
    texts += [long] + [own(5) + long[at[k] : at[k + 60 + size]] for k in range(0, 79_000, 19_973)]
    docs = spark.createDataFrame([(k if k % 13 else None, t, str(k)) for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    left = {r.spans: r.text for r in suffixdedup.remove_repeats(docs, 2_000_000, words=size).collect()}  # no text has so many bytes
    want = {str(k): w if texts[k] is not None else None for k, w in enumerate(cut_words_plain([(t or "").encode() for t in texts], size)) if w.strip() or w == (texts[k] or "")}
    assert left == want
    assert suffixdedup.remove_repeats(docs.limit(0), words=size).count() == 0


def test_bytes_and_words_together(spark):
    draw = random.Random(8)
    own = lambda n, k=6: " ".join("".join(draw.choice("abcdefghijkl") for _ in range(k)) for _ in range(n))
    wide, many = own(30, 20), own(52, 5)  # 629 bytes of 30 words, 311 bytes of 52 words
    texts = [f"{own(40)} {wide} {own(9)} {many} {own(40)}", f"{own(9)}, {many} {own(9)}", f"{own(9)}:{wide}:{own(9)}", own(300), own(60, 3), own(20)]
    texts += [texts[4], texts[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in suffixdedup.remove_repeats(docs, words=51).collect()}
    raw = [t.encode() for t in texts]
    assert sum(gone > 0 for _, gone, _, _ in cut_plain(raw, 400)) == 2
    cut = lambda t: t.replace(wide, "").replace(many, "")
    assert set(left) == {0, 1, 2, 3, 5, 7} and all(abs(len(left[k]) - len(cut(texts[k]))) <= 4 for k in left)
    assert all(wide not in t and many not in t for t in left.values()) and left[3] == texts[3] and left[5] == left[7] == texts[5]
