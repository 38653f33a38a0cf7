"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many units lie in one flat array. A round looks up every pair of neighbours by binary
search over the sorted keys of the merge table, finds each unit's lowest rank, and merges that pair
wherever it stands in the unit, left to right. Rounds go on until no unit has a pair in the table; units
that are finished leave the array, so the work of a round follows the symbols that still change.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows are
encoded alike; strings of special tokens become those tokens' ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.wordbpe import UnitEncoder, default_path, encoder


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others take code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MergeEncoder(UnitEncoder):
    """Encodes units by merge rounds over flat numpy arrays; the library only normalises rare units."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        order = order[first]  # of equal pairs the earlier, lower rank counts
        self.keys, self.rank, self.made = key[order], order, made[order]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._library = None

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pieces(self, text: str) -> list[bytes]:
        """The pre-tokenised pieces of one text, as bytes."""
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_new(self, keys):
        """Plain units (ASCII letters, one digit, punctuation) are one piece each; others are pre-tokenised."""
        data, offsets = textcore.flat_text(pa.array(keys, pa.large_binary()))
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(textcore.byte_kinds(data) >= textcore.APOSTROPHE, out=odd[1:])
        pieces: list[bytes] = []
        per = np.ones(len(keys), np.int64)
        for k, (raw, is_odd) in enumerate(zip(keys, odd[offsets[1:]] > odd[offsets[:-1]], strict=True)):
            own = [raw.lower()] if (not is_odd and raw.isascii()) or _latin(raw) else self.pieces(raw.decode("utf-8", "replace"))
            per[k] = len(own)
            pieces += own
        ids, counts = self.merge(pieces)
        return ids, np.bincount(np.repeat(np.arange(len(keys)), per), counts, len(keys)).astype(np.int64)

    def encode_special(self, text):
        out: list[int] = []
        for part in self.split_special(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                raw = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
                ids, _ = self.encode(raw, np.array([0, len(raw)], np.int64))
                out += ids.tolist()
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per piece) of non-empty byte pieces."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, offsets = textcore.flat_text(pa.array(pieces, pa.large_binary()))
        n = len(pieces)
        sym = self.inner[data]
        sym[offsets[1:] - 1] = self.final[data[offsets[1:] - 1]]
        own = np.repeat(np.arange(n), np.diff(offsets))
        done_sym, done_own = [], []
        none = np.iinfo(np.int64).max
        rank = self._ranks(sym, own, none)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            live = np.repeat(best != none, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_own.append(own[~live])
                sym, own, rank = sym[live], own[live], rank[live]
                sizes, best = sizes[best != none], best[best != none]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            # of overlapping hits (x x x) every second one of a run counts, from its first
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            where = np.searchsorted(self.keys, sym[at] * self.size + sym[at + 1])
            sym[at] = self.made[where]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            prev = at - 2  # the symbol before may have been merged away
            changed[prev[prev >= 0]] = True
            sym, own, rank, changed = sym[keep], own[keep], rank[keep], changed[keep]
            redo = np.flatnonzero(changed)
            rank[redo] = self._ranks_at(sym, own, redo, none)
        sym, own = np.concatenate([*done_sym, sym]), np.concatenate([*done_own, own])
        order = np.argsort(own, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(own, minlength=n)

    def _ranks(self, sym, own, none):
        return self._ranks_at(sym, own, np.arange(len(sym)), none)

    def _ranks_at(self, sym, own, at, none):
        """Ranks of the pairs that begin at the given places; ``none`` where no pair is in the table."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        inside = (at + 1 < len(sym)) & (own[nxt] == own[at])
        key = sym[at] * self.size + sym[nxt]
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[where] == key), self.rank[where], none)


def _latin(raw: bytes) -> bool:
    """Only ASCII letters and lower-case Latin-1 letters: one piece that no normaliser changes."""
    text = raw.decode("utf-8", "replace")
    return all(("a" <= c <= "z") or ("\xdf" <= c <= "\xff" and c != "\xf7") for c in text)


class Decoder:
    """Joins the tokens of ids by one space each, which is what a tokenizer without a decoder does."""

    def __init__(self, tokens: dict[int, str]):
        self.tokens = tokens

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every whole text."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(MergeEncoder, path)
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets):
                ids, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows with ids; null ids give the empty string."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(MergeEncoder, path).tokens)
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(F.col(key).cast("long").alias(key), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes every whole text in one pass and returns digests of both.

    key, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the decoded text
    in UTF-8). Rows never leave their partition: no shuffle.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(MergeEncoder, path)
        top = max(enc.tokens) + 1
        spaced = [(" " + enc.tokens.get(i, "")).encode() for i in range(top)]
        blob = np.frombuffer(b"".join(spaced), np.uint8)
        width = np.array([len(s) for s in spaced], np.int64)
        begin = np.cumsum(width) - width
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets):
                ids, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(counts)])
                said = blob[textcore.take_ranges(begin[ids], width[ids])]
                said_at = np.concatenate([[0], np.cumsum(width[ids])])[at]
                one = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
                two = [hashlib.sha256(said[i + 1 if j > i else i : j]).hexdigest() for i, j in zip(said_at[:-1], said_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
