"""Word-ending byte-pair encoding of whole documents, a unit dictionary at a time.

A batch of documents is cut into units (``textcore.units``), every distinct unit is encoded once, and
the ids of a document are gathered from the units' ids. ``LibraryEncoder`` encodes new units with the
tokenizers library; ``MergeEncoder`` in ``bpe`` does so with numpy merge rounds.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from docmill.llm import textcore
from docmill.llm.textcore import take_ranges

#: Distinct units that a worker keeps; when full, those that were asked for again stay, half of it at most. Bounds
#: memory, changes no result.
CACHE_UNITS = 300_000
#: Plain units that one call of the library encodes as one text.
JOINED = 256


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Encodes documents through a dictionary of units; subclasses say how a new unit is encoded."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special_bytes = [s.encode() for s in self.special]
        self._special_first = {b[:2] for b in self._special_bytes}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 18, np.int64)
        self.asked = np.zeros(1 << 18, np.int64)

    def _shrink(self) -> None:
        """Keeps the units that were asked for most, and of those that were asked for once none."""
        keys, asked = list(self.known), self.asked[: len(self.known)]
        keep = np.argsort(-asked, kind="stable")[: CACHE_UNITS // 2]
        keep = np.sort(keep[asked[keep] > 1])
        length = self.at[keep + 1] - self.at[keep]
        ids, again = self.ids[take_ranges(self.at[keep], length)], asked[keep] // 2  # what was frequent long ago may go
        self._forget()
        self._store([keys[k] for k in keep.tolist()], ids, length)
        self.asked[: len(keep)] = again

    def encode_new(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per key)"""
        raise NotImplementedError

    def encode_special(self, text: str) -> list[int]:
        """A text that holds the string of a special token."""
        raise NotImplementedError

    def _store(self, keys: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.known), int(self.at[len(self.known)])
        while len(self.at) < n + len(keys) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.asked = np.concatenate([self.asked, np.zeros_like(self.asked)])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.at[n + 1 : n + len(keys) + 1] = used + np.cumsum(counts)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def rows_of(self, dictionary: pa.Array) -> np.ndarray:
        """The dictionary's units as rows of this encoder's table, encoding those that are new."""
        keys = dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_UNITS:
            self._shrink()
        rows = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        if len(new):
            own = [keys[k] for k in new.tolist()]
            rows[new] = np.arange(len(self.known), len(self.known) + len(own))
            self._store(own, *self.encode_new(own))
        self.asked[rows] += 1
        return rows

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, ids per document)."""
        coded, before = textcore.units(data, offsets)
        rows = self.rows_of(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.at[rows + 1] - self.at[rows]
        total = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(total[before])
        ids = self.ids[take_ranges(self.at[rows], length)]
        odd = self.odd_documents(data, offsets)
        return self._replace(data, offsets, ids, counts, odd) if len(odd) else (ids, counts)

    def odd_documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents that hold the string of a special token."""
        found: set[int] = set()
        for first in self._special_first:
            at = np.flatnonzero((data[:-1] == first[0]) & (data[1:] == first[1])) if len(data) > 1 else []
            found.update(np.searchsorted(offsets, at, "right") - 1)
        text = lambda k: data[offsets[k] : offsets[k + 1]].tobytes()
        return np.array(sorted(k for k in found if any(s in text(k) for s in self._special_bytes)), np.int64)

    def _replace(self, data, offsets, ids, counts, odd):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in odd:
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            parts[k] = np.array(self.encode_special(text), np.uint32)
        return np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts], np.int64)

    def split_special(self, text: str) -> list[str]:
        """The text cut at special-token strings, which are kept as parts of their own."""
        return re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)


class LibraryEncoder(UnitEncoder):
    """Encodes new units with the tokenizers library, add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = self.spec["model"]
        end = model["end_of_word_suffix"] or ""
        # a plain unit is one piece, and the last token of a piece is one that ends a word
        self.ends = np.zeros(1 + max([*model["vocab"].values(), *self.special.values()]), bool)
        self.ends[[i for t, i in model["vocab"].items() if end and t.endswith(end)]] = True

    def encode_new(self, keys):
        """Plain units go to the library as one text, a word each; others one by one."""
        data, offsets = textcore.flat_text(pa.array(keys, pa.large_binary()))
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(textcore.byte_kinds(data) >= textcore.APOSTROPHE, out=odd[1:])
        plain = odd[offsets[1:]] == odd[offsets[:-1]]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        many = int(plain.sum())
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, many, 16 * JOINED):
            own = [keys[j] for j in order[k : min(many, k + 16 * JOINED)].tolist()]
            got = self._library([b" ".join(own[j : j + JOINED]) for j in range(0, len(own), JOINED)])
            flat = np.fromiter((i for x in got for i in x), np.uint32)
            last = np.flatnonzero(self.ends[flat]) + 1
            if len(last) == len(own) and last[-1] == len(flat):
                ids.append(flat)
                counts.append(np.diff(last, prepend=0))
            else:  # a tokenizer that cuts otherwise
                got = self._library(own)
                ids.append(np.fromiter((i for x in got for i in x), np.uint32))
                counts.append(np.array([len(x) for x in got], np.int64))
        for k in range(many, len(keys), 4096):
            got = self._library([keys[j] for j in order[k : k + 4096].tolist()])
            ids.append(np.fromiter((i for x in got for i in x), np.uint32))
            counts.append(np.array([len(x) for x in got], np.int64))
        flat, n = np.concatenate(ids), np.concatenate(counts)
        at, back = np.cumsum(n) - n, np.argsort(order)
        return flat[take_ranges(at[back], n[back])], n[back]

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def encode_special(self, text):
        return self.library.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple[type, str], UnitEncoder] = {}


def encoder(kind: type[UnitEncoder], path: str) -> UnitEncoder:
    """One encoder per worker process, so that its dictionary serves all of the worker's tasks."""
    key = (kind, path)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]
