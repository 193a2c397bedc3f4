"""Token ids of whole texts by their distinct words, equal to the tokenizers library's own.

Both vocabularies never let a token span white space followed by a word, so a text's ids are those of
its units in order: for the word vocabulary, runs between ASCII white space; for the byte-level one, a
space and what follows it. A unit is encoded by the library once and remembered within bounds. Texts
where that cut could differ (runs of spaces, or special tokens' text) are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_words

#: Units remembered by a worker, at most, by whether they keep their space.
REMEMBERED = {True: 900_000, False: 450_000}

_MARKED = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]").fullmatch


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode_units(path: str, units: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each unit, by the library."""
    t = tokenizer(path)
    return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(units, add_special_tokens=False)]


class UnitEncoder:
    """Encodes batches of texts; spaced: units keep the space before them (byte-level vocabularies)."""

    def __init__(self, path: str, spaced: bool):
        self.path, self.spaced, self.known = path, spaced, {}
        self.marks = dict(zip(",.", encode_units(path, [",", "."]), strict=True))

    def units(self, units: list[str]) -> list[bytes]:
        known = self.known
        got = [known.get(u) for u in units]
        missing = []
        for i, g in enumerate(got):
            if g is None:
                u = units[i]
                # letters and a mark behind them are two tokens' worth in both vocabularies
                base = known.get(u[:-1]) if u[-1:] in (",", ".") and _MARKED(u) else None
                if base is None:
                    missing.append(i)
                else:
                    got[i] = base + self.marks[u[-1]]
        if missing:
            for i, ids in zip(missing, encode_units(self.path, [units[i] for i in missing]), strict=True):
                got[i] = ids
                if len(known) < REMEMBERED[self.spaced] and len(units[i]) < 64:
                    known[units[i]] = ids
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (texts + 1) and the ids of all texts; null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, r"  |\s $" if self.spaced else r"<\|")
        if self.spaced:
            whole = pc.or_(whole, pc.match_substring(texts, "<|"))
        whole = np.flatnonzero(np.asarray(whole.to_numpy(zero_copy_only=False), bool))
        if self.spaced:
            lists = pc.split_pattern(texts, " ")
            offsets, words = np.asarray(lists.offsets).astype(np.int64), lists.flatten()
            offsets = offsets - offsets[0]
        else:
            offsets, words = flat_words(texts)
        coded = words.dictionary_encode()
        index, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        table = self.units([" " + w for w in distinct] if self.spaced else distinct)
        if self.spaced and len(texts):  # first units have no space before them
            first = words.take(pa.array(offsets[:-1])).to_pylist()
            index[offsets[:-1]] = len(table) + np.arange(len(first))
            table = table + [x if f else b"" for f, x in zip(first, self.units([f or "a" for f in first]), strict=True)]
        if len(whole):
            # such a text becomes one unit
            sizes = np.diff(offsets)
            single = np.zeros(len(sizes), bool)
            single[whole] = True
            stays = np.repeat(~single, sizes)
            t = tokenizer(self.path)
            some = texts.take(pa.array(whole)).to_pylist()
            made = [np.array(t.encode(x, add_special_tokens=False).ids, np.uint32).tobytes() for x in some]
            cut = np.concatenate([[0], np.cumsum(np.where(single, 1, sizes))])
            fresh = np.empty(int(cut[-1]), np.int64)
            doc = np.repeat(np.arange(len(sizes)), np.where(single, 1, sizes))
            fresh[~single[doc]] = index[stays]
            fresh[cut[:-1][single]] = len(table) + np.arange(len(made))
            index, offsets, table = fresh, cut, table + made
        lengths = np.fromiter((len(x) >> 2 for x in table), np.int64, len(table))
        flat = np.frombuffer(b"".join(table), np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(table) else np.zeros(0, np.int64)
        size = lengths[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(ends[-1])) + np.repeat(begins[index] - ends[:-1], size)
        return ends[offsets], flat[at]


@functools.cache
def encoder(path: str, spaced: bool) -> UnitEncoder:
    """One for each worker: what it remembers serves the tasks that follow."""
    return UnitEncoder(path, spaced)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each text's ids."""
    return offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], np.uint32(end))
