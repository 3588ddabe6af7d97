"""Subword ids of whole texts, encoded once for each distinct word of a slab of texts.

For the word-level vocabulary white space is dropped and never crosses a token, so a text's ids are
those of its white-space separated words in order. A word that is letters and then closing marks is
encoded in two parts, since a token never holds both. Words are found, told apart and put together
again as arrays; only what a slab holds and the cache lacks goes through the tokenizer.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from loomspark.llm.common import word_spans

#: Distinct parts kept between slabs, and bytes of text of a slab.
_KEPT = 300_000
_SLAB = 8 << 20
_CHUNK = 100
_CLOSING = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_CLOSING = np.zeros(256, bool)
_IS_CLOSING[list(_CLOSING)] = True


def _spread(sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... of each of several runs, end to end."""
    out = np.cumsum(sizes) - sizes
    return np.repeat(begin - out, sizes) + np.arange(int(sizes.sum()))


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which distinct byte string each of several disjoint spans in ascending order is, and those strings."""
    steps = np.zeros(len(raw) + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    held = raw[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


class WordEncoder:
    """Ids below 2**16, with a bounded cache of parts of words as little-endian bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        # lower-case ASCII letters need no normalising and no pattern, only the merges
        bare = json.load(open(path, encoding="utf-8"))
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.letters = Tokenizer.from_str(json.dumps(bare))
        self.known: dict[bytes, bytes] = {b"": b""}

    def forget(self) -> None:
        """Empties the cache."""
        self.known = {b"": b""}

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def _many(self, tokenizer, parts: list[bytes]) -> list[bytes]:
        """Ids of parts of letters only, many in one call; each is one run that ends with a closing id."""
        out = []
        for i in range(0, len(parts), _CHUNK):
            some = parts[i : i + _CHUNK]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u2")
            ends = (2 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += map(self._one, some)
        return out

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        known = self.known
        out = list(map(known.get, parts))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        plain, beyond, cores, tails = [], [], [], []
        for i in gaps:
            part = parts[i]
            if part.isalpha():
                plain.append(i)
                continue
            core = part.rstrip(_CLOSING)
            if not part.isascii() and core.decode().isalpha():
                beyond.append(i)
                cores.append(core)
                tails.append(part[len(core) :])
            else:
                out[i] = self._one(part)
        for i, ids in zip(plain, self._many(self.letters, [parts[i] for i in plain]), strict=True):
            out[i] = ids
        for i, ids, tail in zip(beyond, self._many(self.tokenizer, cores), tails, strict=True):
            out[i] = ids + self._one(tail) if tail else ids
        if len(known) + len(gaps) > _KEPT:
            self.forget()  # frequent parts are in this slab too
            gaps = range(min(len(parts), _KEPT))
        self.known.update((parts[i], out[i]) for i in gaps)
        return out

    def _slab(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(texts).lower()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        raw, (starts, ends) = np.frombuffer(data, np.uint8), word_spans(data)
        if not len(starts):
            return [np.zeros(0, "<u2")] * len(texts)
        core = ends.copy()
        live = np.flatnonzero(_IS_CLOSING[raw[ends - 1]])
        for _ in range(8):
            core[live] -= 1
            live = live[core[live] > starts[live]]
            live = live[_IS_CLOSING[raw[core[live] - 1]]]
        # what still ends in a closing mark, or in a letter or sign beyond ASCII, stays whole
        core[live] = ends[live]
        beyond = (core < ends) & (core > starts) & (raw[core - 1] >= 128)
        core[beyond] = ends[beyond]
        tailed = np.flatnonzero(core < ends)
        which, parts = _distinct(raw, starts, core)
        closing, tails = _distinct(raw, core[tailed], ends[tailed])
        made = self._ids(parts) + self._ids(tails)
        length = np.fromiter(map(len, made), np.int64, len(made)) >> 1
        table, begin = np.frombuffer(b"".join(made), "<u2"), np.cumsum(length) - length
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(core < ends, out=before[1:])
        order = np.empty(len(starts) + len(tailed), np.int64)
        place = np.arange(len(starts)) + before[:-1]
        order[place] = which
        order[place[tailed] + 1] = closing.astype(np.int64) + len(parts)
        size = length[order]
        ids = table[_spread(size, begin[order])]
        upto = np.zeros(len(order) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        first = np.searchsorted(starts, np.r_[np.cumsum(sizes) - sizes, len(raw) + 1])
        cuts = upto[np.r_[place, len(order)][first]]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """16-bit ids of each text; null and empty texts have none. A text with special tokens goes alone."""
        out: list[np.ndarray] = [np.zeros(0, "<u2")] * len(texts)
        slab, weight = [], 0
        for i, text in enumerate(texts):
            if text and b"<|" in text:
                out[i] = np.frombuffer(self._one(text), "<u2")
            elif text:
                slab.append(i)
                weight += len(text)
            if slab and (weight >= _SLAB or i == len(texts) - 1):
                for j, ids in zip(slab, self._slab([texts[j] for j in slab]), strict=True):
                    out[j] = ids
                slab, weight = [], 0
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file, with an empty cache."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].forget()
    return _encoders[path]
