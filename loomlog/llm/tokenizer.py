"""Byte-level BPE ids of many texts at once.

The ids are those of the ``tokenizers`` library with ``byte_bpe_50k.json``. Texts repeat their words
often, so a batch is cut into its pieces with numpy, the library encodes each distinct piece once, and the ids are
gathered back. Texts with characters beyond ASCII and Latin letters, with an apostrophe or with the text of a special token go
through the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

_PLAIN_ONLY = re.compile("['\x80-\xbf\xd7\xf7ƀ-\U0010ffff]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = _LETTER
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class BatchTokenizer:
    """``encode(texts)`` gives the ids of each text as numpy ``uint32`` arrays.

    The text of a special token, such as ``<|endoftext|>``, becomes its id, as is the library's default; with
    ``special_text`` it is text like any other. ``chunk_bytes`` and ``most_known`` (pieces kept between chunks) bound the memory, not the result.
    """

    def __init__(self, path: str, special_text: bool = False, chunk_bytes: int = 3_000_000, most_known: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_text
        self.special = [] if special_text else [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.chunk_bytes = chunk_bytes
        self.most_known = most_known

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes the pieces not yet known."""
        if len(self.known) > self.most_known:
            self.known.clear()
        new = [x for x in pieces if x not in self.known]
        for piece, found in zip(new, self.library.encode_batch_fast([x.decode() for x in new], add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held, at, size = [], [], 0
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, np.uint32)
            elif "'" in text or not text.isascii() and _PLAIN_ONLY.search(text) or any(x in text for x in self.special):
                out[k] = self.plain(text)
            else:
                held.append(text.encode())
                at.append(k)
                size += len(held[-1])
                if size >= self.chunk_bytes:
                    self._put(out, at, held)
                    held, at, size = [], [], 0
        if held:
            self._put(out, at, held)
        return out

    def _put(self, out: list, at: list[int], held: list[bytes]) -> None:
        for k, ids in zip(at, self._pieces(held), strict=True):
            out[k] = ids

    def _pieces(self, docs: list[bytes]) -> list[np.ndarray]:
        buf = b"".join(docs) + bytes(16)
        n = len(buf) - 16
        raw = np.frombuffer(buf, np.uint8)[:n]
        kind = _CLASS[raw]
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        word = np.zeros(n, bool)  # follows white space of the same text
        word[1:] = (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)
        word[first] = False
        at = np.flatnonzero(word)
        start[at] = raw[at - 1] != 32
        start[at - 1] = True  # the last white space of a run stands alone or goes with the word
        start[first] = True
        starts = np.flatnonzero(start)
        lens = np.diff(starts, append=n)
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(buf, "<u8", 1), (n + 9,), (1,))
        low = eight[starts] & _MASK[np.minimum(lens, 8)]
        high = eight[np.minimum(starts + 8, n)] & _MASK[np.clip(lens - 8, 0, 8)]
        size = np.minimum(lens, 17).astype(np.uint64)
        longer: dict[bytes, int] = {}
        for k in np.flatnonzero(lens > 16):
            low[k] = longer.setdefault(buf[starts[k] : starts[k] + lens[k]], len(longer))
            high[k] = 0
        key = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + size) * np.uint64(0xC2B2AE3D27D4EB4F))
        key ^= key >> np.uint64(29)
        code, found = pd.factorize(key)
        rep = np.empty(len(found), np.int64)
        rep[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if not (np.array_equal(low[rep][code], low) and np.array_equal(high[rep][code], high) and np.array_equal(size[rep][code], size)):
            return [self.plain(d.decode()) for d in docs]  # two pieces share a key
        pieces = [buf[a:b] for a, b in zip(starts[rep].tolist(), (starts[rep] + lens[rep]).tolist(), strict=True)]
        self._learn(pieces)
        ids = [self.known[x] for x in pieces]
        many = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(many) - many
        per = many[code]
        upto = np.cumsum(per)
        total = int(upto[-1])
        every = flat[np.repeat(begin[code] - (upto - per), per) + np.arange(total)]
        cuts = (upto - per)[np.searchsorted(starts, first)]
        return np.split(every, cuts[1:])


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None, special_text: bool = False) -> BatchTokenizer:
    """One per Python worker. ``None``: ``byte_bpe_50k.json`` as installed on the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return BatchTokenizer(path, special_text)
