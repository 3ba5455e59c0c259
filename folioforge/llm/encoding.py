"""Token ids of whole texts with a public tokenizer file, by a bounded cache of words.

The tokenizer's own rules never join or look across ASCII white space, so a
text's ids are the ids of its words in order; each distinct word of a batch is
encoded once and a worker keeps up to ``CACHE_WORDS`` of them between batches.

The tokenizer composes, squeezes white space and lower-cases before it splits.
For texts of characters below U+0300 (but for U+0130) composing changes nothing
and lower case is one letter for another, so such texts are lower-cased as a
column, which leaves fewer words, and these go to the same tokenizer without
its normaliser. All others go to the tokenizer as it is.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "word_bpe_49k.json"
CACHE_WORDS = 250_000
#: Characters of texts that need the tokenizer's own normaliser.
_OTHER = r"[^\x{00}-\x{2ff}]|\x{130}"
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.final = None
        if suffix:
            self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.final[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[bytes]) -> None:
        one, two, normal, other = [], [], [], []
        for w in words:
            t = w.decode()
            if t != t.lower() or not (t.isascii() or max(t) < "\u0300"):
                other.append(t)
            elif self.final is None:
                normal.append(t)
            elif t.isalpha():
                one.append(t)
            elif t[-1:] in ".,;:!?|" and t[:-1].isalpha():
                two.append(t)
            else:
                normal.append(t)
        # Words of letters are one unit, those with a mark at the end two; a unit's last id alone has the suffix, so many are encoded as one text.
        for units, part in ((1, one), (2, two)):
            texts = [" ".join(part[at : at + 20]) for at in range(0, len(part), 20)]
            lists = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(lists), np.uint32)
            ends = np.flatnonzero(self.final[ids])[units - 1 :: units] + 1
            if len(ends) != len(part) or (len(ends) and ends[-1] != len(ids)):
                normal += part
            else:
                self._put(part, ids, ends)
        for tokenizer, part in ((self.plain, normal), (self.tokenizer, other)):
            lists = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._put(part, np.fromiter(chain.from_iterable(lists), np.uint32), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))

    def _put(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        k, end = len(self.index), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)))
        if k + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros(max(len(self.offsets), len(words) + 1), np.int64)))
        self.ids[self.used : end] = ids
        self.offsets[k + 1 : k + 1 + len(words)] = self.used + ends
        self.index.update(zip((w.encode() for w in words), range(k, k + len(words)), strict=True))
        self.used = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) and their bounds, len(texts) + 1."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        own = pc.match_substring_regex(texts, _OTHER)
        texts = pc.if_else(own, texts, pc.utf8_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.clear()
        self._add([w for w in words if w not in self.index])
        of = np.fromiter((self.index[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        starts, sizes = self.offsets[of], self.offsets[of + 1] - self.offsets[of]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        first = bounds[0] if len(bounds) else 0
        return ids, ends[bounds - first]


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
