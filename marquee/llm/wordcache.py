"""Tokenizer ids of whole text columns, with about one tokenizer call for each distinct word.

Both kinds of tokenizer used here never let a token span a lone white-space character: one drops
white space, the other attaches a single space to the word after it. So a text can be cut at lone
spaces and line feeds, the distinct pieces of a batch encoded once, less the punctuation at their end, and the ids put together by
array indexing. A text with runs of white space, where these rules don't hold, is encoded whole.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two adjacent white-space characters of any kind, or the separator that the cut uses.
_RUN = r"[\t-\r\x1c- \x{85}\pZ]{2}|\x01"


#: Punctuation that both tokenizers cut off a letter or digit before it.
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_in_worker: dict[tuple, "WordCacheTokenizer"] = {}


class WordCacheTokenizer:
    """``encode(column)`` gives the ids of every text and the offsets of the texts.

    keeps_space: the tokenizer has ids for white space (byte-level kind). capacity: words in each of
    two generations that are remembered; it bounds memory and never changes a result.
    """

    def __init__(self, path: str, keeps_space: bool, capacity: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.capacity = keeps_space, capacity
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, keeps_space: bool) -> "WordCacheTokenizer":
        """One for each Python worker: later tasks find the words of earlier ones."""
        key = (path, keeps_space)
        if key not in _in_worker:
            _in_worker[key] = cls(path, keeps_space)
        return _in_worker[key]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _remember(self, words: set[str]) -> dict[str, bytes]:
        """A map that has the ids of all ``words``, as packed 32-bit numbers."""
        young, old = self.young, self.old
        new = words - young.keys()
        again = new & old.keys()
        young.update(zip(again, map(old.__getitem__, again)))
        missing = list(new - again)
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            coded = self._whole(part)
            flat = np.fromiter(chain.from_iterable(coded), np.uint32).tobytes()
            ends = list(accumulate(map(len, coded)))
            young.update(zip(part, [flat[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]))
        if len(young) > self.capacity:
            self.young, self.old = {}, young
        return young

    def _coded(self, pieces: list[str], special: bool) -> list[bytes]:
        """The ids of each piece: those of the part before its last punctuation, then those of that."""
        if special:
            known = self._remember(set(pieces))
            return [known[p] for p in pieces]
        stems = [s if s and s[-1].isalnum() else p for p, s in zip(pieces, [p.rstrip(_TAIL) for p in pieces])]
        tails = [p[len(s) :] for p, s in zip(pieces, stems)]
        known = self._remember({*stems, *tails})
        return [known[s] + known[t] if t else known[s] for s, t in zip(stems, tails)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column.cast(pa.string()), "")
        special = bool(pc.any(pc.match_substring(column, "<|")).as_py())
        if self.keeps_space:
            odd = pc.match_substring_regex(column, _RUN)
            cut = pc.replace_substring(pc.replace_substring(column, " ", "\x01 "), "\n", "\x01\n\x01")
            lists = pc.split_pattern(cut, "\x01")
        else:
            odd = None
            cut = pc.replace_substring(column, "\n", " ")
            if not special:  # the case of a special token counts
                cut = pc.ascii_lower(cut)
            lists = pc.split_pattern(cut, " ")
        pieces = lists.flatten().dictionary_encode()
        coded = self._coded(pieces.dictionary.to_pylist(), special)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        store = np.frombuffer(b"".join(coded), np.uint32)
        place = pieces.indices.to_numpy()
        lengths = sizes[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = store[np.repeat((np.cumsum(sizes) - sizes)[place] - ends + lengths, lengths) + np.arange(total)]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        offsets = np.concatenate([[0], ends])[bounds]
        if odd is None or not pc.any(odd).as_py():
            return ids, offsets
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = dict(zip(rows.tolist(), self._whole(column.take(pa.array(rows)).to_pylist())))
        parts = [np.array(whole[i], np.uint32) if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(column))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Like encode, with ``end_id`` after each text."""
        ids, offsets = self.encode(column)
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
