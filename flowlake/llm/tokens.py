"""Exact, cached use of a public tokenizer inside Spark tasks.

The vocabulary file is named by a parameter and opened on the executors; it is never copied. White space never joins
two tokens of this tokenizer family ("white space dropped"), and letters never join other marks, so a plain text's ids are
the ids of its runs in order. Runs repeat, so each Python worker keeps a bounded memo of run -> ids and hands only new
runs to the library. A run is looked up by a hash and then compared byte by byte; texts whose runs only share a hash with
another, hold a run of more than LONG bytes or are not plain go to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np

from flowlake.llm.hashing import LONG, block, blocks_of, range_hashes, runs

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Entries of the memo of one Python worker; it is emptied beyond this, which changes speed only.
MEMO_LIMIT = 400_000

#: In a text of these characters only, the tokenizer splits runs of letters from runs of other marks, whatever stands
#: around them, and no normal form changes them. Apostrophes and "<|" (contractions, special tokens) are left out.
_ODD = re.compile(r"[^\x00-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]|<\|").search
_CLASSES = np.full(256, 2, dtype=np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
_CLASSES[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunEncoder:
    """``encode_many(texts)`` gives the ids of ``tokenizer.encode(text, add_special_tokens=False)`` as arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1  # ids are below this
        self.closes = np.zeros(self.size, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)  # of the known runs, ascending; the arrays below go with it
        self.begin = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype="<u4")
        self.bytes = np.empty(0, dtype=np.int64)  # of the run itself
        self.text_at = np.empty(0, dtype=np.int64)
        self.text = np.empty(0, dtype=np.uint64)  # the runs' bytes in blocks of eight

    def _library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, runs: list[str], blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        letters = [i for i, r in enumerate(runs) if r[0].isalpha()]
        marks = [i for i, r in enumerate(runs) if not r[0].isalpha()]
        # letter runs go to the library in one text; each ends with the one token that carries the end-of-word mark
        one = np.array(self._library([" ".join(runs[i] for i in letters)])[0] if letters else [], dtype="<u4")
        ends = np.flatnonzero(self.closes[one]) + 1
        if len(ends) != len(letters) or (len(ends) and ends[-1] != len(one)):
            letters, marks, one, ends = [], list(range(len(runs))), one[:0], ends[:0]
        rest = self._library([runs[i] for i in marks])
        more = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
        counts = np.empty(len(runs), dtype=np.int64)
        counts[letters], counts[marks] = np.diff(ends, prepend=0), more
        begin = np.empty(len(runs), dtype=np.int64)
        begin[letters], begin[marks] = ends - counts[letters], len(one) + np.cumsum(more) - more
        flat = np.concatenate([one, np.fromiter(chain.from_iterable(rest), dtype="<u4", count=int(more.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, len(self.flat) + begin)
        self.count = np.insert(self.count, at, counts)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.flat = np.concatenate([self.flat, flat])
        need = (sizes + 7) // 8
        first = np.cumsum(need) - need
        inside = np.arange(int(need.sum())) - np.repeat(first, need)
        text = block(blocks, np.repeat(starts, need) + 8 * inside, np.repeat(sizes, need) - 8 * inside)
        self.text_at = np.insert(self.text_at, at, len(self.text) + first)
        self.bytes = np.insert(self.bytes, at, sizes)
        self.text = np.concatenate([self.text, text])

    def _same(self, place: np.ndarray, blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each run is the very one at its place in the memo."""
        same = self.bytes[place] == sizes
        rows = np.flatnonzero(same)
        j = 0
        while len(rows):
            same[rows] &= self.text[self.text_at[place[rows]] + j] == block(blocks, starts[rows] + 8 * j, sizes[rows] - 8 * j)
            j += 1
            rows = rows[sizes[rows] > 8 * j]
        return same

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of plain texts; None where the memo cannot tell."""
        if len(self.hashes) > MEMO_LIMIT:
            self._clear()
        raw = [t.lower().encode() for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        starts, stops = runs(_CLASSES[data], np.concatenate([[0], ends[:-1]]))
        owner = np.searchsorted(ends, starts, side="right")
        unsure = np.zeros(len(texts), dtype=bool)
        unsure[owner[stops - starts > LONG]] = True
        short = ~unsure[owner]
        starts, stops, owner = starts[short], stops[short], owner[short]
        sizes, blocks = stops - starts, blocks_of(data)
        hashes, first, which = np.unique(range_hashes(data, starts, stops), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        if not known.all():
            new = first[~known]
            self._learn(hashes[~known], [whole[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist())], blocks, starts[new], sizes[new])
            at = np.searchsorted(self.hashes, hashes)
        place = at[which]
        unsure[owner[~self._same(place, blocks, starts, sizes)]] = True
        counts = self.count[place]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.begin[place] - upto[:-1], counts)]
        found = np.split(ids, upto[np.searchsorted(owner, np.arange(1, len(texts)))])
        return [None if u else f for u, f in zip(unsure.tolist(), found)]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Null counts as empty."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not _ODD(t)]
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else []):
            out[i] = ids
        odd = [i for i in range(len(texts)) if out[i] is None]
        for i, ids in zip(odd, self._library([texts[i] for i in odd]) if odd else []):
            out[i] = np.array(ids, dtype="<u4")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> RunEncoder:
    return RunEncoder(path)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
