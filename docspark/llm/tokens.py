"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per task.

A text is cut before a blank or line feed that follows a visible ASCII character or a
two-byte letter, and before an ASCII sign that follows a letter. Both vocabularies split there in any case
(but for a letter whose lower case ends in a mark, which is left out), so the ids of a text are those of its
pieces, one after the other. A hash of the piece finds ids already made. Texts that hold a special token of the
vocabulary are encoded whole, as the library does it.
"""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark import cloudpickle

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces remembered by a task before it starts anew; bounds memory, never results.
REMEMBERED = 1_500_000
#: Pieces encoded as one text.
JOINED = 500


_ALPHA = arrays.separators((0x41, 0x5A), (0x61, 0x7A))
_SIGN = arrays.separators((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: A special token that splits texts and changes nothing beside it: many pieces are encoded as one text with it between them.
        self.between = next((i for i, t in self.tokenizer.get_added_tokens_decoder().items()
                             if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1024, np.uint32)
        self.used = 0

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and how many each has."""
        if self.between is None:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)
        mark = self.added[self.between]
        joined = [mark.join([*texts[i : i + JOINED], ""]) for i in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.between)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        new, sizes = self._ids(texts)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(new)), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.at = np.insert(self.at, place, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.used += len(new)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        data, whole = raw.tobytes(), np.zeros(len(offsets) - 1, bool)
        for content in self.added.values():
            at = data.find(content.encode())
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = data.find(content.encode(), at + 1)
        if not whole.any():
            return self._encode(raw, offsets)
        sizes = np.diff(offsets)
        plain = ~whole
        ids, counts = self._encode(raw[arrays.ragged(offsets[:-1][plain], sizes[plain])], np.concatenate([[0], np.cumsum(sizes[plain])]))
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1][whole].tolist(), offsets[1:][whole].tolist(), strict=True)]
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        total = np.zeros(len(whole), np.int64)
        total[plain], total[whole] = counts, [len(m) for m in made]
        first = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.uint32)
        out[arrays.ragged(first[plain], counts)] = ids
        out[arrays.ragged(first[whole], total[whole])] = np.concatenate(made)
        return out, total

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        before = np.concatenate([[0], raw[:-1]])
        before2 = np.concatenate([[0], before[:-1]])
        plain = (before > 0x20) & (before < 0x7F)
        letter = (before >= 0x80) & (before < 0xC0) & (before2 >= 0xC3) & (before2 <= 0xC9) & ~((before2 == 0xC3) & ((before == 0x97) | (before == 0xB7)))
        letter &= ~((before2 == 0xC4) & (before == 0xB0))  # its lower case ends in a mark
        cut = ((raw == 0x20) | (raw == 0x0A)) & (plain | letter)
        cut |= _SIGN[raw] & (_ALPHA[before] | letter)
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        keys, first, inverse = np.unique(arrays.hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.remembered:
            self._forget()
        place = np.searchsorted(self.known, keys)
        fresh = np.ones(len(keys), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != keys[inside]
        if fresh.any():
            data = raw.tobytes()
            which = first[fresh]
            self._learn(keys[fresh], [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            place = np.searchsorted(self.known, keys)
        sizes = self.size[place][inverse]
        ids = self.pool[arrays.ragged(self.at[place][inverse], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the id ``end``."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    starts = np.cumsum(counts + 1) - (counts + 1)
    out[arrays.ragged(starts, counts)] = ids
    return out, counts + 1
