"""Token ids of whole batches of texts for a BPE vocabulary with word ends, without a call per word.

The vocabulary's tokenizer lower-cases, drops white space, splits at changes between letters, single
digits and other marks, and merges bytes inside each of these pieces. Words of ASCII and of Latin letters
whose UTF-8 starts with 0xC3 are split and merged here, all distinct pieces of a batch side by side; all
other words (other scripts, apostrophes, ``<``, control characters, long pieces) go to the tokenizer
itself, once per distinct word. Nothing is remembered between batches, so memory is bounded.
"""

from __future__ import annotations

import json

import numpy as np

from nearfield.llm import textbatch as tb

LONGEST = 40
NONE = np.int64(1 << 40)
_LETTER, _DIGIT, _MARK, _GAP = range(4)

_CLASS = np.full(256, _MARK, np.int8)
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[0x80:] = _LETTER
_CLASS[tb.SPACE] = _GAP
_HARD = np.zeros(256, bool)
_HARD[:0x20] = _HARD[0x7F:] = True
_HARD[[ord("'"), ord("<")]] = True
_HARD[tb.SPACE] = False


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        names = byte_names()
        self.inner = np.array([vocab[n] for n in names], np.int64)
        self.final = np.array([vocab[n + "</w>"] for n in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge and the token it makes, as rank << 20 | token; NONE if there is no such merge."""
        key = (left << 20) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), (self.rank[at] << 20) + self.made[at], NONE)

    def merge(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one length, given as rows of bytes: padded with -1, and how many each has.

        Every round applies, in each piece, the first merge of least rank.
        """
        ids = self.inner[pieces]
        ids[:, -1] = self.final[pieces[:, -1]]
        n, width = ids.shape
        out, size = ids.copy(), np.full(n, width)
        if width == 1:
            return out, size
        live = np.arange(n)
        ranks = self._ranked(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(ranks)), best]
            going = value < NONE
            if not going.all():
                done = ~going
                out[live[done], : ids.shape[1]] = ids[done]
                out[live[done], ids.shape[1] :] = -1
                live, ids, ranks, best, value = live[going], ids[going], ranks[going], best[going], value[going]
            if not len(live):
                return out, size
            row = np.arange(len(live))
            size[live] -= 1
            ids[row, best] = value & 0xFFFFF
            column = np.arange(ids.shape[1] - 1)
            ids = np.where(column <= best[:, None], ids[:, :-1], ids[:, 1:])
            if ids.shape[1] == 1:
                out[live, 0] = ids[:, 0]
                out[live, 1:] = -1
                return out, size
            column = column[:-1]
            ranks = np.where(column < best[:, None], ranks[:, :-1], ranks[:, 1:])
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
            ranks[before, best[before] - 1] = self._ranked(ids[before, best[before] - 1], ids[before, best[before]])
            ranks[after, best[after]] = self._ranked(ids[after, best[after]], ids[after, best[after] + 1])

    def encode(self, part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their n+1 offsets."""
        starts, ends, _ = tb.word_bounds(part, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        behind = np.zeros(len(part), bool)
        behind[1:] = part[:-1] == 0xC3
        hard = _HARD[part]
        hard &= ~(((part == 0xC3) | behind) & (part >= 0x80))
        hard |= behind & ((part == 0x97) | (part == 0xB7))
        lower = tb.ASCII_LOWER[part]
        lower[behind & (part >= 0x80) & (part <= 0x9E)] += 32
        count = np.concatenate(([0], np.cumsum(hard)))
        other = count[ends] > count[starts]

        kind = _CLASS[part]
        change = np.zeros(len(part) + 1, np.int32)
        np.add.at(change, starts[other], 1)
        np.add.at(change, ends[other], -1)
        kind[np.cumsum(change[:-1]) > 0] = _GAP
        edge = np.ones(len(part), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        inner = offsets[:-1]
        edge[inner[inner < len(part)]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(part))
        some = kind[begin] != _GAP
        begin, end = begin[some], end[some]

        pool, at = [], 0
        place, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        if len(begin):
            _, example, back = np.unique(tb.word_hashes(lower, begin, end), return_index=True, return_inverse=True)
            length = end[example] - begin[example]
            where, many = np.zeros(len(example), np.int64), np.zeros(len(example), np.int64)
            for width in np.unique(length):
                here = np.flatnonzero(length == width)
                rows = begin[example[here]]
                if width <= LONGEST:
                    ids, n = self.merge(lower[rows[:, None] + np.arange(width)])
                    flat = ids[ids >= 0]
                else:
                    found = self._plain([lower[r : r + width] for r in rows])
                    n, flat = np.array([len(x) for x in found]), np.array([i for x in found for i in x], np.int64)
                where[here], many[here] = at + np.cumsum(n) - n, n
                pool.append(flat)
                at += len(flat)
            place, size = where[back], many[back]
        if other.any():
            a, b = starts[other], ends[other]
            _, example, back = np.unique(tb.word_hashes(part, a, b), return_index=True, return_inverse=True)
            found = self._plain([part[a[i] : b[i]] for i in example])
            n = np.array([len(x) for x in found])
            pool.append(np.array([i for x in found for i in x], np.int64))
            begin = np.concatenate((begin, a))
            order = np.argsort(begin, kind="stable")
            begin = begin[order]
            place = np.concatenate((place, (at + np.cumsum(n) - n)[back]))[order]
            size = np.concatenate((size, n[back]))[order]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = np.concatenate(pool)[np.arange(upto[-1]) + np.repeat(place - upto[:-1], size)].astype(np.uint32)
        return ids, upto[np.searchsorted(begin, offsets)]

    def _plain(self, words: list[np.ndarray]) -> list[list[int]]:
        texts = [w.tobytes().decode("utf-8", "replace") for w in words]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
