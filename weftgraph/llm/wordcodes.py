"""Token ids of white-space separated words by a public tokenizer: distinct words are merged in arrays and kept between texts."""

from __future__ import annotations

import json
import os

import numpy as np

from .bytescan import SPACE, byte_positions, word_hashes, word_spans
from .stagecache import per_stage

#: Distinct words kept by a worker (about 60 bytes each); a full table starts anew.
KEPT_WORDS = 400_000
#: Words of more bytes are encoded by the library one by one.
LONG_WORD = 48
#: Words that are merged in one table of symbols.
_STEP = 1 << 14
#: Fixed value: how tokenizers of this kind cut words into runs that are merged apart.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Kinds of bytes: ASCII letters, lead byte of lower-case Latin-1 letters, their second bytes, and ASCII marks but the apostrophe.
_LETTER, _LEAD, _SECOND, _MARK = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0xC3] = _LEAD
_KIND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = _SECOND
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Merges of a byte-level BPE model with word ends, applied to many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        symbols = _byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + end] for s in symbols], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        self.none = len(keys)
        self.keys = np.append(keys, -1)
        self.levels, left = [], np.arange(len(keys))
        while len(left):  # keys that meet in a slot go to the next level
            table = np.full(1 << 18, self.none, np.int32)
            slot = self._slot(keys[left], len(self.levels))
            table[slot] = left
            self.levels.append(table)
            left = left[table[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE5AB)) >> np.uint64(46)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols; ``none`` where there is no such merge."""
        keys = a << 20 | b
        out = self.levels[0][self._slot(keys, 0)]
        wrong = np.flatnonzero(self.keys[out] != keys)
        for level in range(1, len(self.levels)):
            out[wrong] = self.levels[level][self._slot(keys[wrong], level)]
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        out[wrong] = self.none
        return out

    def apply(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the number of each word's: the best-ranked pair of a word, leftmost on ties, is merged again and again."""
        order = np.argsort(ends - starts, kind="stable")
        counts, parts = np.zeros(len(starts), np.int64), []
        for i in range(0, len(order), _STEP):
            some = order[i : i + _STEP]
            flat, n = self._table(data, starts[some], ends[some])
            counts[some] = n
            parts.append(flat)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        first = np.cumsum(counts[order]) - counts[order]
        begin = np.empty(len(starts), np.int64)
        begin[order] = first
        return flat[byte_positions(begin, counts)], counts

    def _table(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        n, width = len(starts), int(size.max())
        at = np.arange(width)
        inside = at < size[:, None]
        symbol = np.where(inside, self.inner[data[np.minimum(starts[:, None] + at, len(data) - 1)]], -1)
        row = np.arange(n)
        symbol[row, size - 1] = self.final[data[ends - 1]]
        ranks = np.full((n, width), self.none, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, -1)
            ranks[:, :-1][~inside[:, 1:]] = self.none
        before = np.broadcast_to(at - 1, (n, width)).copy()
        after = np.broadcast_to(at + 1, (n, width)).copy()
        after[row, size - 1] = width
        live, view = row, ranks
        while len(live):
            j = view.argmin(1)
            best = view[np.arange(len(live)), j]
            go = best < self.none
            if not go.all():
                live, j, best = live[go], j[go], best[go]
                view = view[go]
                if not len(live):
                    break
            local = np.arange(len(live))
            gone = after[live, j]
            symbol[live, j] = self.made[best]
            symbol[live, gone] = -1
            nxt = after[live, gone]
            after[live, j] = nxt
            view[local, gone] = self.none
            has = nxt < width
            before[live[has], nxt[has]] = j[has]
            fresh = np.full(len(live), self.none, np.int32)
            fresh[has] = self.rank(symbol[live[has], j[has]], symbol[live[has], nxt[has]])
            view[local, j] = fresh
            prev = before[live, j]
            has = prev >= 0
            view[local[has], prev[has]] = self.rank(symbol[live[has], prev[has]], symbol[live[has], j[has]])
        kept = symbol >= 0
        return symbol[kept], kept.sum(1)


class _Grown:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.values, self.n = np.zeros(1 << 12, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(max(self.n, len(more)) + len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class WordTable:
    """Words by hash, with their bytes and ids in pools. Bytes are compared on every use, so hashes only find places."""

    def __init__(self, dtype):
        self.hash, self.at, self.size, self.id_at, self.id_size = (_Grown(t) for t in (np.uint64, np.int64, np.int32, np.int64, np.int32))
        self.pool, self.ids = _Grown(np.uint8), _Grown(dtype)
        self.slots = np.full(1 << 16, -1, np.int32)

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The word of each hash, -1 where there is none."""
        out, left, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), self._probe(hashes)
        while len(left):
            there = self.slots[slot]
            hit = (there >= 0) & (self.hash.values[there] == hashes[left])
            out[left[hit]] = there[hit]
            on = (there >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, which: np.ndarray) -> None:
        slot = self._probe(self.hash.values[which])
        while len(which):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = which[free]
            on = self.slots[slot] != which
            which, slot = which[on], (slot[on] + 1) & (len(self.slots) - 1)

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add distinct words that are not there yet; their places."""
        new = self.hash.n + np.arange(len(hashes))
        size = ends - starts
        self.at.append(self.pool.n + np.cumsum(size) - size)
        self.id_at.append(self.ids.n + np.cumsum(counts) - counts)
        for grown, values in ((self.hash, hashes), (self.size, size), (self.id_size, counts), (self.pool, data[byte_positions(starts, size)]), (self.ids, ids)):
            grown.append(values)
        if self.hash.n * 2 > len(self.slots):
            while self.hash.n * 2 > len(self.slots):
                self.slots = np.full(len(self.slots) * 4, -1, np.int32)
            self._insert(np.arange(self.hash.n))
        else:
            self._insert(new)
        return new


class WordEncoder:
    """Ids of whole texts for tokenizers that drop white space and never look across it.

    Such a tokenizer's ids of a text are the ids of its words one after another, so each distinct word is encoded once.
    Words of plain letters, with or without ASCII marks behind them, are merged in arrays; others go through the library.
    Ids are little-endian, of two bytes where the vocabulary allows, else of four.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, cuts = parts["model"], json.dumps(parts["pre_tokenizer"])
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and json.dumps(_PATTERN) in cuts and "ByteLevel" in cuts and '"Lowercase"' in json.dumps(parts["normalizer"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]) if plain else None
        self.table = WordTable(self.dtype)

    def _apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        size = ends - starts
        plain = size <= (LONG_WORD if self.merges else 0)
        values, cut = np.zeros(0, np.int64), ends
        if plain.any():
            # a plain word is letters, then marks: no letter follows a mark, and Latin-1 letters are whole
            at = byte_positions(starts, size)
            owner = np.repeat(np.arange(len(starts)), size)
            kind = _KIND[data[at]]
            marks = np.bincount(owner[kind == _MARK], minlength=len(starts))
            cut = ends - marks
            pair = (kind == _LEAD) & np.append(kind[1:] == _SECOND, False)
            second = np.concatenate([[False], pair[:-1]])
            good = np.where(at >= cut[owner], kind == _MARK, (kind == _LETTER) | pair | second)
            plain &= np.bincount(owner[~good], minlength=len(starts)) == 0
        own = np.flatnonzero(plain)
        if len(own):
            begins = np.stack([starts[own], cut[own]], 1).ravel()
            stops = np.stack([cut[own], ends[own]], 1).ravel()
            full = stops > begins
            values, n = self.merges.apply(_LOWER[data], begins[full], stops[full])
            both = np.zeros(len(begins), np.int64)
            both[full] = n
            counts[own] = both.reshape(-1, 2).sum(1)
        rest = np.flatnonzero(~plain)
        found = self._apart(data, starts[rest], ends[rest])
        counts[rest] = [len(x) for x in found]
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        out[byte_positions(first[own], counts[own])] = values
        if len(rest):
            out[byte_positions(first[rest], counts[rest])] = np.concatenate(found)
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by the id ``end`` if given; and where each begins (n + 1)."""
        table = self.table
        if table.hash.n > KEPT_WORDS:
            table = self.table = WordTable(self.dtype)
        starts, ends, firsts = word_spans(data, offsets, ~SPACE)
        hashes = word_hashes(data, starts, ends)
        word = table.find(hashes)
        new = np.flatnonzero(word < 0)
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            some = new[first]
            ids, counts = self._ids_of(data, starts[some], ends[some])
            word[new] = table.add(distinct, data, starts[some], ends[some], ids, counts)[back]
        size = ends - starts
        counts = table.id_size.values[word].astype(np.int64)
        out = table.ids.values[byte_positions(table.id_at.values[word], counts)]
        other = table.size.values[word] != size
        same = np.flatnonzero(~other)
        differs = table.pool.values[byte_positions(table.at.values[word[same]], size[same])] != data[byte_positions(starts[same], size[same])]
        if differs.any():
            other[same[np.repeat(np.arange(len(same)), size[same])[differs]]] = True
        if other.any():  # two words of one hash: those that are not the table's are encoded here
            wrong = np.flatnonzero(other)
            ids, n = self._ids_of(data, starts[wrong], ends[wrong])
            was = np.cumsum(counts) - counts
            keep = np.flatnonzero(~other)
            old, counts[wrong] = counts.copy(), n
            now = np.cumsum(counts) - counts
            fixed = np.zeros(int(counts.sum()), out.dtype)
            fixed[byte_positions(now[keep], counts[keep])] = out[byte_positions(was[keep], old[keep])]
            fixed[byte_positions(now[wrong], n)] = ids
            out = fixed
        total = np.concatenate([[0], np.cumsum(counts)])[firsts]
        if end is not None:
            out = np.insert(out, total[1:], self.dtype.type(end))
            total = total + np.arange(len(total))
        return out, total


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    return per_stage(("words", path, special_as_text), lambda: WordEncoder(path, special_as_text))
