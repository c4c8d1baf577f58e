"""Periodic runs of words: Re-Pair grammars over the stretches that can hold one, runs across each rule's boundary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .bytescan import SPACE, byte_positions, gram_hashes, mix, text_chunks, word_hashes, word_spans

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Any so many consecutive words of a run occur in it again: with length >= max(24, 3 q), a window of 9 words moved by
#: the period to one side or the other stays inside. Words of no such window are in no run.
WINDOW = 9
#: Both ways of finding a period compare so many words next to a boundary (see :func:`_crossing`).
ANCHOR_LEVEL = 2
#: Pairs (boundary, period) that one numpy step compares.
STEP_PAIRS = 1 << 20


def _stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of words that can hold a run: all its windows of WINDOW words recur in their text."""
    grams = gram_hashes(words, WINDOW)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + WINDOW <= first[text + 1]
    key = mix(grams + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    order = order[inside[order]]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(grams) + 2, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    start, end = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])  # a text's last windows are not inside, so none spans two
    long = end - start >= LEAST_WORDS - WINDOW + 1
    return start[long], end[long] + WINDOW - 1


def re_pair(symbols: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right) numbered on from ``symbols.max() + 1``, and the last sequence with its stretches.

    Re-Pair in rounds: every pair that is the most frequent one among the pairs that overlap it is replaced, everywhere
    where that holds and from left to right in runs of itself, if at least two places stay. Pairs of two stretches are none.
    """
    base = fresh = int(symbols.max()) + 1 if len(symbols) else 0
    left, right = [], []
    while len(symbols) > 1:
        valid = stretch[1:] == stretch[:-1]
        pair, at, times = np.unique(symbols[:-1] * fresh + symbols[1:], return_inverse=True, return_counts=True)
        times = np.bincount(at, weights=valid, minlength=len(pair)).astype(np.int64) if not valid.all() else times
        rank = np.empty(len(pair), np.int64)
        rank[np.lexsort((pair, times))] = np.arange(1, len(pair) + 1)
        weight = np.where(valid & (times[at] > 1), rank[at], 0)
        head = np.concatenate([[True], (weight[1:] != weight[:-1]) | (weight[1:] == 0)])
        group = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        end = np.concatenate([begin[1:], [len(weight)]])
        around = np.concatenate([[0], weight, [0]])
        best = (weight[begin] > around[begin]) & (weight[begin] > around[end + 1])
        place = np.flatnonzero(best[group] & ((np.arange(len(weight)) - begin[group]) % 2 == 0))
        often = np.bincount(at[place], minlength=len(pair))
        place = place[often[at[place]] > 1]
        if not len(place):
            break
        used = np.flatnonzero(often > 1)
        number = np.zeros(len(pair), np.int64)
        number[used] = fresh + np.arange(len(used))
        left.append(pair[used] // fresh)
        right.append(pair[used] % fresh)
        symbols = symbols.copy()
        symbols[place] = number[at[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, stretch, fresh = symbols[keep], stretch[keep], fresh + len(used)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none), symbols, stretch if base else none


def _names(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each power of two, equal numbers for equal windows of so many words; a window past its stretch is like no other."""
    out, width, room = [codes.astype(np.int32)], 1, ends - np.arange(len(codes))
    while 2 * width <= int(room.max(initial=0)):
        now = out[-1].astype(np.int64)
        whole = np.flatnonzero(room >= 2 * width)
        name = np.arange(len(codes), dtype=np.int32)
        name += len(codes)
        name[whole] = np.unique(now[whole] * (2 * len(codes) + 1) + now[whole + width], return_inverse=True)[1]
        out.append(name)
        width *= 2
    return out


def _common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that stay equal from places ``a`` and ``b`` on (before them, if ``back``), ``limit`` at most."""
    found = np.zeros(len(a), np.int64)
    last = len(names[0]) - 1
    for level in range(len(names) - 1, -1, -1):
        width = 1 << level
        shift = -found - width if back else found
        same = found + width <= limit
        same &= names[level][np.clip(a + shift, 0, last)] == names[level][np.clip(b + shift, 0, last)]
        found[same] += width
    return found


def _crossing(names: list[np.ndarray], lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs inside [lo, hi) that cross mid, for all nodes at once; also non-smallest periods.

    Half of a run lies on one side of mid: 12 words and 1.5 periods at least. So the four words next to mid on that side
    recur one period further on, and the places of these four words in that side are the only periods to compare.
    """
    n = len(names[0])
    none = np.zeros(0, np.int64)
    if len(names) <= ANCHOR_LEVEL or not len(lo):
        return none, none, none, none
    width = 1 << ANCHOR_LEVEL
    key = names[ANCHOR_LEVEL].astype(np.int64) * n + np.arange(n)
    key.sort()
    parts = []
    for back in (False, True):
        side = mid - lo if back else hi - mid
        nodes = np.flatnonzero(side >= LEAST_WORDS // 2)
        anchor = mid[nodes] - width if back else mid[nodes]
        name, most = names[ANCHOR_LEVEL][anchor].astype(np.int64) * n, side[nodes] * 2 // 3
        if back:
            begin, end = np.searchsorted(key, name + np.maximum(anchor - most, lo[nodes])), np.searchsorted(key, name + anchor)
        else:
            begin, end = np.searchsorted(key, name + anchor, "right"), np.searchsorted(key, name + anchor + most, "right")
        total = np.cumsum(end - begin)
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + STEP_PAIRS, "right")))
            size = (end - begin)[first:last]
            node = np.repeat(nodes[first:last], size)
            period = np.abs(key[byte_positions(begin[first:last], size)] % n - np.repeat(anchor[first:last], size))
            one = mid[node] - period if back else mid[node]
            two = one + period
            start = one - _common(names, one, two, one - lo[node], back=True)
            stop = two + _common(names, one, two, hi[node] - two)
            good = (stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)) & (start < mid[node]) & (stop > mid[node])
            parts.append((node[good], start[good], stop[good], period[good]))
            first = last
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (none, none, none, none)


def _derivations(left: np.ndarray, right: np.ndarray, base: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every symbol, first places of the last sequence's symbols, and (rule, place) of every node of all derivations."""
    size = np.ones(base + len(left), np.int64)
    for i in range(len(left)):  # a rule's two symbols are older than the rule
        size[base + i] = size[left[i]] + size[right[i]]
    begin = np.concatenate([[0], np.cumsum(size[symbols])[:-1]]) if len(symbols) else np.zeros(0, np.int64)
    rules, places, now, at = [], [], symbols, begin
    while True:
        inner = now >= base
        now, at = now[inner] - base, at[inner]
        if not len(now):
            break
        rules.append(now)
        places.append(at)
        now, at = np.concatenate([left[now], right[now]]), np.concatenate([at, at + size[left[now]]])
    none = np.zeros(0, np.int64)
    return size, begin, np.concatenate(rules) if rules else none, np.concatenate(places) if places else none


def _top_nodes(begin: np.ndarray, size: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, mid, hi) of a balanced tree over the last sequence of every stretch: one node for each boundary."""
    new = np.concatenate([[True], stretch[1:] != stretch[:-1]]) if len(stretch) else np.zeros(0, bool)
    origin = np.flatnonzero(new)[np.cumsum(new) - 1] if len(stretch) else np.zeros(0, np.int64)
    index = np.arange(len(stretch)) - origin
    count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(stretch) else index
    end = begin + size
    half = index & -index
    inner = np.flatnonzero(index > 0)
    last = origin[inner] + np.minimum(index[inner] + half[inner], count[inner]) - 1
    return begin[inner - half[inner]], begin[inner], end[last]


def word_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs of the texts with word hashes ``words[first[i]:first[i + 1]]``, in order of start and period.

    The stretches that can hold runs are compressed to one grammar. Runs across a rule's boundary are computed at one of
    its derivations and translated to all; boundaries of the last sequence are nodes of a balanced tree. The lowest node
    that holds a run whole finds it whole; what nodes below find of it is merged into it. Equal intervals keep the least period.
    """
    none = np.zeros(0, np.int64)
    opens, closes = _stretches(words, first)
    if not len(opens):
        return none, none, none, none
    length = closes - opens
    where = byte_positions(opens, length)
    stretch = np.repeat(np.arange(len(opens)), length)
    codes = np.unique(words[where], return_inverse=True)[1].astype(np.int64)
    shut = np.cumsum(length)
    names = _names(codes, np.repeat(shut, length))
    left, right, symbols, owner = re_pair(codes, stretch)
    base = int(codes.max()) + 1
    size, begin, rules, places = _derivations(left, right, base, symbols)
    sample = np.full(len(left), len(codes), np.int64)
    np.minimum.at(sample, rules, places)
    top = _top_nodes(begin, size[symbols], owner)
    lo, mid, hi = (np.concatenate(x) for x in zip((sample, sample + size[left], sample + size[base:]), top))
    node, start, end, period = _crossing(names, lo, mid, hi)
    order = np.argsort(node, kind="stable")
    node, start, end, period = node[order], start[order], end[order], period[order]
    own = np.searchsorted(node, np.arange(len(left) + 1))
    times = (own[1:] - own[:-1])[rules]
    use = byte_positions(own[:-1][rules], times)
    moved = np.repeat(places, times) - lo[node[use]]
    at_top = slice(own[-1], None)
    s = np.concatenate([start[use] + moved, start[at_top]])
    e = np.concatenate([end[use] + moved, end[at_top]])
    q = np.concatenate([period[use], period[at_top]])
    if not len(s):
        return none, none, none, none
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    far = 1 + int(e.max())
    group = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]]))
    reach = np.maximum.accumulate(e + group * far) - group * far
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (s[1:] > reach[:-1] - q[1:])])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(new)]]) - 1
    s, e, q = s[new], reach[last], q[new]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    only = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])
    s, e, q = s[only], e[only], q[only]
    start, end = where[s], where[e - 1] + 1
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((q, start))
    return text[order], start[order] - first[text[order]], end[order] - first[text[order]], q[order]


def _altered(ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """The number of the word that stands at each place: itself but for the tails that repeat by rule."""
    out = np.arange(first[-1])
    for k, (h, n) in enumerate(zip(ids.to_pylist(), np.diff(first).tolist())):
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return out


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | tuple[None, None, None, None]:
    """The run of greatest length by period, then least start and period, with a thousand times that quotient."""
    if not runs:
        return None, None, None, None
    start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


_RUN = [(c, pa.int64()) for c in ("start", "length", "period")]
_COLUMNS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct(_RUN)))]
)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs) of every row. No shuffle.

    Words are runs of anything but ASCII white space, told apart by 64-bit hashes. A run is a stretch of at least 24 words
    and three periods that cannot grow keeping its smallest period. ``runs`` lists them by start and period; start, length,
    period and exponent are those of the run of greatest length by period, nulls where there is none. The digests are of
    every run's ``start,length,period`` line and of the words that stay when each run keeps its first period alone.

    ``planted``: texts whose id's CRC-32 (as decimal text) is divisible by 10 get a repeating tail first; a null id gives none.
    Null and empty texts have no words and no runs. Rows repeat as often as in ``docs``, ids may be null or repeat, other
    columns are not read, and an empty table gives an empty result. A text is held by one task, about 40 times its size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            starts, ends, first = word_spans(data, offsets, ~SPACE)
            hashes = word_hashes(data, starts, ends)
            if planted:
                at = _altered(rows.column("h"), first)
                starts, ends, hashes = starts[at], ends[at], hashes[at]
            text, begin, end, period = word_runs(hashes, first)
            dropped = np.zeros(first[-1] + 1, np.int64)
            np.add.at(dropped, first[text] + begin + period, 1)
            np.add.at(dropped, first[text] + end, -1)
            kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
            size = (ends - starts)[kept]
            close = np.cumsum(size + 1)  # each word and a space
            joined = np.full(close[-1] if len(close) else 0, 0x20, np.uint8)
            joined[byte_positions(close - size - 1, size)] = data[byte_positions(starts[kept], size)]
            bound = np.concatenate([[0], close])[np.searchsorted(kept, first)].tolist()
            view = memoryview(joined)
            own = np.searchsorted(text, np.arange(rows.num_rows + 1)).tolist()
            found = list(zip(begin.tolist(), (end - begin).tolist(), period.tolist()))
            out = []
            for k in range(rows.num_rows):
                runs = found[own[k] : own[k + 1]]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rest = view[bound[k] : max(bound[k], bound[k + 1] - 1)]
                out.append((len(runs), *_best(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), _COLUMNS.types[1:]))], schema=_COLUMNS)

    key = F.col(id_col).cast("long").alias("doc_id")
    mark = F.crc32(F.col(id_col).cast("long").cast("string")).alias("h")
    return docs.select(key, mark, F.col(text_col).cast("string").alias("text")).mapInArrow(run, from_arrow_schema(_COLUMNS))
