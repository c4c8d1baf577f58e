"""SentencePiece BPE encoding and decoding: pieces are found in a batch's suffix array, then merged by relaxation."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import text_chunks
from .stagecache import per_stage

#: Bytes of text of a batch, and of distinct chunks of one suffix array; distinct chunks that a task keeps; and the longest
#: chunk (in characters) that is merged along with others.
BATCH_BYTES, ARRAY_BYTES, KEPT_CHUNKS, LONG_CHUNK = 4 << 20, 1 << 19, 800_000, 256
_SPACE = "▁".encode()
_CHUNK = re.compile(rb" +[^ ]*")
_STOP = 0xFF


class PieceModel:
    """Pieces, scores and byte fallback of a BPE model whose pieces hold spaces only in front."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character")
        self.text = [p.encode() for p in pieces]
        self.id = np.array(ids, np.int64)
        self.rank = np.empty(len(ids), np.int64)
        self.rank[np.argsort([-sp.get_score(i) for i in ids], kind="stable")] = np.arange(len(ids))
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.longest = int(self.size.max())
        self.prefix = sp.encode("a", out_type=str)[0].startswith("▁")
        self.unknown = sp.unk_id()
        self.fallback = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.has_fallback = bool(sp.is_byte(int(self.fallback[0])))
        width = -(-self.longest // 8)
        raw = np.zeros((len(ids), width * 8), np.uint8)
        for i, t in enumerate(self.text):
            raw[i, : len(t)] = np.frombuffer(t, np.uint8)
        self.keys = raw.view(">u8").astype(np.uint64)
        self.masks = (np.where(np.arange(width * 8) < self.size[:, None], 255, 0).astype(np.uint8)).view(">u8").astype(np.uint64)
        self.bytes_of = {int(i): t.replace(_SPACE, b" ") for i, t in zip(ids, self.text)}
        if self.has_fallback:
            self.bytes_of |= {int(i): bytes([b]) for b, i in enumerate(self.fallback)}
        for i in range(sp.get_piece_size()):
            self.bytes_of.setdefault(i, b"" if sp.is_control(i) else " ⁇ ".encode())
        self.dtype = np.dtype("<u2" if sp.get_piece_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}

    # -- edges ---------------------------------------------------------------------------------------------------

    def suffix_order(self, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions ``begin`` sorted by the bytes that follow them, as far as the longest piece or the chunk's end, and those bytes."""
        width = self.keys.shape[1]
        padded = np.concatenate([text, np.full(width * 8, _STOP, np.uint8)])
        eight = np.zeros(len(text) + (width - 1) * 8, np.uint64)
        for i in range(8):
            eight = eight << np.uint64(8) | padded[i : i + len(eight)]
        stops = np.flatnonzero(text == _STOP)
        left = stops[np.searchsorted(stops, begin)] - begin
        past = np.array([(1 << 8 * (8 - i)) - 1 for i in range(8)] + [0], np.uint64)
        words = np.stack([eight[begin + 8 * i] | past[np.clip(left - 8 * i, 0, 8)] for i in range(width)])
        order = np.argsort(words[0])
        new = np.concatenate([[True], np.diff(words[0][order]) != 0])
        for i in range(1, width):
            tied = ~new & (words[i - 1][order] & np.uint64(255) != _STOP)
            if not tied.any():
                break
            both = np.flatnonzero(tied | np.append(tied[1:], False))
            name = np.cumsum(new)[both]
            order[both] = order[both][np.lexsort((words[i][order[both]], name))]
            fine = words[i][order[both]]
            new[both[1:][(name[1:] != name[:-1]) | (fine[1:] != fine[:-1])]] = True
        return begin[order], words[:, order]

    def ranges(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last place of each piece in the sorted suffixes, by binary search of all pieces at once."""
        n, ends = words.shape[1], []
        for past in (False, True):
            low, high = np.zeros(len(self.text), np.int64), np.full(len(self.text), n, np.int64)
            while (open_ := low < high).any():
                mid = np.minimum((low + high) // 2, n - 1)
                before, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for i in range(len(words)):
                    there = words[i][mid] & self.masks[:, i]
                    before |= equal & (there < self.keys[:, i])
                    equal &= there == self.keys[:, i]
                go = open_ & (before | equal if past else before)
                low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
            ends.append(low)
        return ends[0], ends[1]

    def edges(self, text: np.ndarray) -> np.ndarray:
        """The occurrences of all pieces, sorted by position and length: entry [length, position] is the piece's number + 1, or 0."""
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _STOP))
        order, words = self.suffix_order(text, lead)
        first, past = self.ranges(words)
        count = past - first
        piece = np.repeat(np.arange(len(count)), count)
        total = np.cumsum(count)
        at = order[np.arange(len(piece)) + np.repeat(first - total + count, count)]
        table = np.zeros((self.longest + 1, len(text)), np.uint16 if len(count) < 1 << 16 else np.uint32)
        table[self.size[piece], at] = piece + 1
        return table

    # -- relaxation ----------------------------------------------------------------------------------------------

    def _merge_long(self, cuts: np.ndarray, table: np.ndarray) -> list[int]:
        """Merges of one long chunk with a heap; returns the token boundaries that are left."""
        cuts = cuts.tolist()
        best: list[tuple[int, int, int, int]] = []
        after, before = {a: b for a, b in zip(cuts, cuts[1:])}, {b: a for a, b in zip(cuts, cuts[1:])}

        def offer(start: int, end: int) -> None:
            piece = int(table[end - start, start]) if end - start <= self.longest else 0
            if piece:
                heapq.heappush(best, (int(self.rank[piece - 1]), start, after[start], end))

        for a, b in zip(cuts, cuts[2:]):
            offer(a, b)
        while best:
            _, start, middle, end = heapq.heappop(best)
            if after.get(start) != middle or after.get(middle) != end:
                continue
            del after[middle], before[middle]
            after[start], before[end] = end, start
            if start in before:
                offer(before[start], end)
            if end in after:
                offer(start, after[end])
        out = [cuts[0]]
        while out[-1] in after:
            out.append(after[out[-1]])
        return out

    def segment(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk. Relaxation follows the model: again and again, each chunk's adjacent tokens whose union is
        the best-ranked edge (leftmost on ties) become one, until no two adjacent tokens make an edge."""
        raw = [c.replace(b" ", _SPACE) for c in chunks]
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        table = self.edges(text)
        size = np.array([len(r) for r in raw], np.int64)
        base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _STOP))
        owner = np.searchsorted(base, lead, "right") - 1
        chars = np.bincount(owner, minlength=len(raw))
        firsts = np.concatenate([[0], np.cumsum(chars)])
        starts, owners = [], []
        for c in np.flatnonzero(chars > LONG_CHUNK):
            cuts = self._merge_long(np.append(lead[firsts[c] : firsts[c + 1]], base[c] + size[c]), table)
            starts.append(np.array(cuts[:-1], np.int64))
            owners.append(np.full(len(cuts) - 1, c))
        short = chars[owner] <= LONG_CHUNK
        at, of = lead[short], owner[short]
        never = np.int64(1) << 62
        rank_of = np.concatenate([[never], self.rank])

        def ranks(left: np.ndarray, end: np.ndarray, same: np.ndarray) -> np.ndarray:
            length = end - left
            return rank_of[table[np.where(same & (length <= self.longest), length, 0), left]]

        stop = base + size

        def pair(i: np.ndarray) -> np.ndarray:
            """Rank of the union of tokens i and i + 1 of the arrays ``at``, ``of``."""
            j, k = np.minimum(i + 1, len(at) - 1), np.minimum(i + 2, len(at) - 1)
            same = (i + 1 < len(at)) & (of[j] == of[i])
            end = np.where((i + 2 < len(at)) & (of[k] == of[i]), at[k], stop[of[i]])
            return ranks(at[i], end, same)

        rank = pair(np.arange(len(at)))
        while len(at):
            new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.minimum.reduceat(rank, new)
            count = np.diff(np.append(new, len(at)))
            done = np.repeat(least == never, count)
            if done.any():
                starts.append(at[done])
                owners.append(of[done])
                at, of, rank = at[~done], of[~done], rank[~done]
                continue
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])]
            keep = np.ones(len(at), bool)
            keep[hit + 1] = False
            at, of, rank = at[keep], of[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            touched = np.unique(np.concatenate([hit, np.maximum(hit - 1, 0)]))
            rank[touched] = pair(touched)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by = np.argsort(start)
        start, owner = start[by], owner[by]
        last = np.concatenate([owner[1:] != owner[:-1], [True]])[: len(start)]
        end = np.where(last, stop[owner], np.append(start[1:], 0)[: len(start)])
        length = end - start
        piece = np.where(length <= self.longest, table[np.minimum(length, self.longest), start], 0).astype(np.int64) - 1
        found = piece >= 0
        width = np.where(found | (not self.has_fallback), 1, end - start)
        offset = np.concatenate([[0], np.cumsum(width)])
        inner = np.arange(offset[-1]) - np.repeat(offset[:-1], width)
        whole = np.repeat(np.where(found, self.id[piece], self.unknown), width)
        single = self.fallback[text[np.repeat(start, width) + inner]]
        ids = np.where(np.repeat(found | (not self.has_fallback), width), whole, single).astype(self.dtype)
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner, width, len(raw)).astype(np.int64))])
        flat, step = ids.tobytes(), self.dtype.itemsize
        return [flat[a * step : b * step] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text. Texts are cut before each run of spaces, where no piece can reach across, and each distinct chunk is encoded once."""
        raw = data.tobytes()
        texts = []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            t = raw[i:j].replace(_SPACE, b" ")
            texts.append(_CHUNK.findall(b" " + t if self.prefix else t) if t else [])
            if t and not self.prefix and not t.startswith(b" "):
                texts[-1].insert(0, t[: t.find(b" ")] if b" " in t else t)
        if len(self.known) > KEPT_CHUNKS:
            self.known = {}
        new = list(set().union(*texts).difference(self.known))
        part, held = [], 0
        for chunk in new:
            part.append(chunk)
            held += len(chunk)
            if held > ARRAY_BYTES:
                self.known.update(zip(part, self.segment(part)))
                part, held = [], 0
        if part:
            self.known.update(zip(part, self.segment(part)))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in texts]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; bytes that are not UTF-8 together become U+FFFD."""
        get = self.bytes_of.__getitem__
        raw = b"".join(map(get, np.frombuffer(ids, self.dtype).tolist()))
        return (raw[1:] if self.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")


def piece_model(path: str) -> PieceModel:
    """This worker's model of a file."""
    return per_stage(("pieces", path), lambda: PieceModel(path))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian integers of two bytes, or four where the vocabulary needs it. No shuffle.

    Null and empty texts have no ids. For models with identity normalisation, as SentencePiece itself encodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for rows, data, offsets in text_chunks(batches, limit=BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.encode(data, offsets), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the column ``text``. No shuffle; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [None if not x.is_valid else model.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
