"""SentencePiece encoding and decoding by an Aho-Corasick automaton, in merge order or by Viterbi (operator 5).

The pieces of a public vocabulary form one automaton over bytes (the word mark is
a blank). A text is read once: at each position the automaton's state and its
output links name all pieces that end there. For a BPE vocabulary, whose scores are
merge ranks, the position's last piece is the only one that merging leaves side by
side with the last piece before it: a segmentation is that of the merges exactly if
each two neighbours are. For a unigram vocabulary each piece relaxes the best score
of the position. Positions of many units are settled side by side in NumPy. A unit is
a run of blanks and what follows up to the next blank; if no piece holds a blank
behind another character, which is checked, best paths never cross units, so
distinct units are encoded once. Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.batches import chunks, column_bytes, ids_and_texts
from llm.packing import vocabulary_path
from llm.vectext import BYTE_KEYS, owner, prefix_sums, ragged, text_hash, unique_inverse
from llm.worker import kept_tool

_MARK = "▁"
#: How far below the least piece a byte-fallback character scores.
FALLBACK_BELOW = 10.0
#: Slots for pairs of pieces whose merging is known, a power of two.
PAIR_SLOTS = 1 << 20
_CODEC = "doc_id long, n_tokens long, n_fallback long, score double, ids_crc32 long, roundtrip boolean"


class PieceAutomaton:
    """Goto table, output links and scores of a vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        size = tool.vocab_size()
        self.byte_ids = np.full(256, tool.unk_id(), np.int64)
        pieces: dict[bytes, int] = {}
        self.surface = [b""] * size
        for i in range(size):
            piece = tool.id_to_piece(i)
            if tool.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif not (tool.is_control(i) or tool.is_unknown(i) or tool.is_unused(i)):
                raw = piece.replace(_MARK, " ").encode()
                pieces.setdefault(raw, i)
                self.surface[i] = raw
        self.units = not any(b" " in raw.lstrip(b" ") for raw in pieces)
        self.scores = np.array([tool.get_score(i) for i in range(size)])
        self.fallback = min(self.scores[list(pieces.values())]) - FALLBACK_BELOW
        self.is_fallback = np.zeros(size, dtype=bool)
        self.is_fallback[self.byte_ids] = True
        self.pieces = pieces
        self.merges: dict[int, tuple[list[float], list[bytes], list[bytes]]] = {}
        self.pair_slots = np.full(PAIR_SLOTS, -1, np.int64)
        self._build(pieces)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in self.surface])))
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def _build(self, pieces: dict[bytes, int]) -> None:
        children: dict[tuple[int, int], int] = {}
        levels: list[list[tuple[int, int, int]]] = []
        self.piece = [-1]
        for raw, i in pieces.items():
            node = 0
            for depth, byte in enumerate(raw):
                child = children.get((node, byte))
                if child is None:
                    child = children[node, byte] = len(self.piece)
                    self.piece.append(-1)
                    if len(levels) <= depth:
                        levels.append([])
                    levels[depth].append((node, byte, child))
                node = child
            self.piece[node] = i
        n = len(self.piece)
        self.piece = np.array(self.piece)
        self.length = np.zeros(n, np.int64)
        self.goto = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int64)
        self.link = np.zeros(n, np.int64)  # 0: no shorter piece ends here
        for depth, level in enumerate(levels):
            parent, byte, child = np.array(level).T
            if depth:
                fail[child] = self.goto[fail[parent], byte]
            self.goto[parent, byte] = child
            if depth + 1 < len(levels):
                self.goto[child] = self.goto[fail[child]]
            else:
                self.goto[child] = self.goto[fail[child]]
            self.link[child] = np.where(self.piece[fail[child]] >= 0, fail[child], self.link[fail[child]])
            self.length[child] = depth + 1

    def _merges(self, i: int) -> tuple[list[float], list[bytes], list[bytes]]:
        """How merging makes piece i of its characters: the scores of the merges in their order, and the first and the
        last part before each merge and after all. A piece that merging doesn't make ends in shorter parts."""
        if i not in self.merges:
            parts = [c.encode() for c in self.surface[i].decode()]
            if any(c not in self.pieces for c in parts):
                raise ValueError("merge order needs each character of a piece to be a piece")
            scores, first, last = [], [parts[0]], [parts[-1]]
            while True:
                made = [(-self.scores[j], k) for k in range(len(parts) - 1) if (j := self.pieces.get(parts[k] + parts[k + 1])) is not None]
                if not made:
                    break
                score, k = min(made)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                scores.append(-score)
                first.append(parts[0])
                last.append(parts[-1])
            self.merges[i] = scores, first, last
        return self.merges[i]

    def _stay(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives the two pieces; left is -1 where nothing stands before
        that a merge could take in. The best score is merged first, of equal ones the leftmost."""
        to, right_first, _ = self._merges(right)
        if right_first[-1] != self.surface[right]:
            return False
        if left < 0:
            return True
        of, _, left_last = self._merges(left)
        i = j = 0
        while True:
            across = self.pieces.get(left_last[i] + right_first[j])
            next_left = of[i] if i < len(of) else -np.inf
            next_right = to[j] if j < len(to) else -np.inf
            if across is not None and self.scores[across] > next_left and self.scores[across] >= next_right:
                return False
            if i == len(of) and j == len(to):
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stay() of many pairs; what was found is kept in slots, of which a later pair may take one over."""
        key = (left + 1) * len(self.surface) + right
        slot = (key * 0x9E3779B1 >> 12) & (PAIR_SLOTS - 1)
        held = self.pair_slots[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            keys, example, place = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self._stay(a, b) for a, b in zip(left[new][example].tolist(), right[new][example].tolist(), strict=True)])
            out[new] = found[place]
            self.pair_slots[slot[new][example]] = keys << 1 | found
        return out

    def encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by_merges: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units data[start:end] end to end, number of ids and score of each: one pass over all units side
        by side, in merge order or by Viterbi. Of equal scores of Viterbi the path with the longer last piece wins."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        base = np.cumsum(lengths + 1) - (lengths + 1)
        total = int((lengths + 1).sum())
        best = np.full(total, -np.inf)
        best[base] = 0.0
        took = np.zeros(total, np.int64)  # bytes of the last piece
        ids = np.full(total, -1, np.int64)  # its id, -1 for a fallback character
        tokens = np.zeros(total, np.int64)
        state = np.zeros(len(starts), np.int64)
        char = np.zeros(len(starts), np.int64)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # units longer than t
            byte = data[starts[:live] + t]
            state[:live] = self.goto[state[:live], byte]
            char[:live] = np.where(byte & 0xC0 == 0x80, char[:live] + 1, 1)
            here = base[:live] + t + 1
            node, at = state[:live].copy(), np.arange(live)
            node = np.where(self.piece[node] >= 0, node, self.link[node])
            while True:
                some = node > 0
                node, at = node[some], at[some]
                if not len(node):
                    break
                piece, size = self.piece[node], self.length[node]
                cell = here[at]
                score = best[cell - size] + self.scores[piece]
                if by_merges:
                    better = np.isfinite(score)
                    better[better] = self.stay(ids[cell - size][better], piece[better])
                else:
                    better = score > best[cell]
                cell, piece, size = cell[better], piece[better], size[better]
                best[cell], ids[cell], took[cell], tokens[cell] = score[better], piece, size, tokens[cell - size] + 1
                if by_merges:  # no second piece can end here
                    node, at = node[~better], at[~better]
                node = self.link[node]
            last = np.ones(live, dtype=bool)
            more = lengths[:live] > t + 1
            last[more] = data[starts[:live][more] + t + 1] & 0xC0 != 0x80
            cell, size = here[last], char[:live][last]
            score = best[cell - size] + self.fallback
            better = ~np.isfinite(best[cell]) if by_merges else score > best[cell]
            cell, size = cell[better], size[better]
            best[cell], ids[cell], took[cell], tokens[cell] = score[better], -1, size, tokens[cell - size] + size
        finish = base + lengths
        counts = tokens[finish]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        cell, write, unit = finish.copy(), first + counts, np.arange(len(starts))
        while True:
            some = cell > base[unit]
            cell, write, unit = cell[some], write[some], unit[some]
            if not len(cell):
                break
            piece, size = ids[cell], took[cell]
            plain = piece >= 0
            out[write[plain] - 1] = piece[plain]
            wide = np.flatnonzero(~plain)
            if len(wide):
                at = starts[unit[wide]] + (cell[wide] - base[unit[wide]]) - size[wide]
                out[ragged(write[wide] - size[wide], size[wide])] = self.byte_ids[data[ragged(at, size[wide])]]
            write = write - np.where(plain, 1, size)
            cell = cell - size
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out[ragged(first[back], counts[back])], counts[back], best[finish][back]

    def encode(self, data: np.ndarray, bounds: np.ndarray, by_merges: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the documents of a chunk end to end, n + 1 offsets, and scores. A blank is put before each text
        that isn't empty, as the vocabulary expects."""
        filled = np.flatnonzero(np.diff(bounds) > 0)
        text = np.insert(data, bounds[filled], 0x20)
        at = bounds + np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))
        edge = np.zeros(len(text), dtype=bool)
        if self.units:
            blank = text == 0x20
            edge[1:] = blank[1:] & ~blank[:-1]
        edge[at[filled]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(text))
        distinct, example, place = unique_inverse(text_hash(text, prefix_sums(BYTE_KEYS[text]), starts, ends))
        ids, counts, scores = self.encode_units(text, starts[example], ends[example], by_merges)
        first = np.cumsum(counts) - counts
        total = np.concatenate(([0], np.cumsum(counts[place])))
        unit_of = np.searchsorted(starts, at)
        doc = owner(unit_of)
        return ids[ragged(first[place], counts[place])], total[unit_of], np.bincount(doc, scores[place], minlength=len(bounds) - 1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids, with the blank in front still there."""
        sizes = np.diff(self.surface_at)[ids]
        return self.surface_bytes[ragged(self.surface_at[ids], sizes)]


def automaton(path: str) -> PieceAutomaton:
    """The worker's automaton of this vocabulary."""
    return kept_tool(("pieces", path), lambda: PieceAutomaton(path))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, by_merges: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_fallback, score, ids_crc32 (of little-endian 32-bit ids), roundtrip and ids of every row.

    The ids are those that sentencepiece gives for a BPE vocabulary; by_merges=False (for unigram vocabularies)
    takes the ids of the greatest score instead. score is the sum of the ids' scores. roundtrip says that the decoded ids are the text again. Defined cases: a null or empty text has no tokens
    and score 0; characters without a piece become one token per byte; a word mark that stands in a text is
    such a character; a null id comes back as null; repeated rows are encoded each; an empty table gives an
    empty result. Other columns are ignored.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(path)
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for lo, hi, part, bounds in chunks(data, at):
                ids, offsets, scores = tool.encode(part, bounds, by_merges)
                n = hi - lo
                flat = tool.decode(ids)
                sizes = np.concatenate(([0], np.cumsum(np.diff(tool.surface_at)[ids])))[offsets]
                same = [flat[sizes[i] + 1 : sizes[i + 1]].tobytes() == part[bounds[i] : bounds[i + 1]].tobytes() for i in range(n)]
                small = ids.astype("<u4")
                rows = [small[offsets[i] : offsets[i + 1]] for i in range(n)]
                fallback = np.concatenate(([0], np.cumsum(tool.is_fallback[ids])))[offsets]
                cols = [
                    batch.column("doc_id").slice(lo, n),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(fallback)),
                    pa.array(scores),
                    pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "n_fallback", "score", "ids_crc32", "roundtrip"]
                if with_ids:
                    cols.append(pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, _CODEC + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids of tokens or an empty list give an empty text. Bytes that are
    not UTF-8 are replaced."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(path)
        for batch in batches:
            texts = [tool.decode(np.array(row or [], np.int64)).tobytes()[1:].decode(errors="replace") for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
