"""Text lines from a stream of bytes that is cut anywhere.

State keeps, for each stream, the bytes of a character that isn't whole yet, the line begun, the number of the chunk expected next and chunks that came early;
so micro-batches may bring chunks in any order, and characters and lines may be cut by any of them.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from incognita.streaming.slots import by_slots

CHUNKS = "stream string, seq long, chunk binary, is_end boolean"
_STATE = "begun binary, open binary, next long, line long, early_seq array<long>, early_chunk array<binary>, early_end array<boolean>"
_LINES = "stream string, seq long, line string"


class LineReader:
    """Complete lines, without their line feeds, of UTF-8 bytes that come in pieces. Bytes that are no UTF-8 become replacement characters."""

    def __init__(self, begun: str = "", open_bytes: bytes = b""):
        self.begun = [begun] if begun else []
        self.decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.decoder.setstate((open_bytes, 0))

    def push(self, chunk: bytes, is_end: bool = False) -> list[str]:
        first, *later = self.decoder.decode(chunk, is_end).split("\n")
        self.begun.append(first)
        out = []
        if later:
            out = ["".join(self.begun), *later[:-1]]
            self.begun = [later[-1]]
        if is_end and (rest := "".join(self.begun)):
            out.append(rest)
            self.begun = []
        return out

    def state(self) -> tuple[str, bytes]:
        return "".join(self.begun), self.decoder.getstate()[0]


def byte_lines(chunks: DataFrame, slots: int | None = None) -> DataFrame:
    """A streaming DataFrame of the lines (stream, seq, line), numbered from 0, of chunks of bytes (CHUNKS), numbered from 0 in each stream.
    A line ends with a line feed, or with its stream; a stream that ends with a line feed has no empty last line. Null chunks hold nothing; a chunk
    that comes twice counts once while its stream is open. The state of a stream goes at its end. ``slots``: so many states for all streams instead of one for
    each, which many short streams need (see streaming/slots.py)."""

    def advance(before: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple | None]:
        """Given out (seq, line), and the state: the line begun, bytes of an open character, the numbers of the next chunk and line, and what came early."""
        begun, open_bytes, expected, number, early = before or ("", b"", 0, 0, {})
        for seq, chunk, end in rows:
            if seq >= expected:
                early.setdefault(seq, (bytes(chunk or b""), bool(end)))
        reader, out, over = LineReader(begun, open_bytes), [], False
        while not over and (item := early.pop(expected, None)):
            out += reader.push(*item)
            expected, over = expected + 1, item[1]
        return [*enumerate(out, number)], None if over else (*reader.state(), expected, number + len(out), early)

    if slots:
        return by_slots(chunks.select("stream", "seq", "chunk", "is_end"), ["stream"], advance, _LINES, slots)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = None
        if state.exists:
            begun, open_bytes, expected, number, *early = state.get
            before = (bytes(begun).decode(), bytes(open_bytes), expected, number, {seq: (bytes(chunk), end) for seq, chunk, end in zip(*early, strict=True)})
        given, after = advance(before, [row for frame in frames for row in zip(frame["seq"], frame["chunk"], frame["is_end"], strict=True)])
        if after is None:
            state.remove()
        else:
            begun, open_bytes, expected, number, early = after
            order = sorted(early)
            state.update((begun.encode(), open_bytes, expected, number, order, [early[k][0] for k in order], [early[k][1] for k in order]))
        if given:
            yield pd.DataFrame([(*key, *one) for one in given], columns=["stream", "seq", "line"])

    return chunks.groupBy("stream").applyInPandasWithState(step, _LINES, _STATE, "append", GroupStateTimeout.NoTimeout)
