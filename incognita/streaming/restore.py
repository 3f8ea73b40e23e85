"""Restoration of streamed texts: deltas, and the event lines of chats.

State keeps, for each stream, what is held back of its texts, the number expected next, what came early, and the stream's own
mappings, so that micro-batches may arrive in any order; an end counts once all before it has. Mappings come with a stream's first row alone, without which nothing of it is
given out anyway. What stays of a stream that has ended is
a mark, so that copies of its rows count for nothing: for good, for ``linger_ms``, or (0) not at all, where a source gives each row once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from incognita.sources.shared import cut
from incognita.streaming.matcher import Held, Matcher
from incognita.streaming.slots import by_slots

DELTAS = "stream string, block int, seq long, delta string, is_end boolean"
LINES = "stream string, seq long, line string"
_STATE = "held string, next long, early string, pairs string"
_PIECES = "stream string, block int, seq long, text string"
_RESTORED = "stream string, seq long, part int, line string"
#: A number that is never expected: what comes after an end is dropped.
_NEVER = 2**62
#: Stands among the blocks of a stream that has ended.
_ENDED = "ended"
_as_json = json.JSONEncoder(ensure_ascii=False).encode


def _with_pairs(rows: DataFrame, pairs: list[tuple[str, str]] | DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rows, the first of each stream with its mappings as JSON in a column ``pairs``, and the mappings of all streams. The mappings are
    aggregated once, into a table that the micro-batches read."""
    if isinstance(pairs, list):
        return rows.withColumn("pairs", F.lit(None).cast("string")), pairs
    own = cut(pairs.groupBy("stream").agg(F.to_json(F.collect_set(F.struct("surrogate", "original"))).alias("pairs")), "stream-mappings")
    return rows.join(own.withColumn("seq", F.lit(0).cast("long")), ["stream", "seq"], "left").select(*rows.columns, "pairs"), []


def _add_known(known: dict[str, str], raws: Iterable) -> None:
    for raw in set(raws):
        if isinstance(raw, str):
            known.update((p["surrogate"], p["original"]) for p in json.loads(raw))


def _mode(wait_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout


def _without_times(*times: int | None) -> None:
    if any(times):
        raise ValueError("streams in slots know no times")


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return [row for frame in frames for row in zip(*(frame[c].tolist() for c in columns), strict=True)]


def _end(state: GroupState, after: tuple, linger_ms: int | None) -> None:
    """What becomes of an ended stream's state."""
    if linger_ms == 0:
        state.remove()
        return
    state.update(after)
    if linger_ms:
        state.setTimeoutDuration(linger_ms)


def restored_stream(deltas: DataFrame, pairs: list[tuple[str, str]] | DataFrame, timeout_ms: int | None = None, linger_ms: int | None = None, slots: int | None = None) -> DataFrame:
    """A streaming DataFrame of restored pieces (stream, block, seq of the last delta in it, text) for deltas of the
    columns of DELTAS, numbered from 0 in each block. ``pairs``: a table of each stream's own mappings (stream, surrogate, original), which come
    with its first delta and are kept in its state; or a short list of (surrogate, original) for all streams. A delta that comes
    twice counts once, after its block's end for ``linger_ms`` (None: always), after which the block's state goes. With ``timeout_ms`` a block
    without an end is given out after that time in silence. ``slots``: so many states for all streams instead of one for each, which many short streams need (see
    streaming/slots.py); no times go with them."""
    deltas, shared = _with_pairs(deltas, pairs)

    def advance(before: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple | None]:
        """Given out (seq, text), and the state: what is held, the number expected, what came early, and the mappings."""
        held, expected, early, known = before or (("", False), 0, {}, {})
        _add_known(known, (raw for *_, raw in rows))
        for seq, delta, end, _ in rows:
            if seq >= expected:
                early.setdefault(seq, (delta or "", bool(end)))
        ready, ended = [], False
        while not ended and (item := early.pop(expected, None)):
            ready.append(item[0])
            expected, ended = expected + 1, item[1]
        text = ""
        if ready:
            hold = Held(Matcher([*known.items(), *shared]), *held)
            text = hold.push("".join(ready)) + (hold.flush() if ended else "")
            held = (hold.text, hold.after_blank)
        given = [(expected - 1, text)] if text else []
        if ended or expected == _NEVER:
            return given, None if linger_ms == 0 else (("", False), _NEVER, {}, {})
        return given, (held, expected, early, known)

    if slots:
        _without_times(timeout_ms, linger_ms)
        return by_slots(deltas.select("stream", "block", "seq", "delta", "is_end", "pairs"), ["stream", "block"], advance, _PIECES, slots)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = None
        if state.exists:
            held, expected, raw, kept = state.get
            before = (json.loads(held), expected, {int(k): item for k, item in json.loads(raw).items()}, dict(json.loads(kept)))
        piece = lambda seq, text: pd.DataFrame([(*key, seq, text)], columns=["stream", "block", "seq", "text"])
        if state.hasTimedOut:
            held, expected, early, known = before
            state.remove()
            if expected != _NEVER:
                hold = Held(Matcher([*known.items(), *shared]), *held)
                yield piece(expected, hold.push("".join(early[k][0] for k in sorted(early))) + hold.flush())
            return
        given, after = advance(before, _rows(frames, "seq", "delta", "is_end", "pairs"))
        if after is None or after[1] == _NEVER:
            _end(state, ('["", false]', _NEVER, "{}", "[]"), linger_ms)
        else:
            held, expected, early, known = after
            state.update((json.dumps(held), expected, json.dumps(early), json.dumps([*known.items()])))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        for seq, text in given:
            yield piece(seq, text)

    return deltas.groupBy("stream", "block").applyInPandasWithState(step, _PIECES, _STATE, "append", _mode(timeout_ms or linger_ms))


def _texts_of(event: dict) -> list[tuple[str, dict, str]]:
    """The pieces of text in an event of either chat format: (block, the object that holds it, its key)."""
    delta = event.get("delta")
    if event.get("type") == "content_block_delta" and isinstance(delta, dict):
        kind = {"text_delta": "text", "input_json_delta": "partial_json"}.get(delta.get("type"))
        return [(f"b{event.get('index', 0)}:{kind}", delta, kind)] if kind and isinstance(delta.get(kind), str) else []
    out = []
    for choice in event.get("choices") or []:
        delta = choice.get("delta") if isinstance(choice, dict) else None
        if isinstance(delta, dict):
            number = choice.get("index", 0)
            if isinstance(delta.get("content"), str):
                out.append((f"c{number}", delta, "content"))
            calls = [c for c in delta.get("tool_calls") or [] if isinstance(c, dict) and isinstance((c.get("function") or {}).get("arguments"), str)]
            out += [(f"t{number}:{c.get('index', 0)}", c["function"], "arguments") for c in calls]
    return out


def _tail_event(block: str, text: str) -> dict:
    """An event of a block's format that brings the rest of its text."""
    number, _, rest = block[1:].partition(":")
    if block[0] == "b":
        kind = "text_delta" if rest == "text" else "input_json_delta"
        return {"type": "content_block_delta", "index": int(number), "delta": {"type": kind, rest: text}}
    delta = {"content": text} if block[0] == "c" else {"tool_calls": [{"index": int(rest), "function": {"arguments": text}}]}
    return {"choices": [{"index": int(number), "delta": delta}]}


def _restored_lines(line: str, held: dict[str, Held], matcher: Matcher) -> list[str]:
    """The lines that one line becomes. Texts of blocks go on in ``held``; the end of a block or of all brings their rests
    before it. Lines that are no data, or no JSON object, pass as they are."""
    body = line[5:].strip() if line.startswith("data:") else None
    ending: list[str] = []
    if body == "[DONE]":
        ending, out = sorted(held), line
    else:
        try:
            event = json.loads(body) if body else None
        except ValueError:
            event = None
        if not isinstance(event, dict):
            return [line]
        found = _texts_of(event)
        for block, holder, key in found:
            holder[key] = held.setdefault(block, Held(matcher)).push(holder[key])
        if event.get("type") == "content_block_stop":
            ending = sorted(b for b in held if b.startswith(f"b{event.get('index', 0)}:"))
        out = f"data: {_as_json(event)}" if found else line
    rests = [(block, held.pop(block).flush()) for block in ending]
    return [f"data: {_as_json(_tail_event(block, text))}" for block, text in rests if text] + [out]


def _is_last(line: str) -> bool:
    """Whether a line ends its whole stream."""
    return line.startswith("data:") and (line[5:].strip() == "[DONE]" or re.search(r'"type"\s*:\s*"message_stop"', line) is not None)


def restored_events(lines: DataFrame, pairs: list[tuple[str, str]] | DataFrame, linger_ms: int | None = None, slots: int | None = None) -> DataFrame:
    """A streaming DataFrame of restored event lines (stream, seq, part, line) for the server-sent event lines (LINES) of
    chats of either format, numbered from 0 in each stream: texts and tool-call arguments are restored across events, rests come
    as events of their own before their block's end, and all other lines pass as they are. ``pairs`` as in restored_stream.
    A line that comes twice counts once. ``linger_ms`` as there: the end of a stream is its line ``[DONE]`` or ``message_stop``.
    ``slots`` as there."""
    lines, shared = _with_pairs(lines, pairs)

    def advance(before: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple | None]:
        """Given out (seq, part, line), and the state: what is held of each block, the number expected, what came early, and the mappings."""
        kept_held, expected, early, known = before or ({}, 0, {}, {})
        _add_known(known, (raw for *_, raw in rows))
        for seq, line, _ in rows:
            if seq >= expected:
                early.setdefault(seq, line or "")
        given, over = [], _ENDED in kept_held
        if expected in early:
            matcher = Matcher([*known.items(), *shared])
            held = {block: Held(matcher, *rest) for block, rest in kept_held.items() if block != _ENDED}
            while (line := early.pop(expected, None)) is not None:
                given += [(expected, part, out) for part, out in enumerate(_restored_lines(line, held, matcher))]
                expected, over = expected + 1, over or _is_last(line)
            kept_held = {b: [h.text, h.after_blank] for b, h in held.items()} | ({_ENDED: ["", False]} if over else {})
        return given, None if over and linger_ms == 0 else (kept_held, expected, early, {} if over and not early else known)

    if slots:
        _without_times(linger_ms)
        return by_slots(lines.select("stream", "seq", "line", "pairs"), ["stream"], advance, _RESTORED, slots)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = None
        if state.exists:
            held, expected, raw, kept = state.get
            before = (json.loads(held), expected, {int(k): line for k, line in json.loads(raw).items()}, dict(json.loads(kept)))
        given, after = advance(before, _rows(frames, "seq", "line", "pairs"))
        if after is None:
            state.remove()
        else:
            held, expected, early, known = after
            packed = (json.dumps(held), expected, json.dumps(early), json.dumps([*known.items()]))
            _end(state, packed, linger_ms) if _ENDED in held else state.update(packed)
        if given:
            yield pd.DataFrame([(*key, *one) for one in given], columns=["stream", "seq", "part", "line"])

    return lines.groupBy("stream").applyInPandasWithState(step, _RESTORED, _STATE, "append", _mode(linger_ms))
