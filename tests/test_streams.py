
import pytest

from incognita.streaming import byte_lines as lines_of, slots as dealt
from incognita.streaming.restore import restored_events, restored_stream

DELTAS = "stream string, block int, seq long, delta string, is_end boolean"


def _run(query, name):
    started = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def test_states_go_with_their_streams(spark, tmp_path):
    """No state is left once all streams have ended; one that hasn't stays; mappings come with the first delta only, whatever the order."""
    pairs = spark.createDataFrame([(f"s{k}", f"srv-{k}.example", f"real{k}.host") for k in range(30)], "stream string, surrogate string, original string")
    text = {f"s{k}": f"at srv-{k}.example and srv-{(k + 1) % 30}.example." for k in range(30)}
    rows = [(s, 0, i // 4, t[i : i + 4], i + 4 >= len(t)) for s, t in text.items() for i in range(0, len(t), 4)]
    for n, open_ in enumerate(([], ["s3", "s4"])):
        source = str(tmp_path / f"in{n}")
        for part in (1, 2, 0):
            kept = [r for r in rows if r[2] % 3 == part and not (r[0] in open_ and r[4])]
            spark.createDataFrame(kept, DELTAS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", 1).parquet(source)
        query = _run(restored_stream(stream, pairs, linger_ms=0), f"ends{n}")
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len(open_)
        got = {}
        for r in sorted(spark.table(f"ends{n}").collect()):
            got[r.stream] = got.get(r.stream, "") + r.text
        want = {s: t.replace(f"srv-{s[1:]}.example", f"real{s[1:]}.host") for s, t in text.items()}
        assert {s: t for s, t in got.items() if s not in open_} == {s: t for s, t in want.items() if s not in open_}


def test_copies_after_the_end_count_for_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("s", 0, 0, "srv-one.", False), ("s", 0, 1, "example!", True)]
    for part in (rows, rows, rows[:1]):
        spark.createDataFrame(part, DELTAS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", 1).parquet(source)
    _run(restored_stream(stream, [("srv-one.example", "real.host")]), "copies")
    assert [r.text for r in spark.table("copies").collect()] == ["real.host!"]


def test_event_streams_end(spark, tmp_path):
    """After the line that ends a stream, its state goes at once, or is only a mark."""
    lines = ['data: {"choices":[{"index":0,"delta":{"content":"at srv-one"}}]}', 'data: {"choices":[{"index":0,"delta":{"content":".example"}}]}', "data: [DONE]"]
    other = ['data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"srv-one.example"}}', 'data: {"type":"message_stop"}']
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", i, x) for i, x in enumerate(other)]
    for n, (linger, left) in enumerate([(0, 0), (None, 2)]):
        source = str(tmp_path / f"in{n}")
        for k in (2, 0, 1):
            spark.createDataFrame([r for r in rows if r[1] % 3 == k], "stream string, seq long, line string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("stream string, seq long, line string").option("maxFilesPerTrigger", 1).parquet(source)
        query = _run(restored_events(stream, [("srv-one.example", "real.host")], linger_ms=linger), f"last{n}")
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == left
        out = [r.line for r in sorted(spark.table(f"last{n}").collect())]
        assert "real.host" in "".join(out) and "srv-one" not in "".join(out) and "data: [DONE]" in out


def _by_parts(spark, rows, schema, folder, parts=3):
    """A stream of rows that brings later parts first."""
    at = [c.split()[0] for c in schema.split(", ")].index("seq")
    for part in (2, 0, 1):
        spark.createDataFrame([r for r in rows if r[at] % parts == part], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_slots_give_what_single_states_give(spark, tmp_path):
    """Streams that share states: the same rows as with a state each, ended streams leave nothing, and as many calls as slots, not as streams."""
    pairs = spark.createDataFrame([(f"s{k}", f"srv-{k}.example", f"real{k}.hé") for k in range(40)], "stream string, surrogate string, original string")
    text = {f"s{k}": f"at srv-{k}.example\nand *SRV-{k}.example* srv-{k}.exa" for k in range(40)}
    deltas = [(s, 0, i // 4, t[i : i + 4], i + 4 >= len(t) and s != "s7") for s, t in text.items() for i in range(0, len(t), 4)]
    event = lambda piece: 'data: {"choices":[{"index":0,"delta":{"content":' + f'"{piece}"' + "}}]}"
    events = [(s, n, x) for s, t in text.items() for n, x in enumerate([": ping", *(event(t.replace("\n", " ")[i : i + 4]) for i in range(0, len(t), 4)), "data: [DONE]"])]
    raw = {s: (t + "é€\n").encode() for s, t in text.items()}
    chunks = [(s, i // 5, bytearray(b[i : i + 5]), i + 5 >= len(b)) for s, b in raw.items() for i in range(0, len(b), 5)]
    made = {
        "deltas": lambda slots: restored_stream(_by_parts(spark, deltas, DELTAS, str(tmp_path / f"deltas{slots}")), pairs, linger_ms=0, slots=slots),
        "events": lambda slots: restored_events(_by_parts(spark, events, "stream string, seq long, line string", str(tmp_path / f"events{slots}")), pairs, linger_ms=0, slots=slots),
        "chunks": lambda slots: lines_of.byte_lines(_by_parts(spark, chunks, lines_of.CHUNKS, str(tmp_path / f"chunks{slots}")), slots),
    }
    for name, query in made.items():
        left, got = [], []
        for slots in (None, 3):
            run = _run(query(slots), f"{name}_{slots or 0}")
            left.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
            got.append(sorted(map(tuple, spark.table(f"{name}_{slots or 0}").collect())))
            assert slots is None or max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress) <= slots
        assert got[0] == got[1] and got[0]
        assert left == ([1, 1] if name == "deltas" else [0, 0])
    with pytest.raises(ValueError):
        restored_events(spark.readStream.schema("stream string, seq long, line string").parquet(str(tmp_path / "events3")), [], linger_ms=5, slots=3)


def test_slots_grow_with_streams():
    assert [dealt.slots_for(*n) for n in ((0, 0), (10, 10), (90_000, 900_000), (9_000_000, 90_000_000), (1, 10**7))] == [1, 1, 352, 35157, 2442]
