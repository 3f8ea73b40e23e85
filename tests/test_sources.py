import codecs
import ipaddress
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from incognita.functions.surrogates import surrogate
from incognita.operators import audit, detectors, vault as vaults
from incognita.sources.corpus import append_vault, read_text_files, read_vault, save_look_up_tables, scope_file, write_text_files
from incognita.streaming.byte_lines import CHUNKS, LineReader, byte_lines
from incognita.streaming.mint import mint_batch, minting, read_minted


def lines_of(raw):
    text = codecs.decode(raw, "utf-8", "replace")
    return text.split("\n")[:-1] if text.endswith("\n") or not text else text.split("\n")


def test_lines_of_pieces():
    rnd = random.Random(3)
    for _ in range(3000):
        raw = b"".join(rnd.choice([b"a", b"\n", "é".encode(), "€".encode(), "\U0001f600".encode(), b"\xff", b"\xe2\x82", b"\r"]) for _ in range(rnd.randrange(12)))
        reader, out, at = LineReader(), [], 0
        while at < len(raw):
            size = rnd.randrange(1, 5)
            out += reader.push(raw[at : at + size], at + size >= len(raw))
            at += size
            reader = LineReader(*reader.state())
        assert out == lines_of(raw), raw


def test_byte_lines_in_any_order(spark, tmp_path):
    raw = {"a": "één\nzwei €\n\nquatre".encode(), "b": b"bad \xe2\x82 bytes\n\xff\n", "c": b"\n", "d": b"x"}
    rows = [(s, i // 3, bytearray(r[i : i + 3]), i + 3 >= len(r)) for s, r in raw.items() for i in range(0, len(r), 3)]
    source = str(tmp_path / "in")
    for part in (2, 0, 1):
        spark.createDataFrame([r for r in rows if r[1] % 3 == part] + [rows[0]], CHUNKS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source)
    query = byte_lines(stream.where("NOT (stream = 'd' AND is_end IS NULL)")).writeStream.format("memory").queryName("bytes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in sorted(spark.table("bytes").collect()):
        assert r.seq == len(got.setdefault(r.stream, []))
        got[r.stream].append(r.line)
    assert got == {s: lines_of(r) for s, r in raw.items()} and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_a_replayed_batch_mints_nothing_twice(spark, tmp_path):
    source, table, marks = (str(tmp_path / n) for n in ("found", "minted", "marks"))
    parts = [[("a.corp", "DOMAIN"), ("b.corp", "DOMAIN"), (None, "DOMAIN")], [("b.corp", "DOMAIN"), ("10.0.0.1", "IP_ADDRESS"), ("a.corp", "DOMAIN")], [("10.0.0.2", "IP_ADDRESS")]]
    for part in parts:
        spark.createDataFrame(part, "value string, entity_type string").coalesce(1).write.mode("append").parquet(source)
    assert read_minted(spark, table).count() == 0
    write, tries = mint_batch(table, "eng"), []

    def breaks(batch, number):
        write(batch, number)
        tries.append(number)
        if tries.count(number) == 1:
            raise RuntimeError("broken off behind the write")

    for _ in range(4):
        query = minting(spark.readStream.schema("value string, entity_type string").option("maxFilesPerTrigger", 1).parquet(source), table, marks, "eng", breaks)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    got = read_minted(spark, table)
    assert tries == [0, 0, 1, 1, 2, 2]
    assert {(r.original, r.batch) for r in got.collect()} == {("a.corp", 0), ("b.corp", 0), ("10.0.0.1", 1), ("10.0.0.2", 2)} and got.select("surrogate").distinct().count() == 4


def test_look_ups_do_not_move_the_vault(spark, tmp_path):
    vault = spark.createDataFrame([(f"o{k}", "OTHER", f"s{k}") for k in range(500)], "original string, entity_type string, surrogate string")
    names = save_look_up_tables(vault, "looked", str(tmp_path), buckets=4)
    values = spark.createDataFrame([(f"o{k}",) for k in range(0, 600, 7)], "value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        there = vaults.look_up(values, spark.table(names[0]))
        back = vaults.look_up(there.select("surrogate").where("surrogate IS NOT NULL"), spark.table(names[1]), "surrogate", "surrogate")
        for frame in (there, vaults.look_up(values.withColumnRenamed("value", "surrogate"), spark.table(names[1]), "surrogate", "surrogate")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert {r.value: r.surrogate for r in there.collect()} == {f"o{k}": f"s{k}" if k < 500 else None for k in range(0, 600, 7)}
        assert {r.original for r in back.collect()} == {f"o{k}" for k in range(0, 500, 7)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def test_appends_are_dealt_over_tasks(spark, tmp_path):
    path = str(tmp_path / "vault")
    rows = spark.range(2000).select(F.concat(F.lit("o"), "id").alias("original"), F.lit("OTHER").alias("entity_type"), F.concat(F.lit("s"), "id").alias("surrogate"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        append_vault(vaults.as_rows(rows, "one"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read_vault(spark, path, "one").select(F.input_file_name()).distinct().count() > 1
    with pytest.raises(ValueError, match="surrogate twice"):
        append_vault(vaults.as_rows(rows.limit(2).withColumn("original", F.concat(F.lit("new"), "original")).withColumn("surrogate", F.lit("x")), "one"), path)
    assert read_vault(spark, path).count() == 2000


def test_networks_have_no_host_bits(spark):
    rows = [(f"10.{k}.0.0/{p}",) for p in (4, 8, 10, 14, 15, 16, 20, 24, 30, 32) for k in range(20)]
    frame = spark.createDataFrame(rows, "o string")
    for wide in (0, 1, 2):
        for r in frame.select("o", surrogate(F.lit("CIDR"), F.col("o"), "eng", wide=wide).alias("s")).collect():
            network = ipaddress.ip_network(r.s, strict=bool(wide))
            assert r.s.split("/")[1] == r.o.split("/")[1] and network.prefixlen == int(r.o.split("/")[1])
            assert not wide or network.subnet_of(ipaddress.ip_network("198.18.0.0/15" if wide == 1 and network.prefixlen > 14 else "240.0.0.0/4"))


def test_detectors_as_table_functions(spark):
    def find(text):
        if "boom" in text:
            raise RuntimeError("boom")
        return [(w, "PERSON") for w in text.split() if w.istitle()]

    detectors.register_udtf(spark, "people", find)
    frame = spark.createDataFrame([(1, "Ann met Bob"), (2, None), (3, "boom Carl"), (4, "nobody"), (5, "Ann Ann")], "k int, text string")
    got = spark.sql("SELECT k, f.value, f.entity_type FROM {t} t, LATERAL people(t.text) f", t=frame).collect()
    assert sorted(map(tuple, got)) == [(1, "Ann", "PERSON"), (1, "Bob", "PERSON"), (5, "Ann", "PERSON"), (5, "Ann", "PERSON")]


def test_whether_contextual_detectors_are_ready(caplog):
    detectors.register("there", lambda *_: None)
    detectors.register("absent", lambda *_: None, ready=lambda: False)
    detectors.register("broken-check", lambda *_: None, ready=lambda: 1 / 0)
    assert detectors.contextual_ready(["there"]) and detectors.contextual_ready([], scoped=True)
    assert not detectors.contextual_ready([]) and not detectors.contextual_ready(["absent", "broken-check", "unknown"])
    assert detectors.contextual_ready(["absent", "there"]) and "broken-check" in caplog.text


def test_files(spark, tmp_path, caplog):
    assert scope_file(spark, str(tmp_path / "none.txt")).count() == 0 and "none.txt" in caplog.text
    (tmp_path / "scope.txt").write_text("# own\nacme.com\n ACME = organization \n\n")
    assert {tuple(r) for r in scope_file(spark, str(tmp_path / "scope.txt")).collect()} == {("acme.com", "DOMAIN"), ("ACME", "ORGANIZATION")}
    texts = spark.createDataFrame([("one\ntwo",), (None,), ("é",)], "text string")
    write_text_files(texts, str(tmp_path / "out"))
    assert {r.text for r in read_text_files(spark, str(tmp_path / "out"), whole=False).collect()} == {"one", "two", "é"}


def test_locale_order(spark):
    rows = spark.createDataFrame([(o, "T", o) for o in ("b", "A", "a", "é", "e", "z", "É", "B")], "original string, entity_type string, surrogate string")
    assert [r.original for r in audit.sorted_by(rows, "original").collect()] == ["a", "A", "b", "B", "e", "é", "É", "z"]
    assert [r.original for r in audit.sorted_by(rows, "original", True).collect()][:2] == ["z", "É"]


def test_lines_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    from incognita.sources.corpus import LINES_A_TASK, tool_lines

    for rows, least in ((LINES_A_TASK - 1, 1), (3 * LINES_A_TASK, 4)):
        made = spark.range(rows).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment")
        made.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
        lines = tool_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() == least and lines.select("row_id").distinct().count() == rows
