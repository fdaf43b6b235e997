"""Codecs beyond what the registered queries show: hostile inputs, refusals, round trips."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators.geo import smallest_container
from quarry.operators.sequences import asof, numbered
from quarry.sources import files, geofiles, people, sheets, subtitles, trees, wkt
from quarry.streaming import watch


def test_refusals():
    for bad in (lambda: list(trees.json_lines(b'{"a":1}\n{broken')), lambda: trees.bounded(_nested(300)), lambda: trees.json_value("{a}"), lambda: list(trees.toml_json(b"a = "))):
        with pytest.raises(Exception):  # noqa: B017
            bad()
    with pytest.raises(ValueError, match="line 2"):
        list(trees.json_lines(b'{"a":1}\n{broken'))
    assert wkt.parse("(" * 5000) is None and wkt.parse("GEOMETRYCOLLECTION(" * 40 + "POINT(1 2)" + ")" * 40) is None


def _nested(n):
    out = []
    for _ in range(n):
        out = [out]
    return out


def test_yaml_round_trip():
    value = {"a": 1, "b": [1.5, None, True, "yes", "007", "x: y", ""], "c": {"d": [], "e": {}, "f": [{"g": 1}, {"g": "line\nbreak"}]}}
    assert trees.yaml_value(trees.to_yaml(value)) == value


def test_toml_round_trip():
    import tomllib

    value = {"a": 1, "s": 'q"\n', "t": {"x": [1, 2], "y": {"z": True}}, "many": [{"k": 1}, {"k": 2, "o": {"p": 1.5}}]}
    assert tomllib.loads(trees.to_toml(value | {"none": None})) == value


def test_fuzzed_parsers_do_not_hang():
    rng = random.Random(7)
    seeds = [b"BEGIN:VCARD\nN:a;b\nEND:VCARD", b"1\n00:00:01,000 --> 00:00:02,000\nx", b"[00:01.00]x", b"{1}{2}x"]
    for _ in range(300):
        data = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(0, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(0, len(data))])
        list(people.vcards(data))
        list(people.calendar(data))
        for kind in subtitles.READERS:
            list(subtitles.parser(kind)(data))
        wkt.parse(data.decode("latin-1"))


def test_subtitle_round_trips():
    cues = [(1000, 2000, "One\ntwo"), (3000, 4500, "Three")]
    for kind in ("srt", "vtt"):
        assert list(subtitles.parser(kind)(subtitles.write(kind, cues).encode())) == cues
    assert [t for _, _, t in subtitles.parser("lrc")(subtitles.write("lrc", cues).encode())] == ["One two", "Three"]
    assert subtitles.write("txt", [(0, 1, "a\nb"), (1, 2, "b"), (2, 3, "c")]) == "a\nb\nc\n"


def test_encodings():
    assert files.decode("한국어 글자".encode("cp949")) == "한국어 글자" and files.decode("naïve".encode("cp1252")) == "naïve"
    assert files.decode(b"\xef\xbb\xbfx") == "x" and files.decode("abcdefgh".encode("utf-16-le")) == "abcdefgh"


def test_shapes():
    ring = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)]
    hole = [(2, 2), (4, 2), (4, 4), (2, 2)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 9, 9, 2, len(ring) + len(hole), 0, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    data = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body
    assert [r[2] for r in geofiles.shp(data)] == ["POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (2 2, 4 2, 4 4, 2 2))"]


def test_dbf():
    fields = [("NAME", "C", 6), ("N", "N", 4), ("OK", "L", 1), ("DAY", "D", 8)]
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, 2, 32 + 32 * len(fields) + 1, 1 + sum(w for *_, w in fields))
    desc = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields)
    data = head + desc + b"\r" + b" Jo      12T20240102" + b"*Gone    12T20240102"
    assert list(geofiles.dbf(data)) == [(0, {"NAME": "Jo", "N": "12", "OK": "true", "DAY": "2024-01-02"}), (1, {})]


def test_osm_stream():
    text = b'<osm><node id="1" lat="1" lon="2"><tag k="a" v="b"/></node><node id="2" visible="false" lat="0" lon="0"/><way id="3"><nd ref="1"/><nd ref="2"/></way></osm>'
    assert list(geofiles.osm(text)) == [("node", 1, 1.0, 2.0, [], {"a": "b"}), ("way", 3, None, None, [1, 2], {})]


def test_workbooks():
    data = sheets.to_xlsx({"A": [["x", 1], [True, 2.5]], 'B "q"': [[], ["", "é<"]]})
    assert [(s, r, c, t, v) for s, r, c, t, v, _ in sheets.xlsx(data)] == [("A", 0, 0, "x", None), ("A", 0, 1, "1", 1.0), ("A", 1, 0, "TRUE", None), ("A", 1, 1, "2.5", 2.5), ('B "q"', 1, 1, "é<", None)]
    assert [sheets.column_of(sheets.column_letters(n)) for n in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]


def test_files_are_read_where_they_lie(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.yaml").write_text("a: 1\n")
    (tmp_path / "d" / "b.yaml").write_text("- x\n")
    (tmp_path / "c.txt").write_text("not: read\n")
    assert sorted(r["json"] for r in files.read(spark, str(tmp_path), trees.yaml_json, trees.JSON, "*.yaml").collect()) == ['["x"]', '{"a": 1}']
    df = spark.createDataFrame([(1, 'a"b'), (2, " x")], "k int, v string").coalesce(1)
    files.write_csv(df, str(tmp_path / "out"))
    lines = sorted("".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*")).split("\r\n"))
    assert lines == sorted(["", "k,v", '1,"a""b"', '2," x"'])


def test_numbering_and_asof_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert [(r["x"], r["at"]) for r in numbered(df, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    right = spark.createDataFrame([(100, "a"), (400, "b"), (401, "c")], "since long, v string")
    got = {r["x"]: r["v"] for r in asof(df, right, "x", "since", ["v"]).collect()}
    assert got == {i: None if i < 100 else "a" if i < 400 else "b" if i < 401 else "c" for i in range(1000)}


def test_ranges_hold_when_partitions_are_coalesced(spark):
    """Wide rows and their times alone are coalesced to unlike numbers of partitions."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(8000).select((F.col("id") * 7919 % 8000).alias("x"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    right = spark.range(2).select((F.col("id") * 4000 + 2000).alias("since"), F.col("id").alias("v"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert numbered(df, "x").agg(F.count_if(F.col("at") == F.col("x") + 1), F.max("wide")).first()[0] == 8000
        for time in (lambda c: F.col(c), lambda c: F.timestamp_micros(F.col(c) * 1_000_000).cast("timestamp_ntz")):
            got = asof(df.withColumn("t", time("x")), right.withColumn("since", time("since")), "t", "since", ["v"])
            got = got.groupBy("v").agg(F.count("*"), F.min("x"), F.max("x"), F.max("wide"))
            assert {tuple(r)[:4] for r in got.collect()} == {(None, 2000, 0, 1999), (0, 4000, 2000, 5999), (1, 2000, 6000, 7999)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_smallest_container_among_boxes_of_all_sizes(spark):
    """Boxes far larger than a cell and than the extent of the points, down to points; edges on cells' edges."""
    rng = random.Random(6)
    points = [(i, rng.choice([rng.uniform(-90, 90), rng.randrange(-9, 9) * 10.0]), rng.choice([rng.uniform(-90, 90), rng.randrange(-9, 9) * 10.0])) for i in range(300)]
    boxes = [(0, -1e12, -1e12, 1e12, 1e12), (1, -1e12, -1e12, 0.0, 2e12), (2, 5.0, 5.0, -5.0, 90.0), (3, *points[7][1:], *points[7][1:]), (4, 1e6, 1e6, 2e6, 2e6)]
    for i in range(5, 120):
        x, y = rng.randrange(-12, 9) * 10.0, rng.uniform(-120, 80)
        boxes.append((i, x, y, x + rng.choice([0.5, 10.0, 70.0, 400.0]), y + rng.choice([0.5, 10.0, 70.0, 400.0])))
    points += [(300, 1e13, 0.0), (301, None, 1.0)]
    df = spark.createDataFrame(points, "p long, x double, y double").coalesce(1), spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    around = lambda x, y: [((x1 - x0) * (y1 - y0), b) for b, x0, y0, x1, y1 in boxes if x is not None and x0 <= x <= x1 and y0 <= y <= y1]
    want = {p: min(around(x, y), default=(0, None))[1] for p, x, y in points}
    assert {r["p"]: r["b"] for r in smallest_container(df[0].where("p < 300"), df[1], "p", "b", 0.7).collect()} == {p: b for p, b in want.items() if p < 300}
    assert {r["p"]: r["b"] for r in smallest_container(*df, "p", "b", 0.7).collect()} == want


def test_stream_of_files_settles(spark, tmp_path):
    seen, out = tmp_path / "seen", []
    seen.mkdir()
    schema = "path string, length long, mtime timestamp"
    stream = watch.settled_stream(spark.readStream.schema(schema).json(str(seen)), 1500)
    q = stream.writeStream.outputMode("append").trigger(processingTime="300 milliseconds").foreachBatch(lambda df, i: out.extend(tuple(r)[:2] for r in df.collect())).start()
    try:
        (seen / "1.json").write_text('{"path":"a","length":1,"mtime":"2024-01-01T00:00:00"}\n{"path":"b","length":5,"mtime":"2024-01-01T00:00:00"}\n')
        time.sleep(1)
        (seen / "2.json").write_text('{"path":"a","length":2,"mtime":"2024-01-01T00:00:01"}\n')
        for _ in range(60):
            time.sleep(0.5)
            if len(out) >= 2:
                break
    finally:
        q.stop()
    assert sorted(out) == [("a", 2), ("b", 5)]


def test_fit_records():
    from quarry.sources import fit

    define = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 5) + bytes([253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85, 3, 1, 2, 2, 2, 0x84])
    one = bytes([0]) + struct.pack("<IiiBH", 1000, 2**29, -(2**30), 120, 3000)
    two = bytes([0]) + struct.pack("<IiiBH", 1001, 0x7FFFFFFF, 0x7FFFFFFF, 0xFF, 0xFFFF)
    body = define + one + two
    data = bytes([14, 16, 0, 0]) + struct.pack("<I", len(body)) + b".FIT\0\0" + body
    data += struct.pack("<H", fit.crc16(data))
    a, b = fit.records(data)
    assert a[1:5] == (-90.0, 45.0, 100.0, 120) and (a[0] - fit.EPOCH).total_seconds() == 1000
    assert b[1:] == (None,) * 8
    with pytest.raises(ValueError, match="checksum"):
        list(fit.records(data[:-1] + b"\0" if data[-1] else data[:-1] + b"\1"))
