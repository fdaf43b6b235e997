"""Codecs over inline files and over files made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merging, references
from ..operators.kept import shared_folder
from ..operators.ordering import Key
from ..sources import files, geofiles, people, sheets, sheets_out, subtitles, trees
from .registry import query


def _files(table, text: str):
    """A file for each supplier, with its number where the text has ##."""
    k = F.col("s_suppkey")
    return files.spread(table("supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.replace(F.lit(text), F.lit("##"), k.cast("string")).alias("content"))


def _one(table, text: str, parser):
    return files.parsed(_files(table, text), "content", parser, trees.JSON, ("s_suppkey",))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("""SELECT s_suppkey, replace(""" + _literal('{"a": ##, "yes": "yes", "n": null, "f": 3.0, "h": 31, "o": 8, "q": "007", "list": [true, "x"], "big": 123456789012345678901234, "m": {"x": 1, "y": 2}}') + ", '##', s_suppkey::VARCHAR) AS json FROM supplier")
def yaml_records(spark, table):
    return _one(table, 'a: ##\nyes: yes\nn: ~\nf: 3.0\nh: 0x1F\no: 0o10\nq: "007"\nlist: [True, x]\nbig: 123456789012345678901234\nbase: &b {x: 1}\nm: {<<: *b, y: 2}\n'.replace("base: &b {x: 1}\nm: {<<: *b, y: 2}", "m: {<<: {x: 1}, y: 2}"), trees.yaml_json)


@query("SELECT s_suppkey, replace(" + _literal('{"t": "x##", "d": "2024-01-02", "n": [1, 2.5], "a": {"b": true}}') + ", '##', s_suppkey::VARCHAR) AS json FROM supplier")
def toml_records(spark, table):
    return _one(table, 't = "x##"\nd = 2024-01-02\nn = [1, 2.5]\n[a]\nb = true\n', trees.toml_json)


@query("""SELECT n_nationkey, '{"rows": {"@n": "' || n_nationkey || '", "row": [{"a": "1"}, {"a": "2", "#text": "t"}], "x": ""}}' AS json FROM nation""")
def xml_records(spark, table):
    x = F.concat(F.lit('<!DOCTYPE rows><rows n="'), F.col("n_nationkey").cast("string"), F.lit('"><row><a>1</a></row><row><a>2</a>t</row><x/></rows>'))
    return files.parsed(table("nation").select("n_nationkey", x.alias("content")), "content", trees.xml_json, trees.JSON, ("n_nationkey",))


@query("SELECT s_suppkey, replace(" + _literal('{"k": [##, true, "x"], "d": "YWI=", "t": "2024-01-02T03:04:05"}') + ", '##', s_suppkey::VARCHAR) AS json FROM supplier")
def plist_records(spark, table):
    return _one(table, '<?xml version="1.0"?><plist version="1.0"><dict><key>k</key><array><integer>##</integer><true/><string>x</string></array><key>d</key><data>YWI=</data><key>t</key><date>2024-01-02T03:04:05Z</date></dict></plist>', trees.plist_json)


@query("SELECT s_suppkey, replace(" + _literal('{"a": [1, ##], "b": "// no, comment"}') + ", '##', s_suppkey::VARCHAR) AS json FROM supplier")
def lenient_json(spark, table):
    return _one(table, '{"a": [1, ##,], // c\n "b": "// no, comment", /* d */ }', trees.lenient_json)


@query("""SELECT c_custkey, c_name, c_nationkey::INTEGER AS c_nationkey FROM customer""")
def json_lines_roundtrip(spark, table):
    """To JSON Lines and back: one line a record, no schema needed to split."""
    c = table("customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("line"))
    return c.select(F.from_json("line", "c_custkey bigint, c_name string, c_nationkey int").alias("r")).select("r.*")


@query("SELECT s_suppkey, line::INTEGER AS line, replace(json, '##', s_suppkey::VARCHAR) AS json FROM supplier, (VALUES (1, '{\"a\": ##}'), (3, '[2]')) x(line, json)")
def json_lines_scan(spark, table):
    return files.parsed(_files(table, '{"a":##}\n\n[2]\n'), "content", trees.json_lines, trees.JSON_LINES, ("s_suppkey",))


@query("""SELECT s_suppkey, x.* REPLACE (replace("Note", '##', s_suppkey::VARCHAR) AS "Note") FROM supplier, (VALUES ('Jo Doe', 'Jo', 'Doe', 'ACME, Unit', 'Boss', 'jo@x.org (work)', '+1 555 (mobile)', '1 Road, Town', '1979-11-23', 'a,b' || chr(10) || 'c##')) x("Full name", "Given name", "Family name", "Organization", "Title", "Email", "Phone", "Address", "Birthday", "Note")""")
def vcard_rows(spark, table):
    card = "BEGIN:VCARD\r\nVERSION:3.0\r\nN:Doe;Jo;;;\r\nFN:Jo Doe\r\nORG:ACME;Unit\r\nTITLE:Boss\r\nitem1.EMAIL;TYPE=WORK:mailto:jo@x.org\r\nTEL;CELL:tel:+1 555\r\nADR:;;1 Road;Town;;;\r\nBDAY:19791123\r\nPHOTO;ENCODING=b:AAAA\r\nNOTE:a\\,b\\n\r\n c##\r\nEND:VCARD\r\n"
    return files.parsed(_files(table, card), "content", people.vcards, people.CONTACT_FIELDS, ("s_suppkey",))


@query("""SELECT s_suppkey, x.* REPLACE (replace("UID", '##', s_suppkey::VARCHAR) AS "UID") FROM supplier, (VALUES ('Event', 'Meet; now', '2024-03-30 09:00:00', '2024-03-31 10:30:00', 'false', 'Europe/Paris', 'Hall', '', 'o@x.org', 'a@x.org' || chr(10) || 'b@x.org', 'FREQ=DAILY', '2024-04-01 09:00:00', '', 'u##'), ('To-do', 'Day', '2024-05-01', '2024-05-03', 'true', '', '', '', '', '', '', '', '', '')) x("Type", "Title", "Start", "End", "All day", "Time zone", "Location", "Description", "Organizer", "Attendees", "RRULE", "EXDATE", "Recurrence ID", "UID")""")
def ical_rows(spark, table):
    text = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:u##\nSUMMARY:Meet\\; now\nDTSTART;TZID=Europe/Paris:20240330T090000\nDURATION:P1DT1H30M\nLOCATION:Ha\n ll\nORGANIZER:mailto:o@x.org\nATTENDEE:mailto:a@x.org\nATTENDEE:mailto:b@x.org\nRRULE:FREQ=DAILY\nEXDATE:20240401T090000\nBEGIN:VALARM\nSUMMARY:no\nEND:VALARM\nEND:VEVENT\nBEGIN:VTODO\nSUMMARY:Day\nDTSTART;VALUE=DATE:20240501\nDURATION:P2D\nEND:VTODO\nEND:VCALENDAR\n"
    return files.parsed(_files(table, text), "content", people.calendar, people.CALENDAR_FIELDS, ("s_suppkey",))


_SUBTITLES = {
    "srt": "1\n00:00:01,000 --> 00:00:02,500\n{\\an8}One\ntwo\n\n2\n00:00:03,000 --> 00:00:03,000\nno length\n3\n00:00:04.5 --> 00:00:06\nThree## &amp; more\n",
    "vtt": "WEBVTT\n\nNOTE x\n\nid\n00:01.000 --> 00:02.500 align:left\n<v Jo>One</v>\ntwo\n\n00:00:04.500 --> 00:00:06.000\nThree## &amp; more\n",
    "lrc": "[offset:+300]\n[00:01.50][00:09.50]One\n[00:03.00]Two\n[00:06.50]\n",
    "sub": "{1}{1}20\n{40}{70}One|two\n{100}{}Three##\n{150}{200}{y:i}Four\n",
    "smi": "<SAMI><BODY><SYNC Start=1000><P Class=KRCC>하나<SYNC Start=1000><P Class=ENCC>One<br>two<SYNC Start=2500><P Class=ENCC>&nbsp;<SYNC Start=4000><P Class=ENCC>Three##</BODY></SAMI>",
    "ass": "[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.00,0:00:02.50,D,{\\b1}One\\Ntwo, three\nDialogue: 0,0:00:03.00,0:00:04.00,D,{\\p1}m 0 0 l 1 1\n",
    "ttml": '<tt><body><div><p begin="00:00:01.000" end="00:00:02.500">One<br/>two</p><p begin="4.5s" end="6s">Three##</p></div></body></tt>',
}
_CUES = [
    ("srt", 1000, 2500, "One\ntwo"), ("srt", 4500, 6000, "Three## &amp; more"), ("vtt", 1000, 2500, "One\ntwo"), ("vtt", 4500, 6000, "Three## & more"), ("lrc", 1200, 2700, "One"), ("lrc", 2700, 6200, "Two"), ("lrc", 9200, 13200, "One"),
    ("sub", 2000, 3500, "One\ntwo"), ("sub", 5000, 7500, "Three##"), ("sub", 7500, 10000, "Four"), ("smi", 1000, 2500, "One\ntwo"), ("smi", 4000, 8000, "Three##"), ("ass", 1000, 2500, "One\ntwo, three"), ("ttml", 1000, 2500, "One\ntwo"), ("ttml", 4500, 6000, "Three##"),
]


@query('SELECT s_suppkey, kind, start::BIGINT AS start, "end"::BIGINT AS "end", replace(text, \'##\', s_suppkey::VARCHAR) AS text FROM supplier, (VALUES ' + ", ".join(f"('{k}', {a}, {b}, replace('{t}', '|', chr(10)))".replace("\n", "|") for k, a, b, t in _CUES) + ') x(kind, start, "end", text)')
def subtitle_cues(spark, table):
    """Seven formats to one table of cues."""
    out = None
    for kind, text in _SUBTITLES.items():
        one = files.parsed(_files(table, text), "content", subtitles.parser(kind), subtitles.FIELDS, ("s_suppkey",)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionAll(one)
    return out.select("s_suppkey", "kind", "start", "end", "text")


@query('SELECT s_suppkey, x.* REPLACE (replace(wkt, \'##\', s_suppkey::VARCHAR) AS wkt) FROM supplier, (VALUES (0, \'POINT\', \'POINT (## 2)\', \'a\'), (1, \'POLYGON\', \'POLYGON ((0 0, 1 0, 1 1, 0 0))\', \'{"b": 1}\'), (2, NULL, NULL, \'7\')) x(feature, kind, wkt, p)')
def geojson_features(spark, table):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[##,2]},"properties":{"p":"a"}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]},"properties":{"p":{"b":1}}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0]]},"properties":{"p":7}}]}'
    return files.parsed(_files(table, text), "content", geofiles.geojson, geofiles.FEATURES, ("s_suppkey",)).select("s_suppkey", "feature", "kind", "wkt", F.col("properties")["p"].alias("p"))


@query("SELECT s_suppkey, x.* REPLACE (replace(name, '##', s_suppkey::VARCHAR) AS name) FROM supplier, (VALUES (0, 'POINT', 'POINT (1 2)', 'A##', 'v'), (1, 'MULTILINESTRING', 'MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))', NULL, NULL)) x(feature, kind, wkt, name, d)")
def kml_features(spark, table):
    line = lambda c: f"<LineString><coordinates>{c}</coordinates></LineString>"
    text = f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark><name>A##</name><ExtendedData><Data name="d"><value>v</value></Data></ExtendedData><Point><coordinates>1,2</coordinates></Point></Placemark></Folder><Placemark><MultiGeometry>{line("0,0 1,1")}{line("2,2 3,3")}</MultiGeometry></Placemark></Document></kml>'
    return files.parsed(_files(table, text), "content", geofiles.kml, geofiles.FEATURES, ("s_suppkey",)).select("s_suppkey", "feature", "kind", "wkt", F.col("properties")["name"].alias("name"), F.col("properties")["d"].alias("d"))


@query("SELECT s_suppkey, x.* REPLACE (replace(wkt, '##', s_suppkey::VARCHAR) AS wkt) FROM supplier, (VALUES (0, 'POINT Z (1 2 ##)', 'wpt'), (1, 'LINESTRING (0 0, 1 1)', 'trk'), (2, NULL, 'rte')) x(feature, wkt, kind)")
def gpx_features(spark, table):
    text = '<gpx><wpt lat="2" lon="1"><ele>##</ele></wpt><trk><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/></trkseg><trkseg><trkpt lat="5" lon="5"/></trkseg></trk><rte><rtept lat="0" lon="0"/></rte></gpx>'
    return files.parsed(_files(table, text), "content", geofiles.gpx, geofiles.FEATURES, ("s_suppkey",)).select("s_suppkey", "feature", "wkt", F.col("properties")["gpx_type"].alias("kind"))


@query("""SELECT r_regionkey::INTEGER AS "row", r_name AS text, r_regionkey::DOUBLE AS value FROM region""")
def xlsx_cells(spark, table):
    """A workbook a row, written and read again."""

    def write(key, name):
        return sheets.to_xlsx({"S & T": [["key", "name"], [key, name], [None, True]]})

    f = files.made(table("region").select("r_regionkey", "r_name"), "content", write, ["r_regionkey", "r_name"])
    c = files.parsed(f, "content", sheets.xlsx, sheets.CELLS, ("r_regionkey",)).where("row = 1")
    return c.groupBy(F.col("r_regionkey").alias("row")).agg(F.max(F.when(F.col("column") == 1, F.col("text"))).alias("text"), F.max("value").alias("value"))


@query("SELECT s_suppkey, x.* REPLACE (replace(text, '##', s_suppkey::VARCHAR) AS text) FROM supplier, (VALUES ('Hi', 'a@x.org', 'plain text ##', '<b>x</b>')) x(subject, sender, text, html)")
def mail_rows(spark, table):
    text = 'Subject: Hi\nFrom: a@x.org\nTo: b@x.org\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\nplain text ##\n--b\nContent-Type: text/html\n\n<b>x</b>\n--b--\n'
    m = files.parsed(_files(table, text), "content", files.mail, files.MAIL, ("s_suppkey",))
    return m.select("s_suppkey", "subject", "sender", F.trim(F.regexp_replace("text", r"\s+$", "")).alias("text"), F.regexp_replace("html", r"\s+$", "").alias("html"))


@query("SELECT doc_id, 'utf-8' AS how, md5(text) AS digest FROM documents UNION ALL SELECT doc_id, 'utf-16', md5(text) FROM documents")
def encoding_detection(spark, table):
    """Texts as bytes in two encodings, told and decoded again."""

    def parse(data: bytes):
        yield (files.decode(data),)

    d = table("documents")
    both = d.select("doc_id", F.lit("utf-8").alias("how"), F.encode("text", "UTF-8").alias("content")).unionAll(d.select("doc_id", F.lit("utf-16").alias("how"), F.encode("text", "UTF-16").alias("content")))
    return files.parsed(both, "content", parse, "text string", ("doc_id", "how")).select("doc_id", "how", F.md5("text").alias("digest"))


@query("""SELECT n_nationkey, 0::INTEGER AS table_no, r::INTEGER AS "row", c::INTEGER AS "column", h AS header, CASE WHEN t = '?' THEN n_name ELSE t END AS text FROM nation, (VALUES (0, 0, true, 'key'), (0, 1, true, 'both'), (1, 0, false, '?'), (1, 1, false, 'b'), (1, 2, false, 'c'), (2, 1, false, 'd' || chr(10) || 'e'), (2, 2, false, 'f')) x(r, c, h, t)""")
def html_tables(spark, table):
    """Cells of HTML tables on the grid that row and column spans make."""
    page = F.concat(F.lit("<p>x</p><table><tr><th>key<th colspan=2>both</tr><tr><td rowspan=2> "), "n_name", F.lit(" <td>b<td>c<script>no</script></tr><tr><td>d<br>e<td>f</table><table><tr><td></table>"))
    from ..sources import markup

    return files.parsed(table("nation").select("n_nationkey", page.alias("content")), "content", markup.tables, markup.TABLES, ("n_nationkey",))


@query("""SELECT p_partkey, '<p>' || p_name || ' <a href="https://x/?a=1&amp;b=2">y</a><a>z</a> &lt;</p>' AS html FROM part""")
def html_sanitise(spark, table):
    from ..sources import markup

    page = F.concat(F.lit("<head><title>t</title></head><p onclick='x()'>"), "p_name", F.lit(" <a href='https://x/?a=1&b=2' target=_blank>y</a><a href='javascript:x()'>z</a><script>1<2</script><object><p>no</p></object> &lt;</p><blink></blink>"))
    return files.parsed(files.spread(table("part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", page.alias("content")), "content", markup.sanitised, markup.HTML, ("p_partkey",))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '<img src="data:image/png;base64,QUI=">' ELSE '<img src="cid:c' || o_orderkey || '">' END AS html FROM orders""")
def inline_references(spark, table):
    """cid: links replaced by the parts they name: links exploded, joined by content id, and put back."""
    o = table("orders").select("o_orderkey", F.concat(F.lit('<img src="cid:c'), "o_orderkey", F.lit('">')).alias("html"))
    parts = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.lit("<C"), "o_orderkey", F.lit(">")).alias("cid"), references.data_uri(F.lit("image/png"), F.lit("AB").cast("binary")).alias("uri"))
    return references.inlined(o, parts, "o_orderkey", "html", "cid", "uri")


@query("""SELECT 'customers_' || c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN '.csv' ELSE ' (2).csv' END AS file, count(*) AS n, sum(c_custkey)::BIGINT AS keys, md5(string_agg(c_name || chr(10) || '"' || coalesce(CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey END::VARCHAR, '') || ', ', '|' ORDER BY c_custkey)) AS texts FROM customer GROUP BY ALL""")
def sheets_round_trip(spark, table):
    """Customers written as one file a segment, twice into one folder, with cells that need quotes, and read back from all files."""
    c, folder = table("customer"), f"{shared_folder(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    nation = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey"))
    cells = c.select("c_mktsegment", "c_custkey", "c_nationkey", F.concat(F.col("c_name"), F.lit('\n"'), F.coalesce(nation.cast("string"), F.lit("")), F.lit(", ")).alias("text"))
    for k in range(2):
        sheets_out.write(cells.where(F.col("c_nationkey") % 2 == k), folder, "customers", "c_mktsegment")
    back = sheets_out.read(spark, folder, file_column="file")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").cast("long").alias("k"), "text"))), lambda x: x["text"]), "|")
    return back.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("keys"), F.md5(text).alias("texts"))


@query("""SELECT doc_id, coalesce(sum(octet_length(encode(coalesce(text, ''))) + 2) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS content FROM documents""")
def ordered_merge(spark, table):
    """All texts in one file, the last first, with two bytes between, read back from their places."""
    target = f"{shared_folder(spark).rstrip('/')}/merged-{uuid.uuid4().hex}.txt"
    parts = merging.merge_rows(table("documents").select("doc_id", "text"), [Key("doc_id", descending=True)], "text", target, b"\r\n")
    return merging.read_back(parts, target).withColumn("content", F.md5("content"))
