import base64
import hashlib

from quarry.llm.warc import Archive, archive_pages, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, file string, first long"


def expect(rows, least=0):
    first = {}
    for p, _, h in rows:
        h = h or ""
        if p is not None:
            first[h] = min(first.get(h, p), p)
    seen, out = set(), []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = len(b) >= least and (p != f or (p, h or "") in seen)
        seen.add((p, h or ""))
        out.append((str(p), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", str(f if revisit else None)))
    return sorted(out)


def test_round_trip(spark):
    rows = [(5, "http://a/é b?x=1\n", "<p>é\r\n\r\nx</p>"), (3, None, "<p>é\r\n\r\nx</p>"), (9, "u", None), (4, "u", ""), (4, "u", ""), (7, "u", "z" * 300_000), (None, "u", "q"), (None, "v", "z" * 300_000), (8, "u", "one")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for a in (Archive(), Archive(min_payload=2, roll_bytes=10, request_bytes=50, gap_bytes=0)):
        got = sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in archive_pages(df, a).collect())
        assert [g for g in got if g[0] != "None"] == [e for e in expect(rows, a.min_payload) if e[0] != "None"]
    back = {(r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in read_warc(write_warc(df)).collect() if r["payload"] is not None}
    assert (3, "", "<p>é\r\n\r\nx</p>") in back and (8, "u", "one") in back


def test_selected_ranges(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>", None, None) for i in range(200)], SCHEMA)
    index = write_warc(df)
    some = index.where("page_id % 13 = 0")
    assert sorted(r["page_id"] for r in read_warc(some).collect()) == list(range(0, 200, 13))


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
