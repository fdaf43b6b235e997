"""Text, subtitles, calendar and contact fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import sequences as s
from .registry import query


def _sql_html(column: str) -> str:
    out = column
    for block in ("script", "style", "head"):
        out = f"regexp_replace({out}, '<{block}[^>]*>.*?</{block}>', '', 'gis')"
    out = rf"regexp_replace(regexp_replace({out}, '<br\s*/?>', chr(10), 'gi'), '</(p|div|tr|li|h[1-6]|table|blockquote)>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for name, char in x.ENTITIES.items():
        out = f"replace({out}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"SELECT page_id, {_sql_html('html')} AS text FROM pages")
def html_to_text(spark, table):
    return table("pages").select("page_id", x.html_to_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, (u.pos - 1)::INTEGER AS pos, u.p AS paragraph FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(p, pos)""")
def paragraphs(spark, table):
    return table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "paragraph"))


@query("""WITH c AS (SELECT source, lang, sum(length(regexp_replace(t, '[^가-힣]', '', 'g'))) AS hangul, sum(length(regexp_replace(t, '[^぀-ヿ]', '', 'g'))) AS kana, sum(length(regexp_replace(t, '[^一-鿿]', '', 'g'))) AS han
FROM (SELECT *, text || CASE WHEN doc_id % 5 = 0 AND lang = 'fr' THEN '한국' WHEN doc_id % 7 = 0 AND lang = 'de' THEN 'かな漢字' WHEN lang = 'es' AND doc_id % 2 = 0 THEN '漢字' ELSE '' END AS t FROM documents) GROUP BY source, lang)
SELECT source, lang, CASE WHEN hangul > 0 AND hangul >= kana AND hangul >= han // 4 THEN 'ko-KR' WHEN kana > 0 THEN 'ja-JP' WHEN han > 0 THEN 'zh-CN' ELSE 'en-US' END AS guess FROM c""")
def guess_language(spark, table):
    k, lang = F.col("doc_id"), F.col("lang")
    t = F.concat("text", F.when((k % 5 == 0) & (lang == "fr"), "한국").when((k % 7 == 0) & (lang == "de"), "かな漢字").when((lang == "es") & (k % 2 == 0), "漢字").otherwise(""))
    c = table("documents").select("source", "lang", *[x.count_of(t, r).alias(n) for n, r in (("hangul", "가-힣ᄀ-ᇿ㄰-㆏"), ("kana", "぀-ヿ"), ("han", "一-鿿"))])
    c = c.groupBy("source", "lang").agg(*[F.sum(n).alias(n) for n in ("hangul", "kana", "han")])
    return c.select("source", "lang", x.language(F.col("hangul"), F.col("kana"), F.col("han")).alias("guess"))


@query("""SELECT doc_id, doc_id % 10 = 0 AS shaped FROM documents""")
def script_scan(spark, table):
    return table("documents").select("doc_id", x.needs_shaping(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "שלום").otherwise(""))).alias("shaped"))


@query("""WITH c AS (SELECT conv_id, turn, (turn // 2) * 1500 AS start, text FROM conversations), n AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn) AS nx FROM c)
SELECT conv_id, turn, start, coalesce(nx, start + 4000) AS "end" FROM n WHERE nx IS NULL OR nx <> start""")
def cue_intervals(spark, table):
    c = table("conversations").select("conv_id", "turn", (F.floor(F.col("turn") / 2) * 1500).alias("start"))
    return s.cue_ends(c, "conv_id", "start", "turn")


@query("""SELECT event_id, ms, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS text, ms AS back, round(ms * 1000 / 25.0::DOUBLE)::BIGINT AS frame
FROM (SELECT event_id, event_id * 7919 % 359999999 AS ms FROM events)""")
def timecode_text(spark, table):
    e = table("events").select("event_id", (F.col("event_id") * 7919 % 359_999_999).alias("ms"))
    e = e.withColumn("text", x.time_text(F.col("ms")))
    return e.select("event_id", "ms", "text", x.time_ms(F.col("text")).alias("back"), x.frame_ms(F.col("ms"), 25.0).alias("frame"))


@query("""WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE trim(role) <> '') SELECT conv_id, turn, role FROM l WHERE before IS NULL OR before <> role""")
def drop_repeated_lines(spark, table):
    return s.not_repeated(table("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("""SELECT k, CASE i WHEN 0 THEN h3[1] || h3[1] || h3[2] || h3[2] || h3[3] || h3[3] WHEN 1 THEN h6 WHEN 2 THEN h6 WHEN 3 THEN CASE WHEN k % 300 < 256 THEN printf('%02x%02x%02x', k % 300, k % 256, k * 7 % 256) END WHEN 4 THEN '000080' END AS color
FROM (SELECT o_orderkey AS k, o_orderkey % 6 AS i, printf('%03x', o_orderkey % 4096) AS h3, printf('%06x', o_orderkey * 7919 % 16777216) AS h6 FROM orders)""")
def parse_color(spark, table):
    """Orders' numbers as colours in six spellings, the last of them none."""
    k = F.col("o_orderkey")
    text = [F.format_string("#%03x", k % 4096), F.format_string("#%06X", k * 7919 % 16_777_216), F.format_string("#%06x44", k * 7919 % 16_777_216), F.format_string("rgb(%d, %d,%d)", k % 300, k % 256, k * 7 % 256), F.lit(" Navy "), F.format_string("no %d", k)]
    return table("orders").select(k.alias("k"), x.color(F.coalesce(*[F.when(k % 6 == i, t) for i, t in enumerate(text)])).alias("color"))


_DURATIONS = [("P1W2D", 9, 0), ("PT1H30M", 0, 5400), ("-P1DT2H", -1, -7200), ("+PT5S", 0, 5), ("P", None, None), ("PT", None, None), ("1D", None, None), ("P3D", 3, 0)]


@query("""SELECT event_id, text, ts + to_days(days::INTEGER) + to_seconds(seconds) AS "end" FROM (SELECT event_id, ts, event_id % 8 AS k FROM events) JOIN (VALUES """ + ", ".join(f"({k}, '{a}', {b}, {c})" for k, (a, b, c) in enumerate(_DURATIONS) if b is not None) + """) x(k, text, days, seconds) USING (k)""")
def duration_end(spark, table):
    """Each event's end by a duration of its own: days on the calendar, the rest on the clock; events with a malformed one have none."""
    text = F.element_at(F.array(*[F.lit(a) for a, _, _ in _DURATIONS]), (F.col("event_id") % len(_DURATIONS) + 1).cast("int"))
    e = table("events").select("event_id", "ts", text.alias("text")).withColumn("d", x.duration(F.col("text"))).where("d is not null")
    return e.select("event_id", "text", F.expr("ts + make_dt_interval(cast(d.days as int), 0, 0, d.seconds)").alias("end"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP WHEN 1 THEN date_trunc('day', o_orderdate)::TIMESTAMP + to_seconds(o_orderkey % 86400) END AS "at" FROM orders""")
def calendar_times(spark, table):
    """Order dates as calendars write them: days, moments, and three forms that are none."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("timestamp")
    at = F.timestamp_add("SECOND", (k % 86_400).cast("int"), day)
    text = [F.date_format(day, "yyyyMMdd"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(day, "yyyy-MM-dd"), F.date_format(at, "yyyyMMdd'T'HHmm"), F.concat(F.date_format(day, "yyyy"), F.lit("1332"))]
    return table("orders").select("o_orderkey", x.calendar_time(F.coalesce(*[F.when(k % 5 == i, t) for i, t in enumerate(text)])).alias("at"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 15 * 3600 + c_custkey * 7 % 60 * 60 + CASE WHEN c_custkey % 5 = 3 THEN c_custkey % 60 ELSE 0 END))::INTEGER END AS seconds FROM customer""")
def utc_offsets(spark, table):
    """Customers' zones as +hhmm and +hhmmss; without a sign there is none."""
    k = F.col("c_custkey")
    text = F.format_string("%s%02d%02d%s", F.when(k % 5 == 4, "").when(k % 2 == 0, "+").otherwise("-"), k % 15, k * 7 % 60, F.when(k % 5 == 3, F.format_string("%02d", k % 60)).otherwise(""))
    return table("customer").select("c_custkey", x.utc_offset(text).alias("seconds"))


@query("""SELECT p_partkey, p_name || ',' || p_brand || ';' || p_type || chr(10) || 'x\\y' AS value, 4::INTEGER AS fields FROM part""".replace("\\\\", "\\"))
def content_line_escaping(spark, table):
    """Escaped, folded, unfolded and unescaped again; the escaped semicolons split nothing."""
    p = table("part").select("p_partkey", F.concat("p_name", F.lit(","), "p_brand", F.lit(";"), "p_type", F.lit("\nx\\y")).alias("v"))
    line = F.concat_ws(";", F.lit("a"), x.escape(F.col("v")), F.lit("b\r\n c"), F.lit(""))
    p = p.withColumn("f", x.split_fields(x.unfold(line)))
    return p.select("p_partkey", x.unescape(F.col("f")[1]).alias("value"), F.size("f").alias("fields"))


@query(r"""SELECT doc_id, substr(line, 1, 75) || regexp_replace(substr(line, 76), '.{1,74}', chr(13) || chr(10) || ' \0', 'g') AS folded
FROM (SELECT doc_id, 'NOTE:' || regexp_replace(text, '[^ -~]', '?', 'g') AS line FROM documents)""")
def folded_lines(spark, table):
    """Of ASCII only, where SQL's characters are bytes; the tests fold wider characters."""
    line = F.concat(F.lit("NOTE:"), F.regexp_replace("text", "[^ -~]", "?"))
    return table("documents").select("doc_id", x.fold(line).alias("folded"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' ' || c_name WHEN 1 THEN '김철수' WHEN 2 THEN c_mktsegment ELSE '' END AS name, CASE c_custkey % 3 WHEN 0 THEN '1979-11-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN (1900 + c_custkey % 100)::VARCHAR ELSE '--0102' END AS birthday FROM customer""")
def contact_names(spark, table):
    """Customers as contacts with a family and a given name, a name without spaces between, a firm only, or blanks; three forms of birthdays."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    family, given = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, "김"), F.when(k % 4 == 0, F.col("c_mktsegment")).when(k % 4 == 1, "철수").when(k % 4 == 3, " ")
    org = F.when(k % 4 == 2, F.col("c_mktsegment")).when(k % 4 == 3, " ").otherwise(none)
    day = F.when(k % 3 == 0, F.format_string("197911%02d", k % 28 + 1)).when(k % 3 == 1, (1900 + k % 100).cast("string")).otherwise("--0102")
    return table("customer").select("c_custkey", x.full_name(family, given, org).alias("name"), x.birthday(day).alias("birthday"))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name || ' (É-' || p_partkey || ') 이름', '[^\p{L}\p{N}]', '', 'g')) AS key FROM part""")
def header_keys(spark, table):
    return table("part").select("p_partkey", x.header_key(F.concat("p_name", F.lit(" (É-"), F.col("p_partkey").cast("string"), F.lit(") 이름"))).alias("key"))
