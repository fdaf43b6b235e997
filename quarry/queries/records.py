"""Records, cells and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import typing as t
from ..operators import grids, references
from ..operators import records as r
from .registry import query


@query("""SELECT event_id, event_type, user_id, json_extract_string(props, '$.k')::BIGINT AS "props.k" FROM events""")
def flatten_records(spark, table):
    """Events with their JSON properties flattened one level and typed."""
    k = r.field("props", "k")
    return table("events").select("event_id", "event_type", "user_id", F.when(t.cell_kind(k) == "integer", k.try_cast("bigint")).alias("props.k"))


@query("""WITH j AS (SELECT event_id, '{"id":' || event_id || ',"' || event_type || '":1,"props":' || props || '}' AS j FROM events),
k AS (SELECT event_id, u.key, u.pos FROM j, unnest(json_keys(j)) WITH ORDINALITY AS u(key, pos)),
f AS (SELECT event_id, pos - 1 AS pos, CASE WHEN key = 'props' THEN 'props.k' ELSE key END AS "column" FROM k)
SELECT "column", (row_number() OVER (ORDER BY first_row, first_pos))::INTEGER AS place FROM (SELECT "column", min(event_id) AS first_row, arg_min(pos, event_id) AS first_pos FROM f GROUP BY "column")""")
def column_union_first_seen(spark, table):
    from pyspark.sql import Window

    j = table("events").select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"'), "event_type", F.lit('":1,"props":'), "props", F.lit("}")).alias("j"))
    c = r.columns_in_order(j, "event_id", "j")
    return c.select("column", F.row_number().over(Window.orderBy("first_row", "first_pos", "first_sub")).alias("place"))


_SHAPES = [('[{"a":##},null,{"b":2}]', "records"), ("[[##,2],[3]]", "rows"), ('[##,"x",null]', "values"), ('{"a":[##,2],"b":[3]}', "columns"), ('{"a":##,"b":[3]}', "record"), ('[##,{"a":2}]', "mixed: objects, lists and single values"), ("##", "single value"), ("[]", "empty")]


@query("SELECT c_custkey, [" + ", ".join(f"'{k}'" for _, k in _SHAPES) + "][c_custkey % 8 + 1] AS shape FROM customer")
def table_shape(spark, table):
    """Customers' numbers in JSON of eight shapes."""
    text = F.element_at(F.array(*[F.lit(j) for j, _ in _SHAPES]), (F.col("c_custkey") % len(_SHAPES) + 1).cast("int"))
    return table("customer").select("c_custkey", r.shape(F.replace(text, F.lit("##"), F.col("c_custkey").cast("string"))).alias("shape"))


@query("""SELECT n_nationkey, '[{"n":' || n_nationkey || '}]' AS records FROM nation""")
def unwrap_records(spark, table):
    j = F.concat(F.lit('{"data":{"items":[{"n":'), "n_nationkey", F.lit("}]}}"))
    return table("nation").select("n_nationkey", r.unwrapped(j).alias("records"))


@query("""SELECT doc_id, md5('"' || replace(text, '"', '""') || '",' || lang || ',"' || lang || ',' || source || '"') AS line FROM documents WHERE text LIKE '%' || chr(10) || '%' OR text LIKE '%,%' OR text LIKE '%"%'
UNION ALL SELECT doc_id, md5(text || ',' || lang || ',"' || lang || ',' || source || '"') FROM documents WHERE NOT (text LIKE '%' || chr(10) || '%' OR text LIKE '%,%' OR text LIKE '%"%')""")
def csv_quote_row(spark, table):
    return table("documents").select("doc_id", F.md5(r.csv_row([F.col("text"), F.col("lang"), F.concat_ws(",", "lang", "source")])).alias("line"))


@query("""SELECT doc_id, lang FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)""")
def drop_empty_rows(spark, table):
    d = table("documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("a"), F.when(F.col("doc_id") % 2 != 0, F.col("source")).otherwise("").alias("b"))
    return r.not_empty(d, ["a", "b"]).select("doc_id", "lang")


@query("""SELECT c_custkey, [',', ';', chr(9)][c_custkey % 3 + 1] AS delimiter FROM customer""")
def delimiter_sniffing(spark, table):
    """Heads of files with three columns and as many commas and semicolons in quotes."""
    mark = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("c_custkey") % 3 + 1).cast("int"))
    head = F.concat(F.lit("a"), mark, F.lit("b"), mark, F.lit('c\n"x,,,,;;;;",'.removesuffix(",")), mark, F.lit('"'), F.col("c_name"), F.lit('"'), mark, F.col("c_acctbal").cast("string"))
    return table("customer").select("c_custkey", r.delimiter(head).alias("delimiter"))


@query("""SELECT 'p_partkey' AS "column", 'integer' AS type, (SELECT max(length(p_partkey::VARCHAR)) FROM part)::INTEGER AS width, 0::INTEGER AS decimals UNION ALL SELECT 'p_brand', 'text', (SELECT max(length(p_brand)) FROM part)::INTEGER, 0
UNION ALL SELECT 'flag', 'logical', 1, 0 UNION ALL SELECT 'price', 'decimal', (SELECT max(length((p_partkey // 7)::VARCHAR)) + 4 FROM part)::INTEGER, 3 UNION ALL SELECT 'mixed', 'text', (SELECT max(length(CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE p_partkey::VARCHAR END)) FROM part)::INTEGER, 0""")
def column_layout(spark, table):
    k = F.col("p_partkey")
    p = table("part").select(k.cast("string").alias("p_partkey"), "p_brand", F.when(k % 2 == 0, "true").otherwise("false").alias("flag"), F.concat(F.floor(k / 7).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")).alias("price"), F.when(k % 2 == 0, "true").otherwise(k.cast("string")).alias("mixed"))
    return r.layout(p, ["p_partkey", "p_brand", "flag", "price", "mixed"])


@query("""SELECT lang, least(50, greatest(4, max(length(source || ' 漢字') + 2)))::INTEGER AS width FROM documents GROUP BY lang""")
def column_width(spark, table):
    w = r.display_width(F.concat("source", F.lit(" 漢字")))
    return table("documents").groupBy("lang").agg(F.least(F.lit(50), F.greatest(F.lit(4), F.max(w))).alias("width"))


@query("""SELECT l_returnflag, min(l_linenumber)::INTEGER AS first_row, max(l_linenumber)::INTEGER AS last_row, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag""")
def used_range(spark, table):
    """Bounding box of the cells that hold something."""
    full = table("lineitem").where("l_discount > 0")
    return full.groupBy("l_returnflag").agg(F.min("l_linenumber").alias("first_row"), F.max("l_linenumber").alias("last_row"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("""SELECT n_regionkey, string_agg(n_name || ' (' || n_nationkey || ')', '; ' ORDER BY n_nationkey) AS cell FROM nation GROUP BY n_regionkey""")
def multi_value_cell(spark, table):
    """Several values in one cell, the kind in brackets; bounded per record."""
    return references.in_one_cell(table("nation"), "n_regionkey", "n_name", "n_nationkey", "n_nationkey")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY at) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS at FROM events GROUP BY ALL) GROUP BY user_id""".replace(" at)", " first_id)").replace(" AS at ", " AS first_id "))
def distinct_in_order(spark, table):
    """Distinct values in the order they were first seen; partial sums first, so a list never holds repeats."""
    return references.distinct_in_order(table("events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("kinds"))


@query("""SELECT e.event_id AS "Started", 'GET' AS "Method", 'https://x/' || e.user_id AS "URL", 200::BIGINT AS "Status", CASE WHEN e.event_id % 3 = 0 THEN NULL WHEN e.event_id % 3 = 1 THEN e.event_id ELSE 7 END AS "Size (bytes)" FROM events e""")
def har_table(spark, table):
    """Requests of HTTP archives: content size before body size, negative ones blank."""
    from ..sources.har import requests

    k = F.col("event_id")
    entry = F.concat(F.lit('{"log":{"entries":[{"startedDateTime":"'), k.cast("string"), F.lit('","request":{"method":"GET","url":"https://x/'), F.col("user_id").cast("string"), F.lit('"},"response":{"status":200,"bodySize":7,"content":{"size":'), F.when(k % 3 == 0, "-1").when(k % 3 == 1, k.cast("string")).otherwise("null"), F.lit("}}}]}}"))
    return requests(table("events").select(entry.alias("json")), "json").select(F.col("Started").cast("bigint").alias("Started"), "Method", "URL", "Status", "Size (bytes)")


_ROUNDS = ", ".join(f"b{i + 1} AS (SELECT b.sheet, b.top, b.left_, greatest(b.bottom, coalesce(max(m.bottom), 0)) AS bottom, greatest(b.right_, coalesce(max(m.right_), 0)) AS right_ FROM b{i} b LEFT JOIN m ON m.sheet = b.sheet AND m.top BETWEEN b.top AND b.bottom AND m.left_ BETWEEN b.left_ AND b.right_ GROUP BY b.sheet, b.top, b.left_, b.bottom, b.right_)" for i in range(16))


@query(f"""WITH c AS (SELECT 's' || l_suppkey % 30 AS sheet, l_orderkey % 60 + 2 AS r, l_linenumber AS k, max(CASE WHEN l_quantity > 25 THEN l_returnflag || ',' || l_linestatus END) AS t FROM lineitem GROUP BY ALL),
m AS (SELECT 's' || s_suppkey % 30 AS sheet, 2 + s_suppkey * 7 % 60 AS top, 1 + s_nationkey % 9 AS left_, 2 + s_suppkey * 7 % 60 + s_suppkey % 5 AS bottom, 1 + s_nationkey % 9 + s_nationkey % 3 AS right_ FROM supplier),
b0 AS (SELECT sheet, min(r) AS top, min(k) AS left_, max(r) AS bottom, max(k) AS right_ FROM c WHERE t <> '' GROUP BY sheet), {_ROUNDS},
l AS (SELECT sheet, u.r, (SELECT string_agg(CASE WHEN contains(coalesce(c.t, ''), ',') THEN '"' || c.t || '"' ELSE coalesce(c.t, '') END, ',' ORDER BY w.k) FROM range(0, right_ + 1) w(k) LEFT JOIN c ON c.sheet = b16.sheet AND c.r = u.r AND c.k = w.k WHERE NOT (EXISTS (SELECT 1 FROM nation WHERE 's' || n_nationkey = b16.sheet AND n_nationkey % 8 = w.k))) AS line
FROM b16, range(0, bottom + 1) u(r) WHERE NOT EXISTS (SELECT 1 FROM part WHERE 's' || p_partkey % 30 = b16.sheet AND p_partkey * 13 % 64 = u.r))
SELECT sheet, top::BIGINT AS top, left_::INTEGER AS "left", bottom::BIGINT AS bottom, right_::INTEGER AS "right", count(*) AS n_lines, md5(string_agg(line, '|' ORDER BY r)) AS lines FROM b16 JOIN l USING (sheet) GROUP BY ALL""")
def sheet_lines(spark, table):
    """Sheets of line items as CSV lines: used ranges with merged areas that lead to others, hidden rows and columns left out."""
    sheet = lambda c: F.concat(F.lit("s"), c.cast("string"))
    i = table("lineitem")
    cells = i.select(sheet(F.col("l_suppkey") % 30).alias("sheet"), (F.col("l_orderkey") % 60 + 2).alias("row"), F.col("l_linenumber").alias("column"), F.when(F.col("l_quantity") > 25, F.concat_ws(",", "l_returnflag", "l_linestatus")).alias("text"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    top, left = k * 7 % 60 + 2, (n % 9 + 1).cast("int")
    merges = table("supplier").select(sheet(k % 30).alias("sheet"), top.alias("top"), left.alias("left"), (top + k % 5).alias("bottom"), (left + n % 3).cast("int").alias("right"))
    rows = table("part").select(sheet(F.col("p_partkey") % 30).alias("sheet"), (F.col("p_partkey") * 13 % 64).alias("at"))
    columns = table("nation").select(sheet(F.col("n_nationkey")).alias("sheet"), (F.col("n_nationkey") % 8).alias("at"))
    ranges = grids.used_range(cells, merges)
    quoted = lambda t: F.when(t.contains(","), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    out = grids.lines(cells, ranges, rows, columns, quoted).select("sheet", F.struct("row", F.array_join("fields", ",").alias("line")).alias("l"))
    text = out.groupBy("sheet").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "|")).alias("lines"))
    return ranges.join(text, "sheet")
