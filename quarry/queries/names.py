"""Names, orders and page groups."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import names as n
from ..operators import ordering as o
from ..operators import sequences as s
from .registry import query


@query(r"""SELECT p_partkey, label, row_number() OVER (ORDER BY lower(regexp_extract(label, '^([^0-9]*)', 1)) COLLATE C, length(d), d, p_partkey) AS place
FROM (SELECT *, ltrim(regexp_extract(label, '([0-9]+)', 1), '0') AS d FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || lpad((p_partkey * 7 % 1000)::VARCHAR, (2 + p_partkey % 4)::INTEGER, '0') AS label FROM part))""")
def natural_sort(spark, table):
    k = F.col("p_partkey")
    # The SQL lpad cuts numbers that are longer than asked for, as Spark's does.
    label = F.concat_ws(" ", F.split("p_name", " ")[0], F.lpad((k * 7 % 1000).cast("string"), (2 + k % 4).cast("int"), F.lit("0")))
    return o.ranked(table("part").select("p_partkey", label.alias("label")), [o.Key(n.natural_key(F.col("label"))), o.Key("p_partkey")])


@query("""SELECT event_id, changed, row_number() OVER (ORDER BY changed IS NULL, changed DESC, event_type, event_id) AS place FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN ts END AS changed FROM events)""")
def nulls_last_sort(spark, table):
    """Files by date, newest first; unknown dates come last in either direction."""
    e = table("events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("changed"))
    return o.ranked(e, s.dated("changed", True, o.Key("event_type"), o.Key("event_id"))).drop("event_type")


@query("""SELECT path, row_number() OVER (ORDER BY top, has_sub DESC, sub NULLS LAST, n, path) AS place FROM (SELECT o_orderkey % 40 AS top, o_orderkey % 3 = 0 AS has_sub, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS sub, o_custkey * 10000000 + o_orderkey AS n,
'Dir' || o_orderkey % 40 || CASE WHEN o_orderkey % 3 = 0 THEN '/s' || o_orderkey % 7 ELSE '' END || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'c' END || o_custkey || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '00' ELSE '' END || o_orderkey || '.txt' AS path FROM orders)""")
def folder_sort(spark, table):
    """Each folder's files stay together, sub-folders come before files, every level is in natural order."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("Dir"), text(k % 40), F.when(k % 3 == 0, F.concat(F.lit("/s"), text(k % 7))).otherwise(""), F.lit("/"), F.when(k % 2 == 0, "C").otherwise("c"), text(F.col("o_custkey")), F.lit(" "), F.when(k % 5 == 0, "00").otherwise(""), text(k), F.lit(".txt"))
    return o.ranked(table("orders").select(path.alias("path")), [*o.file_order("name", folders_together=True), o.Key("path")])


_FILES = """(SELECT 'd' || c_custkey % 12 || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'File ' ELSE 'file ' END || CASE WHEN c_custkey % 4 = 0 THEN '00' ELSE '' END || c_custkey * 7 % 1000 || '.txt' AS path, c_custkey * 7 % 1000 AS n, c_custkey % 12 AS d,
CASE WHEN c_nationkey % 5 > 0 THEN TIMESTAMP '2020-01-01' + INTERVAL (c_nationkey) DAY END AS modified, CASE WHEN c_custkey % 7 > 0 THEN TIMESTAMP '2019-01-01' + INTERVAL (c_custkey % 400) HOUR END AS created, c_custkey AS k FROM customer)"""
_BY = {"name": "n, d", "name_descending": "n DESC, d DESC", "modified": "modified NULLS LAST, n, d", "modified_descending": "modified DESC NULLS LAST, n, d", "created": "created NULLS LAST, n, d", "created_descending": "created DESC NULLS LAST, n, d"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS file_order, k, path, row_number() OVER (ORDER BY {by}, path, k) AS place FROM {_FILES}" for name, by in _BY.items()))
def file_sort(spark, table):
    """The six orders of files."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    path = F.concat(F.lit("d"), text(k % 12), F.lit("/"), F.when(k % 2 == 0, "File ").otherwise("file "), F.when(k % 4 == 0, "00").otherwise(""), text(k * 7 % 1000), F.lit(".txt"))
    nation = F.col("c_nationkey")
    # Names are taken apart for each order: dealt out first, as a table of short rows is read in few tasks.
    files = table("customer").repartition("c_custkey").select(
        k.alias("k"), path.alias("path"),
        F.when(nation % 5 > 0, F.date_add(F.lit("2020-01-01").cast("date"), nation.cast("int")).cast("timestamp")).alias("modified"),
        F.when(k % 7 > 0, F.timestamp_add("HOUR", (k % 400).cast("int"), F.lit("2019-01-01").cast("timestamp"))).alias("created"),
    )
    each = [o.ranked(files, [*o.file_order(name), o.Key("path"), o.Key("k")]).select(F.lit(name).alias("file_order"), "k", "path", "place") for name in o.FILE_ORDERS]
    return functools.reduce(lambda a, b: a.unionAll(b), each)


@query("""WITH n AS (SELECT s_suppkey AS id, 'name ' || s_suppkey % 7 AS name FROM supplier), t AS (SELECT DISTINCT 'name ' || n_nationkey % 4 || ' (' || n_nationkey + 2 || ')' AS taken FROM nation),
r AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM n), f AS (SELECT b.name, i.n, row_number() OVER (PARTITION BY b.name ORDER BY i.n) + 1 AS k FROM (SELECT DISTINCT name FROM n) b, (SELECT unnest(range(2, (SELECT max(k) + 40 FROM r))) AS n) i WHERE b.name || ' (' || i.n || ')' NOT IN (SELECT taken FROM t))
SELECT id, name, name || CASE WHEN r.k = 1 THEN '' ELSE ' (' || f.n || ')' END AS free FROM r LEFT JOIN f USING (name, k)""")
def conflict_free_names(spark, table):
    """Names that many rows want, while names with some of the numbers are there already."""
    wanted = table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("name "), (F.col("s_suppkey") % 7).cast("string")).alias("name"))
    k = F.col("n_nationkey")
    taken = table("nation").select(F.concat(F.lit("name "), (k % 4).cast("string"), F.lit(" ("), (k + 2).cast("string"), F.lit(")")).alias("name"))
    return s.free_names(wanted, taken, "name", "id").select("id", "name", "free")


@query(r"""SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace('01 - ' || p_name || ' [x] (2)', '\s*\(\d+\)$', ''), '^\d+[\s._-]*', ''), '\s*(\([^)]*\)|\[[^\]]*\]|\{[^}]*\})', '', 'g')), '\s+', '_', 'g')) || '_v2' AS name FROM part""")
def rename_pipeline(spark, table):
    steps = [("remove_copy_number", "", ""), ("remove_leading_number", "", ""), ("remove_brackets", "", ""), ("spaces_to_underscores", "", ""), ("lowercase", "", ""), ("suffix", "", "_v2"), ("regex", "(", "x"), ("replace", "", "y")]
    return table("part").select("p_partkey", n.rename(F.concat(F.lit("01 - "), "p_name", F.lit(" [x] (2)")), steps).alias("name"))


@query("""SELECT n_nationkey::INTEGER AS "at", CASE WHEN n_nationkey % 5 = 0 THEN 'column' || n_nationkey + 1 WHEN k = 1 THEN h ELSE h || '_' || k END AS header FROM (SELECT n_nationkey, 'c' || n_nationkey % 7 AS h, row_number() OVER (PARTITION BY n_nationkey % 5 = 0, n_nationkey % 7 ORDER BY n_nationkey) AS k FROM nation)""")
def unique_headers(spark, table):
    """Nations as the headers of one row: blank ones by their place, repeats numbered."""
    k = F.col("n_nationkey")
    return s.unique_headers(table("nation").select(k.cast("int").alias("at"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" c"), (k % 7).cast("string"))).alias("header")))


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(lower(parse_filename(split_part(split_part(url, '?', 1), '#', 1))), '^[0-9]$') OR regexp_matches(parse_filename(split_part(split_part(url, '?', 1), '#', 1)), '^.*5$')""".replace("parse_filename(", "regexp_extract(").replace("'#', 1))", "'#', 1), '([^/]*)$', 1)"))
def glob_filter(spark, table):
    name = n.file_name(F.regexp_replace("url", r"[?#].*$", ""))
    return table("pages").where(n.file_filter(name, ["?", "*5", "/(/"]) & ~n.file_filter(name, ["/^[^0-9]$/"])).select("page_id", "url")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'tar.gz' WHEN p_partkey % 4 = 1 THEN 'gz' WHEN p_partkey % 4 = 2 THEN '' ELSE 'pdf' END AS extension FROM part""")
def extension_detect(spark, table):
    k = F.col("p_partkey") % 4
    path = F.concat(F.lit("dir.d/"), F.regexp_replace("p_name", r"\.", ""), F.when(k == 0, ".TAR.gz").when(k == 1, ".gz").when(k == 2, "").otherwise(".tar.PDF"))
    return table("part").select("p_partkey", n.extension(path, ("tar.gz", "tar.xz")).alias("extension"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(p_name, '[.]', '', 'g') || '_a_' || p_partkey || '_b' WHEN 1 THEN '_con' WHEN 2 THEN '_Com' || p_partkey % 9 + 1 || '.txt' ELSE 'converted' END AS safe FROM part""")
def safe_names(spark, table):
    """Part names with signs of paths and tabs in them, names of devices, and names of nothing but points."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.regexp_replace("p_name", r"[.]", ""), F.lit("/a:"), k.cast("string"), F.lit("\tb. "))).when(k % 4 == 1, "con").when(k % 4 == 2, F.concat(F.lit("Com"), (k % 9 + 1).cast("string"), F.lit(".txt"))).otherwise("... ")
    return table("part").select("p_partkey", n.safe_name(name).alias("safe"))


@query("""SELECT DISTINCT p_partkey FROM part WHERE p_partkey BETWEEN 1 AND 3 OR p_partkey = 8 OR p_partkey >= least(1990, (SELECT max(p_partkey) FROM part)) OR p_partkey BETWEEN 20 AND 25""")
def range_expression(spark, table):
    """Pages of "1-3, 8,1990-, 25-20, x, 4-y": swapped and clamped, what can't be read is left out."""
    p = table("part")
    pages = s.page_range(p.agg(F.max("p_partkey").alias("last"), F.lit("1-3, 8,1990-, 25-20, x, 4-y").alias("expression")))
    return p.join(pages.select(F.col("page").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("""SELECT o_orderkey, part::INTEGER AS part, '_p' || min(k) OVER w || CASE WHEN count(*) OVER w > 1 THEN '-' || max(k) OVER w ELSE '' END AS suffix FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, ntile(7) OVER (ORDER BY o_orderkey) AS part FROM orders) WINDOW w AS (PARTITION BY part)""")
def equal_parts(spark, table):
    return s.parts(table("orders").select("o_orderkey"), "o_orderkey", parts=7).select("o_orderkey", "part", "suffix")


@query("""SELECT o_orderkey, part::INTEGER AS part, '_p' || min(k) OVER w || CASE WHEN count(*) OVER w > 1 THEN '-' || max(k) OVER w ELSE '' END AS suffix FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 41 + 1 AS part FROM orders) WINDOW w AS (PARTITION BY part)""")
def every_n(spark, table):
    return s.parts(table("orders").select("o_orderkey"), "o_orderkey", every=41).select("o_orderkey", "part", "suffix")


@query("""SELECT p_partkey, trunc(p_retailprice * 1000000)::BIGINT AS most, round(p_retailprice * 1000000)::BIGINT AS least, trunc(p_partkey * 0.37::DOUBLE)::BIGINT AS share FROM part""")
def size_limits(spark, table):
    """Megabytes are 1,000,000 bytes: a maximum is cut, a minimum rounded, a share of the source cut."""
    return table("part").select("p_partkey", n.size_text(F.col("p_retailprice")).alias("most"), F.round(F.col("p_retailprice") * 1_000_000).cast("long").alias("least"), (F.col("p_partkey") * 0.37).cast("long").alias("share"))
