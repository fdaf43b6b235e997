"""Routes over the conversion graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import catalog, routes
from .registry import query, rows

_TREES = "(VALUES " + ", ".join(f"('{t}')" for t in catalog.TREES) + ") t(f)"


def _values(names):
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ")"


_EDGES = f"""e(engine, a, b, cost, direct) AS (SELECT 'data', x.f, y.f, 10, false FROM {_values(catalog.TREES)} x(f), {_values(catalog.TREES)} y(f) WHERE x.f <> y.f
UNION ALL SELECT 'data', f, 'csv', 10, false FROM {_values([*catalog.TREES, 'vcf', 'ics', 'har', 'plist'])} x(f) UNION ALL SELECT 'data', 'csv', f, 10, false FROM {_values([*catalog.TREES, 'vcf', 'ics'])} x(f)
UNION ALL SELECT 'data', x.f, y.f, 10, false FROM {_values(['har', 'plist'])} x(f), {_values(catalog.TREES)} y(f) UNION ALL SELECT 'data', 'plist', 'txt', 10, false UNION ALL SELECT 'data', 'txt', 'csv', 10, true
UNION ALL SELECT 'subtitle', x.f, y.f, 10, y.f = 'txt' FROM {_values(catalog.SUBTITLES_IN)} x(f), {_values(catalog.SUBTITLES_OUT)} y(f) WHERE x.f <> y.f
UNION ALL SELECT 'geo', x.f, y.f, 10, false FROM {_values([*catalog.GEO, *catalog.GEO_IN])} x(f), {_values([*catalog.GEO, 'csv'])} y(f) WHERE x.f <> y.f UNION ALL SELECT 'geo', 'csv', f, 10, false FROM {_values(catalog.GEO)} x(f)
UNION ALL SELECT 'spreadsheet', x.f, y.f, 10, false FROM {_values(catalog.SHEETS_IN)} x(f), {_values(catalog.SHEETS_OUT)} y(f) WHERE x.f <> y.f AND NOT (y.f = 'xlsx' AND x.f IN ('xlsm', 'xltx'))
UNION ALL SELECT * FROM (VALUES ('markdown', 'md', 'html', 4, false), ('markdown', 'md', 'txt', 5, false)) v
UNION ALL SELECT 'eml', a, b, 10, false FROM (VALUES ('eml', 'html'), ('eml', 'txt'), ('eml', 'zip'), ('msg', 'eml'), ('msg', 'html'), ('msg', 'txt'), ('msg', 'zip'), ('mhtml', 'html')) v(a, b)
UNION ALL SELECT 'document-tables', x.f, y.f, 10, true FROM {_values(['docx', 'html', 'mhtml'])} x(f), {_values(['xlsx', 'ods', 'csv'])} y(f))"""

_PATHS = """p(origin, node, cost, hops, path, done) AS (SELECT DISTINCT a, a, 0, 0, [a], false FROM e UNION ALL
SELECT origin, b, p.cost + e.cost + coalesce(extra, 0), hops + 1, list_append(path, b), direct FROM p JOIN e ON e.a = p.node LEFT JOIN pr ON pr.engine = e.engine WHERE hops < 3 AND NOT done AND NOT (direct AND hops > 0) AND NOT list_contains(path, b))"""


def _routes_sql(priority: str) -> str:
    return f"WITH RECURSIVE pr(engine, extra) AS (SELECT * FROM (VALUES {priority}) v), {_EDGES}, {_PATHS} SELECT origin, node AS target, min(cost)::INTEGER AS cost, arg_min(hops, cost * 10 + hops)::INTEGER AS hops FROM p WHERE hops > 0 GROUP BY origin, node"


_ORIGINS = "json xlsx kml srt md eml docx fit plist zip".split()
_ORIGIN_SQL = "[" + ", ".join(f"'{f}'" for f in _ORIGINS) + "]"


def _with_origin(df, key):
    """Rows of a table as files, each of a format by its key."""
    return df.select(key, F.element_at(F.array(*map(F.lit, _ORIGINS)), (F.col(key) % len(_ORIGINS) + 1).cast("int")).alias("origin"))


def _all_routes(spark, priority=None, categories=False):
    e = routes.admissible(catalog.edges(spark), priority=priority)
    ids = e.select(F.col("from").alias("id")).distinct()
    if categories:
        known = ids.join(F.broadcast(catalog.formats(spark).select("id", "category")), "id", "left").select("id", F.coalesce("category", F.lit("")).alias("category"))
        return routes.routes(known, e)
    return routes.routes(ids.withColumn("category", F.lit("")), e)


@query("WITH r AS (" + _routes_sql("('none', 0)") + f"), f AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT origin FROM r)), g AS (SELECT page_id, origin FROM pages JOIN f ON i = page_id % c) SELECT page_id, origin, target, cost, hops FROM r LEFT JOIN g USING (origin)")
def route_reachable(spark, table):
    """All routes: pages as files of every format that can be made into another, with each of its targets; a format without a page stays."""
    r = _all_routes(spark, categories=True).select("origin", "target", "cost", "hops")
    of = F.broadcast(r.select("origin").distinct().agg(F.array_sort(F.collect_list("origin")).alias("all")))
    pages = table("pages").select("page_id").crossJoin(of).select("page_id", F.get("all", (F.col("page_id") % F.size("all")).cast("int")).alias("origin"))
    missing = r.join(pages.select("origin").distinct(), "origin", "left_anti").select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "origin", "target", "cost", "hops")
    return pages.join(F.broadcast(r), "origin").select("page_id", "origin", "target", "cost", "hops").unionAll(missing)


@query(f"SELECT p_partkey, {_ORIGIN_SQL}[p_partkey % {len(_ORIGINS)} + 1] AS origin, ['json', 'csv', 'gpx', 'txt'][p_partkey % 4 + 1] AS target, cost, hops FROM part LEFT JOIN (" + _routes_sql("('geo', 3), ('spreadsheet', 1)") + f") r ON r.origin = {_ORIGIN_SQL}[p_partkey % {len(_ORIGINS)} + 1] AND r.target = ['json', 'csv', 'gpx', 'txt'][p_partkey % 4 + 1]")
def route_with_priority(spark, table):
    """Parts as files that are to become one of four formats, with two engines that cost more."""
    r = _all_routes(spark, rows(spark, "engine string, priority int", [("geo", 3), ("spreadsheet", 1)])).select("origin", "target", "cost", "hops")
    want = F.element_at(F.array(*map(F.lit, ("json", "csv", "gpx", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _with_origin(table("part"), "p_partkey").withColumn("target", want).join(F.broadcast(r), ["origin", "target"], "left").select("p_partkey", "origin", "target", "cost", "hops")


_WANTED = [("xlsm", "json", 20, "xlsm,csv,json"), ("fit", "yaml", 20, "fit,csv,yaml"), ("md", "html", 4, "md,html"), ("kml", "vcf", 20, "kml,csv,vcf"), ("srt", "json", None, None)]


@query("SELECT c_custkey, origin, target, cost, path FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {'NULL' if c is None else c}, {'NULL' if p is None else repr(p)})" for i, (a, b, c, p) in enumerate(_WANTED)) + ") x(i, origin, target, cost, path) ON i = c_custkey % 5")
def route_cheapest(spark, table):
    """Customers' files with a wish each, the last of them beyond reach."""
    want = F.element_at(F.array(*[F.struct(F.lit(a).alias("origin"), F.lit(b).alias("target")) for a, b, _, _ in _WANTED]), (F.col("c_custkey") % len(_WANTED) + 1).cast("int"))
    r = _all_routes(spark).select("origin", "target", "cost", F.array_join("path", ",").alias("path"))
    return table("customer").select("c_custkey", want.alias("w")).select("c_custkey", "w.*").join(F.broadcast(r), ["origin", "target"], "left").select("c_custkey", "origin", "target", "cost", "path")


@query("SELECT s_suppkey, f AS format, engine, cost FROM (SELECT s_suppkey, ['srt', 'vtt', 'shp', 'geojson', 'txt', 'json', 'png'][s_suppkey % 7 + 1] AS f FROM supplier) LEFT JOIN (SELECT format, engine, cost::INTEGER AS cost FROM (VALUES " + ", ".join(f"('{f}', 'subtitle', 10)" for f in catalog.SUBTITLES_OUT if f != "txt") + ", ('shp', 'geo', 10), ('geojson', 'geo', 10), ('txt', 'markdown', 4)) x(format, engine, cost)) ON format = f")
def self_conversion(spark, table):
    """Suppliers' files that are to keep their format: the engine that writes them anew, if there is one."""
    f = F.element_at(F.array(*map(F.lit, ("srt", "vtt", "shp", "geojson", "txt", "json", "png"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table("supplier").select("s_suppkey", f.alias("format")).join(F.broadcast(routes.self_conversion(catalog.edges(spark)).select("format", "engine", "cost")), "format", "left").select("s_suppkey", "format", "engine", "cost")


@query("""WITH e AS (SELECT 'f' || l_suppkey % 9 AS a, 't' || l_partkey % 7 AS b, CASE l_orderkey % 11 WHEN 0 THEN 'frames' WHEN 1 THEN 'motion' WHEN 2 THEN 'live' END AS special, l_quantity::INTEGER AS cost FROM lineitem)
SELECT a AS "from", b AS "to", arg_min(special, (CASE special WHEN 'frames' THEN 0 WHEN 'motion' THEN 1 ELSE 2 END, cost)) AS special, arg_min(cost, (CASE special WHEN 'frames' THEN 0 WHEN 'motion' THEN 1 ELSE 2 END, cost)) AS cost FROM e WHERE special IS NOT NULL GROUP BY ALL""")
def special_routes(spark, table):
    """Line items as edges, some with a special use: between two formats the first use in order counts, at its least cost."""
    k = F.col("l_orderkey") % 11
    e = table("lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 9).cast("string")).alias("from"), F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")).alias("to"), F.when(k == 0, "frames").when(k == 1, "motion").when(k == 2, "live").alias("special"), F.col("l_quantity").cast("int").alias("cost"))
    return routes.special_route(e, ["frames", "motion", "live", "caption"])


@query("""WITH one AS (SELECT 'o' || c_custkey % 3 AS o, 'pdf' || c_nationkey % 5 AS m, (c_custkey % 50 + 1)::INTEGER AS c FROM customer), two AS (SELECT 'pdf' || s_nationkey % 5 AS m, 't' || s_suppkey % 4 AS t, (s_suppkey % 30 + 1)::INTEGER AS c FROM supplier)
SELECT o AS origin, t AS target, min(one.c + two.c)::INTEGER AS cost FROM (SELECT o, m, min(c) AS c FROM one GROUP BY ALL) one JOIN (SELECT m, t, min(c) AS c FROM two GROUP BY ALL) two USING (m) GROUP BY ALL""")
def composed_routes(spark, table):
    """Customers' ways to a format between and suppliers' ways on from it: the cheapest of both together."""
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    least = lambda df: df.groupBy("origin", "target").agg(F.min("cost").alias("cost")).withColumn("path", F.array("origin", "target"))
    one = table("customer").select(text("o", F.col("c_custkey") % 3).alias("origin"), text("pdf", F.col("c_nationkey") % 5).alias("target"), (F.col("c_custkey") % 50 + 1).cast("int").alias("cost"))
    two = table("supplier").select(text("pdf", F.col("s_nationkey") % 5).alias("origin"), text("t", F.col("s_suppkey") % 4).alias("target"), (F.col("s_suppkey") % 30 + 1).cast("int").alias("cost"))
    return routes.composed(least(one), least(two)).select("origin", "target", "cost")


_EXTENSIONS = [(e, n.removesuffix("-").partition(":")[0], c) for c, names in catalog.FORMATS.items() for n in names.split() for e in (n.removesuffix("-").partition(":")[2] or n.removesuffix("-")).split(",")]


@query("""SELECT page_id, id AS format, category FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]+)$', 1)) AS e FROM pages) LEFT JOIN (VALUES """ + ", ".join(f"('{e}', '{i}', '{c}')" for e, i, c in _EXTENSIONS) + ") f(ext, id, category) ON ext = e")
def format_detect(spark, table):
    """Formats by the extension of a page's address, without its query and anchor: a join with the catalogue. Others have none."""
    from ..functions.names import extension

    f = catalog.formats(spark).select("id", "category", F.explode("extensions").alias("ext"))
    p = table("pages").select("page_id", F.lower(extension(F.regexp_replace("url", "[?#].*$", ""))).alias("ext"))
    return p.join(F.broadcast(f), "ext", "left").select("page_id", F.col("id").alias("format"), "category")


@query(f"SELECT category, count(*) AS pages, count(*) FILTER (w) AS writable FROM pages JOIN (VALUES " + ", ".join(f"('{n.removesuffix('-').partition(':')[0]}', '{c}', {'false' if n.endswith('-') else 'true'})" for c, names in catalog.FORMATS.items() for n in names.split()) + f") x(id, category, w) ON id = {_ORIGIN_SQL}[page_id % {len(_ORIGINS)} + 1] GROUP BY category")
def format_catalog(spark, table):
    """Pages as files of ten formats, by category, and how many of them can be written."""
    out = _with_origin(table("pages"), "page_id").join(F.broadcast(catalog.formats(spark)), F.col("origin") == F.col("id"))
    return out.groupBy("category").agg(F.count("*").alias("pages"), F.sum(F.col("writable").cast("long")).alias("writable"))
