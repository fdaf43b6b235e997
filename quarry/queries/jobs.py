"""Jobs, history and assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as n
from ..operators import jobs as j
from ..operators import outputs
from .registry import query

_STATE = "CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 'cancelled' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber = 3 THEN 'skipped' ELSE 'done' END"


def _files(table):
    state = F.when((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1), "cancelled").when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linenumber") == 3, "skipped").otherwise("done")
    return table("lineitem").select(F.col("l_orderkey").alias("job"), state.alias("state"), "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@query(f"""SELECT job, CASE WHEN bool_or(state = 'cancelled') THEN 'cancelled' WHEN bool_and(state IN ('done', 'skipped')) THEN 'completed' WHEN bool_or(state = 'done') THEN 'completed_with_errors' ELSE 'failed' END AS state
FROM (SELECT l_orderkey AS job, {_STATE} AS state FROM lineitem) GROUP BY job""")
def job_state(spark, table):
    return j.job_states(_files(table), "job", "state")


@query("""SELECT o_orderkey AS job, round(coalesce(p, 1), 9) AS progress FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity / 50) AS p FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def job_progress(spark, table):
    """Files that failed take no part; a job with nothing else is at its end."""
    files = _files(table).where("l_returnflag <> 'R'").withColumn("p", F.col("l_quantity") / 50)
    return j.job_progress(table("orders").select(F.col("o_orderkey").alias("job")), files, "job", "p").select("job", F.round("progress", 9).alias("progress"))


@query("""SELECT l_orderkey AS job, count(*) AS files, sum(l_quantity::BIGINT)::BIGINT AS bytes, CASE WHEN count(CASE WHEN l_discount > 0.01 THEN 1 END) = count(*) THEN sum(50)::BIGINT END AS total FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def transfer_roll_up(spark, table):
    f = _files(table).select("job", "l_linestatus", F.col("l_quantity").cast("bigint").alias("done"), F.when(F.col("l_discount") > 0.01, F.lit(50).cast("bigint")).alias("size"))
    return j.transfers(f, "job", F.col("l_linestatus") == "O", "done", "size")


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def latest_decides(spark, table):
    return j.latest(table("events"), "user_id", "event_id", ["event_type", "event_id"])


@query("""SELECT l_returnflag, (e + round(r * (e / k)))::BIGINT AS estimate FROM (SELECT l_returnflag, sum(CASE WHEN l_linenumber <> 2 THEN l_quantity END) AS k, sum(CASE WHEN l_linenumber <> 2 THEN l_partkey END)::DOUBLE AS e, sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS r FROM lineitem GROUP BY 1)""")
def size_extrapolation(spark, table):
    known = F.col("l_linenumber") != 2
    f = table("lineitem").select("l_returnflag", "l_quantity", F.when(known, F.col("l_partkey").cast("double")).alias("e"))
    return j.extrapolated(f, "l_returnflag", "l_quantity", "e")


@query("""SELECT conv_id, role, n FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS k FROM conversations GROUP BY conv_id, role) WHERE k = 1""")
def majority_class(spark, table):
    return j.majority(table("conversations"), ["conv_id"], "role", "turn")


@query("""WITH w AS (SELECT o_orderkey, [o_custkey, o_orderkey, o_custkey + 1, o_orderkey // 2] AS refs FROM orders), p AS (SELECT o_orderkey, u.ref, u.at FROM w, unnest(refs) WITH ORDINALITY AS u(ref, at))
SELECT o_orderkey, bool_and(c_custkey IS NOT NULL) AS complete, CASE WHEN bool_and(c_custkey IS NOT NULL) THEN string_agg(c_nationkey::VARCHAR, ',' ORDER BY p.at) END AS way FROM p LEFT JOIN customer ON c_custkey = ref GROUP BY o_orderkey""".replace("u(ref, at)", "u(ref, pos)").replace("u.at", "u.pos").replace("p.at", "p.pos"))
def way_assembly(spark, table):
    """Lists of node numbers to positions, in order; one missing node drops the way."""
    refs = F.array(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") + 1, F.floor(F.col("o_orderkey") / 2))
    out = j.assembled(table("orders").select("o_orderkey", refs.alias("refs")), "o_orderkey", "refs", table("customer"), "c_custkey", "c_nationkey")
    return out.select("o_orderkey", "complete", F.array_join("values", ",").alias("way"))


@query("""SELECT o_orderkey, count(l_orderkey) AS members, bool_and(coalesce(l_quantity < 45, false)) AS complete, CASE WHEN bool_and(coalesce(l_quantity < 45, false)) THEN sum(l_quantity) END AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def relation_all_or_nothing(spark, table):
    return j.all_or_nothing(table("orders"), table("lineitem"), "o_orderkey", "l_orderkey", F.col("l_quantity") < 45, "l_quantity")


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)""")
def anti_join_outputs(spark, table):
    f = table("orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("mtime"))
    ours = f.where("path % 3 = 0").withColumn("length", F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(F.col("length") + 1_000_000))
    return j.not_generated(f, ours).select("o_orderkey")


@query("""SELECT s_suppkey, ext FROM (SELECT s_suppkey, e.ext FROM supplier, (VALUES ('shp'), ('dbf'), ('prj'), ('txt')) e(ext)) WHERE ext IN ('shp', 'txt') AND NOT (ext = 'shp' AND s_suppkey % 2 = 1) OR ext IN ('dbf', 'prj') AND s_suppkey % 2 = 1""")
def companion_files(spark, table):
    """Sidecars go where their main file is in the list."""
    e = spark.createDataFrame([("shp",), ("dbf",), ("prj",), ("txt",)], "ext string")
    f = table("supplier").select("s_suppkey").crossJoin(F.broadcast(e)).where("not (ext = 'shp' and s_suppkey % 2 = 1)")
    f = f.withColumn("path", F.concat(F.lit("d/F"), "s_suppkey", F.lit("."), F.when(F.col("ext") == "shp", "SHP").otherwise(F.col("ext"))))
    return j.without_companions(f, "path", "shp", ["dbf", "prj", "shx", "cpg"]).select("s_suppkey", "ext")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS page, 1 AS place, l_quantity * 100 AS w FROM lineitem), b AS (SELECT *, lag(page) OVER o AS bp, lag(w) OVER o AS bw FROM t WINDOW o AS (PARTITION BY l_orderkey ORDER BY page))
SELECT l_orderkey, page, (sum(CASE WHEN bp = page - 1 AND abs(w - bw) <= 0.05 * greatest(w, bw) + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY page))::INTEGER AS "table" FROM b""".replace("FROM lineitem)", "FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"))
def table_stitching(spark, table):
    t = table("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.max("l_quantity").alias("q")).select("l_orderkey", "page", F.lit(1).alias("place"), F.array(F.col("q") * 100, F.lit(500.0)).alias("widths"))
    return j.stitched(t, "l_orderkey", "page", "place", "widths").select("l_orderkey", "page", "table")


@query("""SELECT c_mktsegment, mode(c_nationkey) AS x FROM customer WHERE false GROUP BY 1 UNION ALL SELECT c_mktsegment, arg_max(c_nationkey, n * 100 - c_nationkey) FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1""")
def most_frequent(spark, table):
    """The mode; ties go to the smallest value."""
    c = table("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return c.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", F.struct("n", (-F.col("c_nationkey")).alias("k"))).alias("x"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(r >= s, true) THEN 'source' ELSE 'result' END AS kept, CASE WHEN coalesce(r >= s, true) THEN s ELSE r END AS size FROM (SELECT l_orderkey, l_linenumber, l_quantity AS s, CASE WHEN l_linenumber <> 2 THEN l_discount * 500 END AS r FROM lineitem)""")
def keep_smaller(spark, table):
    f = table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"), F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 500).alias("r"))
    return j.smaller_only(f, "s", "r").select("l_orderkey", "l_linenumber", "kept", "size")


@query(f"""SELECT job, count(*) AS files, coalesce(string_agg(CASE WHEN state = 'failed' THEN l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber::VARCHAR), '') AS failures, coalesce(string_agg(CASE WHEN state = 'done' THEN l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber::VARCHAR), '') AS outputs
FROM (SELECT l_orderkey AS job, l_linenumber, {_STATE} AS state FROM lineitem) GROUP BY job""")
def history_record(spark, table):
    h = j.history(_files(table).withColumn("name", F.col("l_linenumber").cast("string")), "job", "state", "name")
    return h.select("job", "files", F.array_join("failures", ",").alias("failures"), F.array_join("outputs", ",").alias("outputs"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0""")
def undo_eligibility(spark, table):
    o = table("orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("mtime"))
    now = o.where("path % 2 = 0").withColumn("length", F.when(F.col("path") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return j.undoable(o, now).select("o_orderkey")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'jpg' END AS ext FROM part""")
def media_types(spark, table):
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Text/HTML; charset="), "p_brand")).when(F.col("p_partkey") % 3 == 1, "image/jpeg").otherwise(F.concat(F.lit("x/"), "p_brand"))
    return table("part").select("p_partkey", j.media_extension(kind).alias("ext"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' END AS v FROM nation")
def first_attribute(spark, table):
    m = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("Other"), F.lit("o"), F.lit("NAME"), F.col("n_name"))).otherwise(F.create_map(F.lit("Title"), F.lit("x")))
    return table("nation").select("n_nationkey", j.first_attribute(m, ["name", "title"]).alias("v"))


@query("""SELECT event_type AS rule, count(*) FILTER (NOT failed) AS converted, count(*) FILTER (failed) AS failed FROM (SELECT event_type, user_id, arg_max(event_id % 3 = 0, event_id) AS failed FROM events GROUP BY ALL) GROUP BY event_type""")
def watch_totals(spark, table):
    """A kind of event is a watch rule, a user a source: the newest entry of each decides."""
    e = table("events").select(F.col("event_type").alias("rule"), "user_id", "event_id", (F.col("event_id") % 3 == 0).alias("failed"))
    return j.watch_totals(e, "rule", "user_id", "event_id", "failed")


@query("""WITH o AS (SELECT o_orderkey AS k, 'in/' || o_custkey % 7 || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'Doc ' ELSE 'doc ' END || o_custkey % 90 AS stem, o_orderkey % 5 > 0 AS word FROM orders),
w AS (SELECT k, 'in/' || split_part(stem, '/', 2) || '/sent/' || split_part(stem, '/', 3) || CASE WHEN word THEN '-docx' ELSE '-md' END AS base FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY k) AS i FROM w)
SELECT k, base || CASE WHEN i > 1 THEN ' (' || i || ')' ELSE '' END || '.pdf' AS output FROM n""")
def output_paths(spark, table):
    """Orders as source files: results below each folder, named by a pattern, numbered where an earlier one has the name."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    path = F.concat(F.lit("in/"), text(c % 7), F.lit("/"), F.when(k % 2 == 0, "Doc ").otherwise("doc "), text(c % 90), F.when(k % 5 > 0, ".docx").otherwise(".md"))
    files = table("orders").select(k.alias("k"), path.alias("path"), F.lit("pdf").alias("target"))
    return outputs.allocated(files, files.select("path").limit(0), outputs.Rule("{name}-{ext}", "subfolder", "sent"), "path", "target", "k").select("k", "output")


@query("""SELECT o_orderkey, CASE WHEN a > 12 OR (b IS NOT NULL AND b > 12) THEN CASE WHEN a = 0 OR b = 0 THEN 'invalid' ELSE 'past the end' END WHEN a = 0 OR b = 0 THEN 'invalid' END AS problem FROM (SELECT o_orderkey, o_custkey % 16 AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 14 END AS b FROM orders)""")
def page_range_problems(spark, table):
    """Lists of pages such as 3–5，with dashes and commas of other scripts, against documents of twelve pages."""
    a, b = (F.col("o_custkey") % 16).cast("string"), (F.col("o_orderkey") % 14).cast("string")
    expression = F.when(F.col("o_orderkey") % 3 == 1, F.concat(a, F.lit("–"), b)).when(F.col("o_orderkey") % 3 == 2, F.concat(a, F.lit("，"), b)).otherwise(a)
    return table("orders").select("o_orderkey", n.page_range_problem(expression, F.lit(12)).alias("problem"))


@query("""SELECT page_id, NOT (regexp_extract(url, '[^/]*$') LIKE '%.html') OR contains(url, '/en/') AS ignored FROM pages""")
def watched_files(spark, table):
    """Page addresses as paths of a watch folder that takes HTML files and writes its results to a sub-folder."""
    path = F.concat(F.lit("/in/"), F.regexp_replace("url", "/en/", "/out/"))
    path = F.when(F.col("url").contains("/en/"), F.concat(F.lit("/in/out/"), n.file_name(F.col("url")))).otherwise(path)
    return table("pages").select("page_id", n.ignored(path, "/in", ["html"], output="/in/out").alias("ignored"))
