"""Typing ladders and cell values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..functions import typing as t
from .registry import query, rows

_CELLS = """(SELECT o_orderpriority AS cell FROM orders UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT props FROM events
UNION ALL SELECT v FROM (VALUES ('007'), ('TRUE'), ('False'), (''), ('-1.5e3'), ('1.'), ('12345678901234567890'), ('.5'), ('-0'), ('1e5')) x(v))"""


def _cells(spark, table):
    odd = rows(spark, "cell string", [(x,) for x in ("007", "TRUE", "False", "", "-1.5e3", "1.", "12345678901234567890", ".5", "-0", "1e5")])
    return table("orders").select(F.col("o_orderpriority").alias("cell")).unionAll(table("part").select(F.col("p_size").cast("string"))).unionAll(table("events").select("props")).unionAll(odd)


@query(rf"""SELECT cell, CASE WHEN num AND NOT regexp_matches(cell, '[.eE]') THEN 'integer' WHEN num THEN 'number' WHEN lower(cell) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS kind,
CASE WHEN num THEN try_cast(cell AS DOUBLE) END AS number, CASE WHEN lower(cell) IN ('true', 'false') THEN lower(cell) = 'true' END AS truth, count(*) AS n
FROM (SELECT cell, length(cell) < 20 AND regexp_matches(cell, '{t.JSON_NUMBER}') AS num FROM {_CELLS}) GROUP BY ALL""")
def infer_cell_type(spark, table):
    c = F.col("cell")
    return _cells(spark, table).groupBy("cell", t.cell_kind(c).alias("kind"), t.cell_number(c).alias("number"), t.cell_boolean(c).alias("truth")).agg(F.count("*").alias("n"))


#: Texts of attributes with their kinds, and such texts around a part's key (#) and name (@).
_ATTRIBUTES = dict(zip(["007", "+1", "12", "-12", "-0.5", "0.5", ".5", "0", "-", "", "True", "tRue", "1e3", "9223372036854775808", "1234567890123456789012345", "00", "0x1", "abc", "1.5.2", "12a"], ["text", "text", "integer", "integer", "number", "number", "number", "integer", "text", "null", "boolean", "text", "number", "number", "text", "text", "text", "text", "text", "text"], strict=True))
_ATTRIBUTES_OF_PARTS = {"#": "integer", "00#": "text", "+#": "text", "-#": "integer", "-0.#": "number", "0.#": "number", ".#": "number", "#.5": "number", "-": "text", "": "null", "True": "boolean", "tRue": "text", "#e3": "number", "9223372036854775808": "number", "1234567890123456789012345#": "text", "0x#": "text", "@": "text", "#.5.2": "text", "#a": "text"}


@query("SELECT p_partkey, replace(replace(form, '#', p_partkey::VARCHAR), '@', p_name) AS value, CASE WHEN form = '#e3' AND p_partkey = 0 THEN 'text' ELSE kind END AS kind FROM part, (VALUES " + ", ".join(f"('{a}', '{k}')" for a, k in _ATTRIBUTES_OF_PARTS.items()) + ") f(form, kind) UNION ALL SELECT NULL, value, kind FROM (VALUES " + ", ".join(f"('{a}', '{k}')" for a, k in _ATTRIBUTES.items()) + ") x(value, kind)")
def infer_attribute_type(spark, table):
    """Texts of attributes: fixed ones, and each part's key and name in all spellings, plain, with zeros, signs, points, exponents and letters."""
    form = F.explode(F.array(*map(F.lit, _ATTRIBUTES_OF_PARTS))).alias("form")
    key = F.col("p_partkey").cast("string")
    value = F.replace(F.replace("form", F.lit("#"), key), F.lit("@"), F.col("p_name"))
    part = table("part").select("p_partkey", "p_name", form).select("p_partkey", value.alias("value"))
    fixed = rows(spark, "value string", [(a,) for a in _ATTRIBUTES]).select(F.lit(None).cast(part.schema["p_partkey"].dataType).alias("p_partkey"), "value")
    return part.unionAll(fixed).select("p_partkey", "value", t.attribute_kind(F.col("value")).alias("kind"))


@query(r"""SELECT n_nationkey, text, CASE WHEN neg THEN -v ELSE v END AS value, format FROM (
SELECT n_nationkey, text, n_nationkey % 5 = 1 AS neg, CASE n_nationkey % 5 WHEN 3 THEN (1000 + n_nationkey) / 100.0::DOUBLE WHEN 4 THEN NULL ELSE 1000 + n_nationkey + 0.5::DOUBLE END AS v,
CASE n_nationkey % 5 WHEN 0 THEN '"$"#,##0.00' WHEN 1 THEN '#,##0.0;(#,##0.0)' WHEN 2 THEN '0.0' WHEN 3 THEN '0%' END AS format FROM (
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '$1,' || lpad(n_nationkey::VARCHAR, 3, '0') || '.50' WHEN 1 THEN ' (1,' || lpad(n_nationkey::VARCHAR, 3, '0') || '.5) '
WHEN 2 THEN (1000 + n_nationkey)::VARCHAR || '.5' WHEN 3 THEN (1000 + n_nationkey)::VARCHAR || '%' ELSE '0' || n_nationkey END AS text FROM nation))""")
def parse_document_number(spark, table):
    k, padded = F.col("n_nationkey"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    big = (k + 1000).cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("$1,"), padded, F.lit(".50"))).when(k % 5 == 1, F.concat(F.lit(" (1,"), padded, F.lit(".5) "))).when(k % 5 == 2, F.concat(big, F.lit(".5"))).when(k % 5 == 3, F.concat(big, F.lit("%"))).otherwise(F.concat(F.lit("0"), k.cast("string")))
    return table("nation").select("n_nationkey", text.alias("text")).withColumn("p", t.document_number(F.col("text"))).select("n_nationkey", "text", "p.value", "p.format")


@query(r"""SELECT o_orderkey, text, CASE WHEN k <> 3 THEN date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::INTEGER END AS serial,
CASE k WHEN 0 THEN 'yyyy-mm-dd' WHEN 1 THEN 'yyyy/' || CASE WHEN month(o_orderdate) > 9 THEN 'mm' ELSE 'm' END || '/' || CASE WHEN day(o_orderdate) > 9 THEN 'dd' ELSE 'd' END WHEN 2 THEN 'yyyy. mm. dd.' END AS format
FROM (SELECT *, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
WHEN 2 THEN strftime(o_orderdate, '%Y. %m. %d.') ELSE strftime(o_orderdate, '%Y-%m/%d') END AS text FROM orders)""")
def parse_document_date(spark, table):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/M/d")).when(k == 2, F.date_format(d, "yyyy. MM. dd.")).otherwise(F.date_format(d, "yyyy-MM/dd"))
    return table("orders").select("o_orderkey", text.alias("text")).withColumn("p", t.document_date(F.col("text"))).select("o_orderkey", "text", "p.serial", "p.format")


@query("""SELECT p_partkey, CASE WHEN p_partkey = 60 THEN NULL WHEN p_partkey < 60 THEN DATE '1899-12-31' + p_partkey::INTEGER ELSE DATE '1899-12-30' + p_partkey::INTEGER END AS day,
CASE WHEN p_partkey = 60 THEN NULL ELSE p_partkey::INTEGER END AS serial FROM part""")
def serial_dates(spark, table):
    day = table("part").select("p_partkey", t.serial_to_date(F.col("p_partkey")).alias("day"))
    return day.withColumn("serial", t.date_to_serial(F.col("day")))


@query("""SELECT p_partkey, CASE WHEN n < 26 THEN chr((65 + n)::INTEGER) WHEN n < 702 THEN chr((65 + (n - 26) // 26)::INTEGER) || chr((65 + n % 26)::INTEGER)
ELSE chr((65 + (n - 702) // 676)::INTEGER) || chr((65 + (n - 702) // 26 % 26)::INTEGER) || chr((65 + (n - 702) % 26)::INTEGER) END AS name, n::INTEGER AS number, (p_size - 1)::INTEGER AS first_row, greatest(p_size, 10)::INTEGER - 1 AS last_row
FROM (SELECT *, p_partkey * 9 % 18278 AS n FROM part)""")
def cell_references(spark, table):
    n = (F.col("p_partkey") * 9 % 18278).cast("int")
    p = table("part").select("p_partkey", t.column_name(n).alias("name"), "p_size")
    p = p.withColumn("at", t.cell_range(F.concat(F.lit("$"), "name", F.lit("$"), F.col("p_size").cast("string"), F.lit(":"), F.lower("name"), F.greatest("p_size", F.lit(10)).cast("string"))))
    return p.select("p_partkey", "name", F.col("at.column").alias("number"), F.col("at.row").alias("first_row"), F.col("at.last_row").alias("last_row"))


#: By remainder: a code, the number that it shows, and its text in SQL; x is a price, q a quantity, d a discount.
_FORMATS = [
    ("0", "x", "round(x)::BIGINT::VARCHAR"), ("0.00", "x", "format('{:.2f}', x)"), ("#,##0", "x", "format('{:,}', round(x)::BIGINT)"), ("#,##0.00", "x", "format('{:,.2f}', x)"),
    ("0%", "d", "round(d * 100)::BIGINT || '%'"), ("0.00%", "d", "format('{:.2f}', d * 100) || '%'"), ("0.0##", "d", "regexp_replace(format('{:.3f}', d), '0{1,2}$', '')"), ("00000", "q", "lpad(q::BIGINT::VARCHAR, 5, '0')"),
    ("0.0000000E+00", "x", "format('{:.7E}', x)"), ("#,##0 ;(#,##0)", "CASE WHEN n % 2 = 0 THEN x ELSE -x END", "CASE WHEN n % 2 = 0 THEN format('{:,}', round(x)::BIGINT) || ' ' ELSE '(' || format('{:,}', round(x)::BIGINT) || ')' END"),
    ('0;-0;"none"', "q - 25", "CASE WHEN q = 25 THEN 'none' ELSE (q - 25)::BIGINT::VARCHAR END"), ('[>=40]"big" 0;[<10]"small" 0;"mid" 0', "q", "CASE WHEN q >= 40 THEN 'big ' WHEN q < 10 THEN 'small ' ELSE 'mid ' END || q::BIGINT"),
    ("yyyy-mm-dd", "s", "strftime(l_shipdate, '%Y-%m-%d')"), ("dddd, d mmmm yyyy", "s", "strftime(l_shipdate, '%A, %-d %B %Y')"),
    ("h:mm AM/PM", "(k % 1440) / 1440.0D", "((k % 1440) // 60 + 11) % 12 + 1 || ':' || lpad((k % 60)::VARCHAR, 2, '0') || CASE WHEN k % 1440 < 720 THEN ' AM' ELSE ' PM' END"),
    ("[h]:mm:ss", "(k % 100000) / 86400.0D", "(k % 100000) // 3600 || ':' || lpad(((k % 100000) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 100000 % 60)::VARCHAR, 2, '0')"),
    ("000-00-0000", "k * 100003 % 1000000000", "regexp_replace(lpad((k * 100003 % 1000000000)::VARCHAR, 9, '0'), '(...)(..)(....)', '\\1-\\2-\\3')"), ("# ?/?", "q / 4", "CASE WHEN q < 4 THEN '' ELSE (q::BIGINT // 4)::VARCHAR END || [ '    ', ' 1/4', ' 1/2', ' 3/4' ][(q % 4)::BIGINT + 1]"),
    ("General", "d * 3", "regexp_replace(round(d * 3, 10)::VARCHAR, '\\.0$', '')"), ('$0.0,"k"', "x", "'$' || (round(x * 100)::BIGINT + 5000) // 10000 // 10 || '.' || (round(x * 100)::BIGINT + 5000) // 10000 % 10 || 'k'"),
]


@query("SELECT k, n, code, shown FROM (SELECT *, CASE " + " ".join(f"WHEN c = {i} THEN '{code}'" for i, (code, _, _) in enumerate(_FORMATS)) + " END AS code, CASE " + " ".join(f"WHEN c = {i} THEN {text}" for i, (_, _, text) in enumerate(_FORMATS)) + """ END AS shown
FROM (SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey * 7 + l_linenumber) % 20 AS c, l_extendedprice AS x, l_quantity AS q, l_discount AS d, l_shipdate FROM lineitem))""")
def number_formats(spark, table):
    """Every line item under one of twenty codes."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    i = table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 20).cast("int").alias("c"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), days.alias("s"))
    value = F.coalesce(*[F.when(F.col("c") == j, F.expr(v).cast("double")) for j, (_, v, _) in enumerate(_FORMATS)])
    i = i.withColumn("code", F.element_at(F.array(*[F.lit(code) for code, _, _ in _FORMATS]), F.col("c") + 1)).withColumn("v", value)
    return formats.rendered(i.select("k", "n", "code", "v"), "v", "code").drop("v")
