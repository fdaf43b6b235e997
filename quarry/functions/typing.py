"""Typed values out of text: the typing ladders, document numbers and dates, serial days, cell references.

Each ladder is its own rule and they differ on purpose. All are Column expressions: nothing leaves the JVM. Casts are guarded by a
pattern and by ``try_cast``, so no text can fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON number.
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Currency signs that a document's number may carry.
CURRENCY = "$€£¥₩₹"
DOCUMENT_NUMBER = rf"^(-)?(\()?([{CURRENCY}])?([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.([0-9]+))?(%)?(\))?$"


def cell_kind(cell: Column) -> Column:
    """Kind of a CSV cell: ``integer``, ``number``, ``boolean`` or ``text``; blank cells stay text, and so does 007."""
    number = (F.length(cell) < 20) & cell.rlike(JSON_NUMBER)
    return F.when(number & ~cell.rlike("[.eE]"), "integer").when(number, "number").when(F.lower(cell).isin("true", "false"), "boolean").otherwise("text")


def cell_number(cell: Column) -> Column:
    """The cell as a number where its kind is one."""
    return F.when(cell_kind(cell).isin("integer", "number"), cell.try_cast("double"))


def cell_boolean(cell: Column) -> Column:
    return F.when(cell_kind(cell) == "boolean", F.lower(cell) == "true")


def attribute_kind(text: Column) -> Column:
    """Kind of a geographic attribute: ``null``, ``integer``, ``number``, ``boolean`` or ``text``.

    Identifiers such as 007 and +1 stay text; texts over 24 characters are not looked at; only three spellings each are booleans.
    """
    digits = F.regexp_replace(text, "^-", "")
    looked_at = (F.length(text) <= 24) & (digits != "") & ~digits.rlike(r"^0[^.]")
    whole = text.rlike(r"^-?[0-9]+$") & text.try_cast("bigint").isNotNull()
    real = digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & ~F.coalesce(text.try_cast("double").isin(float("inf"), float("-inf")), F.lit(True))
    truth = text.isin("true", "True", "TRUE", "false", "False", "FALSE")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "null").when(looked_at & whole, "integer").when(looked_at & real, "number").when(looked_at & truth, "boolean").otherwise("text")


def document_number(text: Column) -> Column:
    """struct(value, format) of a document table's number: groups, one currency sign, parentheses for minus, percent; else null."""
    t = F.trim(text)
    g = lambda i: F.regexp_extract(t, DOCUMENT_NUMBER, i)
    whole, fraction = F.replace(g(4), F.lit(","), F.lit("")), g(5)
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    fine = t.rlike(DOCUMENT_NUMBER) & ~((F.length(g(4)) > 1) & g(4).startswith("0")) & (F.length(digits) <= 15) & ((g(2) == "") == (g(7) == ""))
    value = F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")).try_cast("double")
    value = F.when(g(6) != "", value / 100).otherwise(value)
    value = F.when((g(1) != "") | (g(2) != ""), -value).otherwise(value)
    form = F.concat(F.when(g(4).contains(","), "#,##0").otherwise("0"), F.when(fraction != "", F.concat(F.lit("."), F.repeat(F.lit("0"), F.length(fraction)))).otherwise(""), F.when(g(6) != "", "%").otherwise(""))
    form = F.when(g(3) != "", F.concat(F.lit('"'), g(3), F.lit('"'), form)).otherwise(form)
    form = F.when(g(2) != "", F.concat(form, F.lit(";("), form, F.lit(")"))).otherwise(form)
    return F.when(fine, F.struct(value.alias("value"), form.alias("format")))


def document_date(text: Column) -> Column:
    """struct(serial, format) of a year-first date with one kind of separator; else null."""
    t = F.trim(text)
    out = F.lit(None).cast("struct<serial:int,format:string>")
    for sep, escaped in (("-", "-"), ("/", "/"), (". ", r"\. "), (".", r"\.")):
        p = rf"^([0-9]{{4}}){escaped}([0-9]{{1,2}}){escaped}([0-9]{{1,2}})(\.?)$"
        y, m, d, end = (F.regexp_extract(t, p, i) for i in range(1, 5))
        day = F.to_date(F.when(t.rlike(p), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")))
        form = F.concat(F.lit("yyyy" + sep), F.when(F.length(m) == 2, "mm").otherwise("m"), F.lit(sep), F.when(F.length(d) == 2, "dd").otherwise("d"), end)
        out = F.coalesce(out, F.when(day.isNotNull() & (y >= "0001"), F.struct(F.datediff(day, F.lit("1899-12-30").cast("date")).alias("serial"), form.alias("format"))))
    return out


def serial_to_date(serial: Column) -> Column:
    """The day of a spreadsheet serial (1900 system): day 60 is the 29 February 1900 that never was, and has no date."""
    day = F.floor(serial).cast("int")
    return F.when(day == 60, None).when(day < 60, F.date_add(F.lit("1899-12-31").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), day))


def date_to_serial(day: Column) -> Column:
    n = F.datediff(day, F.lit("1899-12-30").cast("date"))
    return F.when(n < 61, n - 1).otherwise(n)


def column_number(letters: Column) -> Column:
    """0-based number of a spreadsheet column: A is 0, AA is 26."""
    return (F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64)) - 1).cast("int")


def column_name(number: Column) -> Column:
    """Letters of a 0-based column number below 18,278."""
    letter = lambda n: F.char(65 + n)
    return F.when(number < 26, letter(number)).when(number < 702, F.concat(letter(F.floor((number - 26) / 26).cast("int")), letter(number % 26))).otherwise(F.concat(letter(F.floor((number - 702) / 676).cast("int")), letter(F.floor((number - 702) / 26).cast("int") % 26), letter((number - 702) % 26)))


def cell_range(reference: Column) -> Column:
    """struct(row, column, last_row, last_column), 0-based, of a reference such as $B$2:D10 in any order of its corners."""
    p = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?$"
    c1, r1, c2, r2 = (F.regexp_extract(reference, p, i) for i in range(1, 5))
    a, b = column_number(c1), column_number(F.when(c2 == "", c1).otherwise(c2))
    x, y = r1.try_cast("int") - 1, F.when(r2 == "", r1).otherwise(r2).try_cast("int") - 1
    return F.when(reference.rlike(p), F.struct(F.least(x, y).alias("row"), F.least(a, b).alias("column"), F.greatest(x, y).alias("last_row"), F.greatest(a, b).alias("last_column")))
