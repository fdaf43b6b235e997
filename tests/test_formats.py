import pytest
from pyspark.sql import functions as F

from quarry.functions import formats as f

CASES = [
    ("0", 1234.5, "1235"), ("0", -1234.4, "-1234"), ("0", 0, "0"), ("0", -0.3, "0"), ("0.00", 2.675, "2.68"), ("0.00", 0.005, "0.01"), ("#,##0", 1234567.8, "1,234,568"), ("#,##0", 12, "12"), ("#,##0", 0, "0"), ("#,###", 0, ""),
    ("#,##0.00", -1234.5, "-1,234.50"), ("0.0##", 1.5, "1.5"), ("0.0##", 1, "1.0"), ("0.0##", 1.23456, "1.235"), ("#.##", 0.5, ".5"), ("#.##", 3, "3."), (".00", 0.25, ".25"), (".00", 12.25, "12.25"), ("0.??", 1.5, "1.5 "), ("???0", 12, "  12"),
    ("0%", 0.256, "26%"), ("0.00%", 1.5, "150.00%"), ("0,", 12345, "12"), ("0.0,,", 12_345_678, "12.3"), ("#,##0,\"k\"", 1_234_567, "1,235k"), ("00000", 42, "00042"), ("0000", 123456, "123456"), ("000-00-0000", 123456789, "123-45-6789"), ("000-00", 12345678, "123456-78"),
    ("0.00E+00", 12345, "1.23E+04"), ("0.00E+00", 0.00012345, "1.23E-04"), ("0.00E+00", 0, "0.00E+00"), ("0.00E+00", 9.999e9, "1.00E+10"), ("0.0E-0", 1500, "1.5E3"), ("##0.0E+0", 12345, "12.3E+3"), ("##0.0E+0", 999999, "1.0E+6"), ("##0.0E+0", 0.00012, "120.0E-6"),
    ("# ?/?", 1.5, "1 1/2"), ("# ?/?", 0.5, " 1/2"), ("# ?/?", 3, "3    "), ("# ??/??", 3.14159, "3 14/99"), ("# ?/?", 0.9999, "1    "), ("?/?", 1.5, "3/2"), ("# ?/8", 2.25, "2 2/8"), ("# ?/?", -2.25, "-2 1/4"),
    ("#,##0 ;(#,##0)", 5, "5 "), ("#,##0 ;(#,##0)", -1234, "(1,234)"), ("0;-0;\"none\"", 0, "none"), ("0;(0);-", -3, "(3)"), ("[Red]0.0;[Blue]-0.0", -2.5, "-2.5"), ("[>=100]\"big\" 0;[<0]\"neg\" 0;\"mid\" 0", 150, "big 150"), ("[>=100]\"big\" 0;[<0]\"neg\" 0;\"mid\" 0", -5, "neg 5"), ("[>=100]\"big\" 0;[<0]\"neg\" 0;\"mid\" 0", 7, "mid 7"),
    ("[$€-407] #,##0.00", 9.5, "€ 9.50"), ("$0", 3, "$3"), ("0\\x", 3, "3x"), ("_(0_)", 3, " 3 "), ("0*-", 3, "3"), ("\"a\"\"b\"", 3, "ab"), ("@", 3.5, "3.5"), (";;", 3, ""), ("0;;", -3, ""),
    ("yyyy-mm-dd", 45292, "2024-01-01"), ("d-mmm-yy", 45351, "29-Feb-24"), ("dddd, d mmmm yyyy", 45292, "Monday, 1 January 2024"), ("h:mm", 0.75, "18:00"), ("h:mm AM/PM", 0.75, "6:00 PM"), ("h:mm:ss AM/PM", 0, "12:00:00 AM"), ("mm:ss", 0.0007, "01:00"), ("[h]:mm:ss", 1.5, "36:00:00"), ("[mm]:ss", 0.5, "720:00"), ("mmss.0", 0.00001157, "0001.0"),
    ("yyyy-mm-dd h:mm", 45292.5, "2024-01-01 12:00"), ("m/d/yy", 59, "2/28/00"), ("yyyy-mm-dd", 61, "1900-03-01"), ("hh:mm", 0.9999, "23:59"), ("yy-mmmmm", 45292, "24-J"), ("yyyy", -5, "-5"), ("s.000", 1.5 / 86400, "1.500"),
    ("General", 0.1, "0.1"), ("General", 123456789012, "1.23457E+11"), ("General", 12345678901, "12345678901"), ("General", 1 / 3, "0.3333333333"), ("General", -1234.5678901234, "-1234.56789"), ("General", 0.00000123456, "1.23456E-06"), ("General", 1e300, "1E+300"), ("General \"m\"", 2, "2 m"), (None, 2.5, "2.5"),
    ("0.0 zz", 2.5, "2.5"), ("0;0;0;0;0", 2.5, "2.5"), ("\"open", 2.5, "2.5"), ("0.0", None, None),
]


def test_codes(spark):
    rows = [(i, c, float(v) if v is not None else None) for i, (c, v, _) in enumerate(CASES)]
    out = f.rendered(spark.createDataFrame(rows, "i int, code string, v double"), "v", "code").collect()
    got = {r["i"]: r["shown"] for r in out}
    wrong = [(c, v, want, got[i]) for i, (c, v, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


def test_built_in_codes_are_read():
    assert all(f.sections(c) for c in f.BUILT_IN.values())
    assert [n for n, c in f.BUILT_IN.items() if f.is_date(c)] == [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47]


def test_text_cells(spark):
    df = spark.createDataFrame([("x",), (None,)], "t string")
    out = df.select(f.text_of("0;0;0;\"<\"@\">\"")(F.col("t")).alias("a"), f.text_of("@")(F.col("t")).alias("b"), f.text_of("0.0")(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in out] == [("<x>", "x", "x"), (None, None, None)]


@pytest.mark.parametrize("code", ["0.00", "#,##0", "0%"])
def test_stays_in_generated_code(spark, code):
    df = spark.range(10).select(f.compiled(code)(F.col("id") / 3).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 10


def test_digits_are_made_once(spark):
    """Each mention of the digits in an expression made them anew."""
    from quarry.functions import formats

    shown = spark.range(1).select(formats.compiled("#,##0.00")(F.col("id")).alias("s"))
    assert shown._jdf.queryExecution().analyzed().toString().count("format_number") <= 8
