"""Number format codes of spreadsheets as column expressions.

A code is read once on the driver and becomes one expression; ``rendered`` does that for every distinct code of a column. A code has up
to four sections (positive, negative, zero, text), each with placeholders, thousands, percents, scaling by commas, exponents, fractions,
dates, elapsed times, literals, colours (left out) and a condition of its own. Numbers are rounded half up in decimals as they are
written, as spreadsheets do, not by their binary value. A code that can't be read shows the number as General does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The built-in codes by number; 14 and 22 with the date order of ISO.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "yyyy-mm-dd", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "yyyy-mm-dd h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()

#: One token of a code: quoted or escaped text, blanks of a character's width, fill, brackets, times of day, runs of letters, placeholders.
TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(AM/PM|A/P|am/pm|a/p)|(General)|([yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|([eE][+-])|([0#?])|(.)', re.DOTALL)


class BadFormat(ValueError):
    """A code that can't be read."""


@dataclass
class Section:
    """Tokens as (kind, text); kinds: text, digit, point, comma, percent, exponent, slash, date, elapsed, half, general, at."""

    tokens: list[tuple[str, str]] = field(default_factory=list)
    condition: tuple[str, float] | None = None

    def kinds(self) -> set[str]:
        return {k for k, _ in self.tokens}


def sections(code: str) -> list[Section]:
    """The sections of a code."""
    out = [Section()]
    for m in TOKEN.finditer(code):
        quoted, escaped, wide, fill, bracket, half, general, letters, exponent, digit, other = m.groups()
        add = out[-1].tokens.append
        if other == ";":
            out.append(Section())
        elif quoted is not None or escaped is not None:
            add(("text", quoted if quoted is not None else escaped))
        elif wide is not None:
            add(("text", " "))
        elif fill is not None:
            continue
        elif bracket is not None:
            if c := re.fullmatch(r"(<=|>=|<>|<|>|=)\s*(-?\d+(?:\.\d+)?)", bracket):
                out[-1].condition = (c[1], float(c[2]))
            elif re.fullmatch(r"[hH]+|[mM]+|[sS]+", bracket):
                add(("elapsed", bracket.lower()))
            elif bracket.startswith("$"):
                add(("text", bracket[1:].split("-")[0]))
        elif half is not None:
            add(("half", half))
        elif general is not None:
            add(("general", ""))
        elif letters is not None:
            add(("date", letters.lower()))
        elif exponent is not None:
            add(("exponent", exponent[1]))
        elif digit is not None:
            add(("digit", digit))
        elif other in ".,%/@":
            add(({".": "point", ",": "comma", "%": "percent", "/": "slash", "@": "at"}[other], other))
        elif other in '"[':
            raise BadFormat(code)
        elif other.isalpha() and other.isascii():
            raise BadFormat(code)
        else:
            add(("text", other))
    if len(out) > 4:
        raise BadFormat(code)
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def general(v: Column) -> Column:
    """Up to ten significant digits without trailing zeros; very large and small numbers with an exponent."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e11)
    digits = F.format_string("%.9e", v)
    wide = F.format_string("%.5e", v)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(wide, "^(.*)e", 1), "0+$", ""), r"\.$", "")
    power = F.regexp_extract(wide, "e([+-][0-9]+)$", 1).cast("int")
    scientific = F.concat(mantissa, F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.when(F.abs(power) >= 100, F.concat(mantissa, F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(scientific)
    broken = lambda exponent: F.when((exponent >= -5) & (exponent < 10), _trimmed(v.try_cast("decimal(38,18)"), F.lit(9) - exponent)).otherwise(scientific)
    return F.when(whole, F.format_string("%.0f", v)).otherwise(_once(F.regexp_extract(digits, "e([+-][0-9]+)$", 1).cast("int"), broken))


def _fixed(d: Column, places: int) -> Column:
    """A decimal's digits without exponent."""
    return F.replace(F.format_number(d, places), F.lit(","), F.lit(""))


def _trimmed(d: Column, places: Column) -> Column:
    """A decimal with so many places at most, and no trailing zeros."""
    rounded = F.coalesce(*[F.when(places == p, F.round(d, p).try_cast("decimal(38,14)")) for p in range(15)], d.try_cast("decimal(38,14)"))
    text = F.regexp_replace(F.regexp_replace(_fixed(rounded, 14), "0+$", ""), r"\.$", "")
    return _once(text, lambda t: F.when(t == "-0", "0").otherwise(t))


def _plain(x: Column, places: int) -> Column:
    """A number that is not negative with so many places, rounded half up."""
    return _fixed(x.try_cast(f"decimal(38,{min(places, 18)})"), places)


def _whole(digits: Column, marks: str, thousands: bool) -> Column:
    """The whole part under its placeholders: zeros fill up, question marks leave blanks, a lone zero needs a zero's place."""
    shown = F.when(digits == "0", F.lit("")).otherwise(digits)
    zeros = len(marks) - marks.index("0") if "0" in marks else 0
    # lpad cuts what is longer
    filled = _once(shown, lambda d: F.when(F.length(d) < zeros, F.lpad(d, zeros, "0")).otherwise(d)) if zeros else shown
    if thousands:
        filled = F.regexp_replace(filled, r"(?<=[0-9])(?=([0-9]{3})+$)", ",")
    wide = len(marks) - marks.index("?") if "?" in marks else 0
    return _once(filled, lambda d: F.when(F.length(d) < wide, F.lpad(d, wide, " ")).otherwise(d)) if wide else filled


def _places(digits: Column, marks: str) -> Column:
    """The places behind the point: those of # go where they are zero and nothing else follows, those of ? become blanks."""
    least = max((i + 1 for i, m in enumerate(marks) if m == "0"), default=0)
    bare = F.regexp_replace(digits, f"(?<=^.{{{least}}}.{{0,{len(marks)}}})0+$|(?<=^.{{{least}}})0+$", "") if least < len(marks) else digits
    if "?" not in marks:
        return bare
    return F.when(F.length(bare) < len(marks), F.rpad(bare, len(marks), " ")).otherwise(bare)


def _number(s: Section, v: Column) -> Column:
    """A section of digits for a number that is not negative."""
    tokens = list(s.tokens)
    first, last = (f(i for i, (k, _) in enumerate(tokens) if k in ("digit", "point")) for f in (min, max))
    percents = sum(k == "percent" for k, _ in tokens)
    x = v.cast("double") if not percents else v.cast("double") * 100**percents
    exponent = next((i for i, (k, _) in enumerate(tokens) if k == "exponent"), None)
    end = exponent if exponent is not None else last + 1
    point = next((i for i, (k, _) in enumerate(tokens[:end]) if k == "point"), end)
    scaled, i = 0, point - 1 if point < end else end
    behind = end
    while behind < len(tokens) and tokens[behind][0] == "comma" and exponent is None:
        scaled, behind = scaled + 1, behind + 1
    i = point - 1
    while point < end and i >= 0 and tokens[i][0] == "comma":
        scaled, i = scaled + 1, i - 1
    before = [(j, t) for j, (k, t) in enumerate(tokens[:point]) if k == "digit"]
    thousands = any(k == "comma" and before and before[0][0] < j < before[-1][0] for j, (k, _) in enumerate(tokens[:point]))
    marks, after = "".join(t for _, t in before), "".join(t for k, t in tokens[point:end] if k == "digit")
    if scaled:
        x = x / 1000**scaled
    if exponent is not None:
        step = max(1, len(marks))
        precise = F.regexp_extract(F.format_string("%.14e", x), "e([+-][0-9]+)$", 1).cast("int")
        at = lambda p: F.when(x == 0, 0).otherwise((F.floor(p / step) * step).cast("int"))
        scaled_to = lambda p: (x / F.pow(F.lit(10.0), p)).try_cast(f"decimal(38,{min(len(after), 18)})")
        power = _once(precise, lambda p: F.when(scaled_to(at(p)) >= 10**step, at(p + 1)).otherwise(at(p)))
        both = lambda p: F.struct(p.alias("power"), F.split(_plain((x.cast("double") / F.pow(F.lit(10.0), p)).cast("double"), len(after)), r"\.").alias("text"))
        return _once(_once(power, both), lambda b: _laid(tokens, point, end, before, marks, after, thousands, b["text"], b["power"]))
    return _once(F.split(_plain(x, len(after)), r"\."), lambda t: _laid(tokens, point, end, before, marks, after, thousands, t, None))


def _laid(tokens: list, point: int, end: int, before: list, marks: str, after: str, thousands: bool, text: Column, power: Column | None) -> Column:
    """The tokens of a section with the digits of ``text`` (before and behind the point) in their places."""
    whole, places = F.get(text, F.lit(0)), F.coalesce(F.get(text, F.lit(1)), F.when(text.isNotNull(), "")) if after else F.lit("")
    mixed = any(tokens[j][0] == "text" for j in range(before[0][0], before[-1][0])) if before else False
    out: list[Column] = []
    placed = False
    shown = _places(places, after)
    behind_at = [j for j, (k, _) in enumerate(tokens[point:end], point) if k == "digit"]
    padded = F.lpad(whole, max(1, len(marks)), "0") if not mixed else F.when(F.length(whole) < len(marks), F.lpad(whole, len(marks), "0")).otherwise(whole)
    for j, (k, t) in enumerate(tokens):
        if k == "text" or k == "percent":
            out.append(F.lit(t))
        elif k == "digit" and j < point and mixed:  # literals between the digits: each place has its own
            n = [b for b, _ in before].index(j)
            from_end = len(marks) - n
            out.append(F.substr(padded, F.lit(1), F.length(padded) - (from_end - 1)) if n == 0 else F.substr(padded, F.length(padded) - (from_end - 1), F.lit(1)))
        elif k == "digit" and j < point and not placed:
            out.append(_whole(whole, marks, thousands))
            placed = True
        elif k == "point" and j == point:
            out.append(F.lit("."))
            if not before:
                out[-1:] = [F.when(whole != "0", whole).otherwise(F.lit("")), F.lit(".")]
            if after and behind_at:
                out.append(shown)
        elif k == "exponent":
            least = 0
            while j + 1 + least < len(tokens) and tokens[j + 1 + least][0] == "digit":
                least += 1
            size = F.abs(power).cast("string")
            sign = F.when(power < 0, "-").otherwise("+" if t == "+" else "")
            out += [F.lit("E"), sign, F.when(F.length(size) < least, F.lpad(size, max(1, least), "0")).otherwise(size)]
    if after and any(tokens[j][0] == "text" for j in range(point, behind_at[-1])):
        raise BadFormat("text between the places behind the point")
    return F.concat(*out) if out else F.lit("")


def _fraction(s: Section, v: Column) -> Column:
    """A whole part, if it has places of its own, and the nearest fraction whose denominator has so many digits, or is the one given."""
    tokens = s.tokens
    slash = next(i for i, (k, _) in enumerate(tokens) if k == "slash")
    digits = [i for i, (k, _) in enumerate(tokens) if k == "digit"]
    top = [i for i in digits if i < slash]
    run = [i for n, i in enumerate(top) if all(tokens[j][0] == "digit" for j in range(i, slash))]
    numerator, own = "".join(tokens[i][1] for i in run), [i for i in top if i not in run]
    rest, i = "", slash + 1
    while i < len(tokens) and (tokens[i][0] == "digit" or (tokens[i][0] == "text" and tokens[i][1].isdigit())):
        rest, i = rest + tokens[i][1], i + 1
    if not numerator or not rest:
        raise BadFormat("a fraction without places")
    whole = F.floor(v) if own else F.lit(0)
    part = v - whole
    if fixed := (int(rest) if rest.isdigit() and int(rest) else 0):
        n, d = F.floor(part * fixed + 0.5).cast("long"), F.lit(fixed).cast("long")
    else:
        tried = F.transform(F.sequence(F.lit(1), F.lit(10 ** len(rest) - 1)), lambda q: F.struct(F.abs(part - F.floor(part * q + 0.5) / q).alias("off"), q.alias("d"), F.floor(part * q + 0.5).alias("n")))
        ratio_of = F.array_min(tried)
        n, d = ratio_of["n"].cast("long"), ratio_of["d"].cast("long")
    return _once(F.struct(n.alias("n"), d.alias("d")), lambda b: _ratio(tokens, numerator, own, run, rest, i, whole, b["n"], b["d"]))


def _ratio(tokens: list, numerator: str, own: list[int], run: list[int], rest: str, i: int, whole: Column, n: Column, d: Column) -> Column:
    """The tokens of a fraction around its parts."""
    up = (n == d) if own else F.lit(False)
    whole, n = F.when(up, whole + 1).otherwise(whole), F.when(up, 0).otherwise(n)
    bottom = F.rpad(d.cast("string"), len(rest), " ")
    upper = F.lpad(n.cast("string"), F.greatest(F.lit(len(numerator)), F.length(n.cast("string"))), F.lit(" "))
    ratio = F.concat(upper, F.lit("/"), bottom)
    before = F.concat(*[F.lit(t) for k, t in tokens[: own[0]] if k == "text"], F.lit("")) if own else F.concat(*[F.lit(t) for k, t in tokens[: run[0]] if k == "text"], F.lit(""))
    tail = F.concat(*[F.lit(t) for k, t in tokens[i:] if k == "text"], F.lit(""))
    if not own:
        return F.concat(before, ratio, tail)
    gap = "".join(t for k, t in tokens[own[-1] + 1 : run[0]] if k == "text")
    marks = "".join(tokens[j][1] for j in own)
    shown = _whole(whole.cast("string"), marks, False)
    return F.concat(before, F.when((n == 0) & (whole == 0), F.lit("0")).otherwise(shown), F.lit(gap), F.when(n == 0, F.repeat(F.lit(" "), F.length(ratio))).otherwise(ratio), tail)


def _date(s: Section, v: Column) -> Column:
    """A section of dates and times of a serial number of days; times are rounded to milliseconds and then cut off, not rounded up."""
    tokens = s.tokens
    half = any(k == "half" for k, _ in tokens)
    inside = F.when((v >= 0) & (v < 2_958_466), v)
    ms = F.floor(inside * 86_400_000 + 0.5).cast("long")
    days, in_day = F.floor(ms / 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000).cast("long"))
    # The 29th of February 1900, which the count of days has, is none.
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.when(days < 60, days + 1).otherwise(days))
    hour, minute, second = F.floor(in_day / 3_600_000), F.floor(in_day / 60_000) % 60, F.floor(in_day / 1000) % 60
    two = lambda c, n: F.lpad(c.cast("string"), 2, "0") if n > 1 else c.cast("string")
    named = lambda words, at, n: F.element_at(F.array(*[F.lit(w[:n] if n else w) for w in words]), at)
    clock = lambda i, step: next((tokens[j] for j in range(i + step, len(tokens) if step > 0 else -1, step) if tokens[j][0] in ("date", "elapsed")), ("", ""))
    out, i = [], 0
    while i < len(tokens):
        k, t = tokens[i]
        if k == "date" and t[0] == "m":
            before, after = clock(i, -1), clock(i, 1)
            if before[1][:1] == "h" or after[1][:1] == "s" and before[1][:1] != "s" or before[0] == "elapsed":
                out.append(two(minute, len(t)))
            else:
                m = F.month(day)
                out.append(two(m, len(t)) if len(t) < 3 else named(MONTHS, m, {3: 3, 5: 1}.get(len(t), 0)))
        elif k == "date":
            c, n = t[0], len(t)
            out.append({
                "y": lambda: F.lpad((F.year(day) % 100).cast("string"), 2, "0") if n < 3 else F.lpad(F.year(day).cast("string"), 4, "0"),
                "d": lambda: two(F.dayofmonth(day), n) if n < 3 else named(DAYS, F.dayofweek(day), 3 if n == 3 else 0),
                "h": lambda: two((hour + 11) % 12 + 1 if half else hour, n),
                "s": lambda: two(second, n),
            }[c]())
        elif k == "elapsed":
            unit = {"h": 3_600_000, "m": 60_000, "s": 1000}[t[0]]
            total = F.floor(ms / unit).cast("string")
            out.append(F.when(F.length(total) < len(t), F.lpad(total, len(t), "0")).otherwise(total))
        elif k == "half":
            am, pm = t.split("/")
            out.append(F.when(hour < 12, am).otherwise(pm))
        elif k == "point" and i + 1 < len(tokens) and tokens[i + 1] == ("digit", "0"):
            n = 0
            while i + 1 < len(tokens) and tokens[i + 1] == ("digit", "0"):
                n, i = n + 1, i + 1
            out.append(F.concat(F.lit("."), F.rpad(F.substring(F.lpad((in_day % 1000).cast("string"), 3, "0"), 1, n), n, "0")))
        elif k in ("text", "slash", "comma", "point"):
            out.append(F.lit(t))
        else:
            raise BadFormat("digits in a date")
        i += 1
    return F.when(inside.isNotNull(), F.concat(*out)).otherwise(general(v))


def _shown(s: Section, v: Column) -> Column:
    """A section for a number whose sign is dealt with."""
    kinds = s.kinds()
    if kinds & {"date", "elapsed", "half"}:
        return _date(s, v)
    if "slash" in kinds and "digit" in kinds:
        return _fraction(s, v)
    if "general" in kinds or ("at" in kinds and "digit" not in kinds):
        return F.concat(*[general(v) if k in ("general", "at") else F.lit(t) for k, t in s.tokens])
    if kinds & {"digit", "point"} and "digit" in kinds:
        return _number(s, v)
    return F.concat(*[F.lit(t) for k, t in s.tokens if k in ("text", "percent")], F.lit(""))


def compiled(code: str | None) -> Callable[[Column], Column]:
    """The expression of a code: from a number to its text."""
    if not code or code.lower() == "general":
        return general
    parts = sections(code)
    numbers = parts[:3]
    tests = {"<": lambda v, x: v < x, ">": lambda v, x: v > x, "=": lambda v, x: v == x, "<=": lambda v, x: v <= x, ">=": lambda v, x: v >= x, "<>": lambda v, x: v != x}

    def expression(v: Column) -> Column:
        v = v.cast("double")
        dated = [bool(s.kinds() & {"date", "elapsed", "half"}) for s in numbers]

        def signed(i: int) -> Column:
            s = numbers[i]
            if dated[i]:
                return _shown(s, v)
            hidden = i == 1 or (i == 0 and s.condition is not None)
            body = _shown(s, F.abs(v))
            return body if hidden else F.concat(F.when((v < 0) & body.rlike("[1-9]"), F.lit("-")).otherwise(F.lit("")), body)

        holds = lambda i: tests[numbers[i].condition[0]](v, numbers[i].condition[1])
        n = len(numbers)
        when = [holds(0) if numbers[0].condition else F.lit(True) if n == 1 else v >= 0 if n == 2 else v > 0]
        if n > 1:
            when.append(holds(1) if numbers[1].condition else F.lit(True) if n == 2 and numbers[0].condition else v < 0)
        if n > 2:
            when.append(F.lit(True))
        out = general(v)
        for i in reversed(range(n)):
            out = F.when(when[i], signed(i)).otherwise(out)
        return F.when(v.isNotNull(), F.coalesce(out, general(v)))

    return expression


def text_of(code: str | None) -> Callable[[Column], Column]:
    """The expression of a code for text cells: its fourth section, else the text."""
    try:
        parts = sections(code) if code else []
    except BadFormat:
        parts = []
    own = parts[3] if len(parts) == 4 else parts[0] if len(parts) == 1 and "at" in parts[0].kinds() else None
    return lambda t: t if own is None else F.when(t.isNotNull(), F.concat(*[t if k == "at" else F.lit(x) for k, x in own.tokens], F.lit("")))


def is_date(code: str | None) -> bool:
    """Does a code show a date or a time of day, and no elapsed time?"""
    try:
        kinds = sections(code)[0].kinds() if code else set()
    except BadFormat:
        return False
    return bool(kinds & {"date", "half"}) and "elapsed" not in kinds


def rendered(df: DataFrame, value: str, code: str, name: str = "shown") -> DataFrame:
    """``df`` with the text of each number under its own code. Every code that occurs is read once and is a branch of the expression.

    Nulls have no text; a null or unreadable code counts as General.
    """
    out = general(F.col(value).cast("double"))
    for c in sorted(r[0] for r in df.select(code).where(F.col(code).isNotNull()).distinct().collect()):
        try:
            out = F.when(F.col(code) == c, compiled(c)(F.col(value))).otherwise(out)
        except BadFormat:
            continue
    return df.withColumn(name, F.when(F.col(value).isNotNull(), out))
