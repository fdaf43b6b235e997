"""Text: HTML to text, scripts and languages, subtitle markup and times, calendar and contact fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that ``html_to_text`` decodes, the ampersand last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "sect": "§", "deg": "°", "times": "×",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "amp": "&",
}


def decode_entities(text: Column) -> Column:
    """Named entities; replaced one after the other, the ampersand last, so that &amp;lt; stays &lt;."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Readable text: scripts, styles and the head go, breaks and block ends become lines, tags go, blanks are squeezed."""
    t = html
    for block in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{block}[^>]*>.*?</{block}>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(p|div|tr|li|h[1-6]|table|blockquote)>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]+>", ""))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit(" "), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def count_of(text: Column, ranges: str) -> Column:
    """Number of characters of the given ranges."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{ranges}]", ""))


def language(hangul: Column, kana: Column, han: Column) -> Column:
    """A language from counts of scripts."""
    return F.when((hangul > 0) & (hangul >= kana) & (hangul >= F.floor(han / 4)), "ko-KR").when(kana > 0, "ja-JP").when(han > 0, "zh-CN").otherwise("en-US")


#: Blocks whose letters change shape or combine, so that a plain renderer can't set them.
COMPLEX_SCRIPTS = r"\x{0590}-\x{08FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0EFF}\x{0F00}-\x{109F}\x{1780}-\x{17FF}\x{1A20}-\x{1AAF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}"


def needs_shaping(text: Column) -> Column:
    return text.rlike(f"[{COMPLEX_SCRIPTS}]")


def plain_cue(text: Column) -> Column:
    """Subtitle text without markup: override codes and tags go, entities are decoded."""
    return F.trim(decode_entities(F.regexp_replace(F.regexp_replace(text, r"\{\\[^}]*\}", ""), r"(?i)</?(b|i|u|s|font|c|v|ruby|rt|lang)\b[^>]*>", "")))


def time_ms(text: Column) -> Column:
    """Milliseconds of [hh:]mm:ss[.,]fff, with one to three decimals."""
    p = r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})(?:[.,]([0-9]{1,3}))?$"
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    fraction = F.rpad(F.regexp_extract(text, p, 4), 3, "0").try_cast("bigint")
    return F.when(text.rlike(p), (g(1) * 3600 + g(2) * 60 + g(3)) * 1000 + F.coalesce(fraction, F.lit(0)))


def time_text(ms: Column, separator: str = ",") -> Column:
    """hh:mm:ss,fff; hours may have more digits."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.concat(F.when(h < 10, two(h)).otherwise(h.cast("string")), F.lit(":"), two(m), F.lit(":"), two(s), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def frame_ms(frame: Column, rate: float = 23.976) -> Column:
    return F.round(frame * 1000 / rate).cast("bigint")


def color(text: Column) -> Column:
    """rrggbb of #rgb, #rrggbb, #rrggbbaa, rgb(r, g, b) or one of the basic names; else null."""
    t = F.lower(F.trim(text))
    rgb = r"^rgb\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*\)$"
    part = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(t, rgb, i).try_cast("int"))), 2, "0")
    small = F.array(*[F.regexp_extract(t, rgb, i).try_cast("int") for i in (1, 2, 3)])
    out = F.when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(t, 2, 3), "(.)", "$1$1")).when(t.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.substring(t, 2, 6))
    out = out.when(t.rlike(rgb) & F.forall(small, lambda x: x <= 255), F.concat(part(1), part(2), part(3)))
    for name, value in BASIC_COLORS.items():
        out = out.when(t == name, value)
    return out


#: The basic colour names.
BASIC_COLORS = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "lime": "00ff00", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff",
    "aqua": "00ffff", "magenta": "ff00ff", "fuchsia": "ff00ff", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "purple": "800080", "teal": "008080", "navy": "000080",
}


def duration(text: Column) -> Column:
    """struct(days, seconds) of an ISO duration: the days add to the calendar, the seconds to the clock; null if it is none."""
    p = r"^([+-])?P(?:([0-9]+)W)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    sign = F.when(F.regexp_extract(text, p, 1) == "-", -1).otherwise(1)
    return F.when(text.rlike(p) & text.rlike("[0-9]"), F.struct((sign * (g(2) * 7 + g(3))).alias("days"), (sign * (g(4) * 3600 + g(5) * 60 + g(6))).alias("seconds")))


def utc_offset(text: Column) -> Column:
    """Seconds of +HHMM or -HHMMSS."""
    p = r"^([+-])([0-9]{2})([0-9]{2})([0-9]{2})?$"
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(text.rlike(p), F.when(F.regexp_extract(text, p, 1) == "-", -1).otherwise(1) * (g(2) * 3600 + g(3) * 60 + g(4)))


def calendar_time(text: Column) -> Column:
    """Timestamp (without zone) of YYYYMMDD or YYYYMMDDTHHMMSS[Z]; null if it is none."""
    p = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:T([0-9]{2})([0-9]{2})([0-9]{2})Z?)?$"
    g = lambda i: F.regexp_extract(text, p, i)
    clock = F.when(g(4) == "", F.lit("00:00:00")).otherwise(F.concat_ws(":", g(4), g(5), g(6)))
    return F.when(text.rlike(p), F.concat(F.concat_ws("-", g(1), g(2), g(3)), F.lit(" "), clock).try_cast("timestamp_ntz"))


def unfold(text: Column) -> Column:
    """Content lines with continuations joined."""
    return F.regexp_replace(text, r"\r?\n[ \t]", "")


def fold(line: Column) -> Column:
    """A content line cut into lines of at most 75 bytes of UTF-8, never inside a character; continuations begin with a blank, which counts."""
    seen = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")  # a character for every byte
    first = F.regexp_extract(seen, r"(?s)^.{1,75}(?![\x80-\xBF])", 0)
    rest = F.regexp_replace(F.substring(seen, F.length(first) + 1, F.length(seen)), r"(?s).{1,74}(?![\x80-\xBF])", "\r\n $0")
    return F.decode(F.encode(F.concat(first, rest), "ISO-8859-1"), "UTF-8")


def unescape(text: Column) -> Column:
    r"""The text of a content line's value: \n, \, \; and \\ ."""
    t = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    t = F.regexp_replace(F.regexp_replace(t, r"\\[nN]", "\n"), r"\\([,;])", "$1")
    return F.replace(t, F.lit("\u0001"), F.lit("\\"))


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(t, "([,;])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def split_fields(text: Column) -> Column:
    """The fields between semicolons that no backslash escapes."""
    held = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0001")), F.lit("\\;"), F.lit("\u0002"))
    return F.transform(F.split(held, ";"), lambda x: F.replace(F.replace(x, F.lit("\u0002"), F.lit("\\;")), F.lit("\u0001"), F.lit("\\\\")))


def birthday(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def full_name(family: Column, given: Column, *otherwise: Column) -> Column:
    """Family and given name together in East Asian scripts, given first elsewhere; else the first that is not blank."""
    f, g = F.coalesce(family, F.lit("")), F.coalesce(given, F.lit(""))
    asian = F.concat(f, g).rlike(r"[\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]")
    name = F.when(asian, F.concat(f, g)).otherwise(F.trim(F.concat_ws(" ", g, f)))
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in (name, *otherwise)], F.lit(""))


def header_key(header: Column) -> Column:
    """Letters and digits of a header, lower-cased."""
    return F.lower(F.regexp_replace(header, r"[^\p{L}\p{N}]", ""))
