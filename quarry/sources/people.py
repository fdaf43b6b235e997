"""Contacts (vCard) and calendars (iCalendar): one row a card, event or to-do."""

from __future__ import annotations

import quopri
import re
from collections.abc import Iterator

from .files import decode

#: The columns of the tables.
CONTACT = ["Full name", "Given name", "Family name", "Organization", "Title", "Email", "Phone", "Address", "Birthday", "Note"]
CALENDAR = ["Type", "Title", "Start", "End", "All day", "Time zone", "Location", "Description", "Organizer", "Attendees", "RRULE", "EXDATE", "Recurrence ID", "UID"]
CONTACT_FIELDS, CALENDAR_FIELDS = (", ".join(f"`{c}` string" for c in cs) for cs in (CONTACT, CALENDAR))

_ASIAN = re.compile("[ᄀ-ᇿ぀-ヿ㄰-㆏一-鿿가-힣]")
_DURATION = re.compile(r"([+-])?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def content_lines(text: str) -> Iterator[tuple[str, dict[str, str], str]]:
    """(name, parameters, raw value) of each unfolded line."""
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, colon, value = _cut(line)
        if not colon:
            continue
        name, *params = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', head)
        pairs = [(k.upper(), v.strip('"')) if eq else ("TYPE", k) for k, eq, v in (p.partition("=") for p in params)]
        named: dict[str, str] = {}
        for k, v in pairs:
            named[k] = f"{named[k]},{v}" if k in named else v
        yield name.rpartition(".")[2].upper(), named, value


def _cut(line: str) -> tuple[str, str, str]:
    quoted = False
    for i, c in enumerate(line):
        quoted ^= c == '"'
        if c == ":" and not quoted:
            return line[:i], ":", line[i + 1 :]
    return line, "", ""


def plain(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value)


def fields(value: str) -> list[str]:
    return [plain(x) for x in re.split(r"(?<!\\)(?:\\\\)*;", value)]


def vcards(data: bytes) -> Iterator[tuple]:
    card: dict[str, list[str]] | None = None
    # Quoted-printable lines that end in "=" go on in the next line.
    text = re.sub(r"(?im)^([^\r\n]*ENCODING=QUOTED-PRINTABLE[^\r\n]*(?:=\r?\n[^\r\n]*)*)", lambda m: re.sub(r"=\r?\n", "", m[0]), decode(data))
    for name, p, value in content_lines(text):
        if name == "BEGIN" and value.strip().upper() == "VCARD":
            card = {}
        elif name == "END" and card is not None:
            yield _contact(card)
            card = None
        elif card is not None:
            if "QUOTED-PRINTABLE" in (p.get("ENCODING", "") + p.get("TYPE", "")).upper():
                value = quopri.decodestring(value.encode()).decode(p.get("CHARSET", "utf-8"), "replace")
            elif p.get("ENCODING", "").upper() in ("B", "BASE64"):
                continue
            kind = _kind(p.get("TYPE", "").lower().split(","))
            if name in ("EMAIL", "TEL"):
                value = re.sub(r"^(mailto|tel):", "", plain(value), flags=re.IGNORECASE)
                card.setdefault(name, []).append(f"{value} ({kind})" if kind else value)
            elif name == "ADR":
                card.setdefault(name, []).append(", ".join(x for x in fields(value) if x))
            else:
                card.setdefault(name, []).append(value)


def _kind(types: list[str]) -> str:
    """The kinds of numbers and addresses that are told apart."""
    for kind, names in (("mobile", ("cell", "mobile", "iphone")), ("fax", ("fax",)), ("work", ("work",)), ("home", ("home",))):
        if any(n in types for n in names):
            return kind
    return ""


def _contact(c: dict[str, list[str]]) -> tuple:
    first = lambda k: c.get(k, [""])[0]
    n = [*fields(first("N")), "", "", "", "", ""]
    family, given = n[0], " ".join(x for x in (n[1], n[2]) if x)
    org = ", ".join(x for x in fields(first("ORG")) if x)
    name = plain(first("FN")) or (family + given if _ASIAN.search(family + given) else " ".join(x for x in (given, family) if x)) or org or first("EMAIL") or first("TEL")
    day = first("BDAY")
    day = f"{day[:4]}-{day[4:6]}-{day[6:]}" if re.fullmatch(r"\d{8}", day) else day
    return name, given, family, org, plain(first("TITLE")), "\n".join(c.get("EMAIL", [])), "\n".join(c.get("TEL", [])), "\n".join(c.get("ADR", [])), day, "\n".join(map(plain, c.get("NOTE", [])))


def calendar(data: bytes) -> Iterator[tuple]:
    item: dict[str, list[tuple[dict, str]]] | None = None
    nested = 0
    for name, p, value in content_lines(decode(data)):
        kind = value.strip().upper()
        if name == "BEGIN":
            if item is not None:
                nested += 1
            elif kind in ("VEVENT", "VTODO"):
                item = {"TYPE": [({}, "Event" if kind == "VEVENT" else "To-do")]}
        elif name == "END" and item is not None:
            if nested:
                nested -= 1
            else:
                yield _entry(item)
                item = None
        elif item is not None and not nested:
            item.setdefault(name, []).append((p, value))


def _entry(c: dict) -> tuple:
    first = lambda k: c.get(k, [({}, "")])[0]
    text = lambda k: plain(first(k)[1])
    p, start = first("DTSTART")
    all_day = p.get("VALUE", "").upper() == "DATE"
    end = first("DTEND")[1] or first("DUE")[1]
    end = stamp(end) if end else ended(start, first("DURATION")[1])
    many = lambda k: "\n".join(v for _, v in c.get(k, []))
    person = lambda v: re.sub(r"^mailto:", "", v, flags=re.IGNORECASE)
    return (
        first("TYPE")[1], text("SUMMARY"), stamp(start), end, "true" if all_day else "false", p.get("TZID", "") or ("UTC" if start.endswith("Z") else ""), text("LOCATION"), text("DESCRIPTION"),
        person(first("ORGANIZER")[1]), "\n".join(person(v) for _, v in c.get("ATTENDEE", [])), many("RRULE"), "\n".join(stamp(x) for _, v in c.get("EXDATE", []) for x in v.split(",")), stamp(first("RECURRENCE-ID")[1]), text("UID"),
    )


def stamp(value: str) -> str:
    """2024-01-02 or 2024-01-02 03:04:05 of a calendar's compact form; anything else as it is."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)Z?)?", value.strip())
    return value if not m else f"{m[1]}-{m[2]}-{m[3]}" + (f" {m[4]}:{m[5]}:{m[6]}" if m[4] else "")


def ended(start: str, duration: str) -> str:
    """Start plus duration; days first, on the calendar."""
    import datetime as dt

    m, s = _DURATION.fullmatch(duration.strip()), stamp(start)
    if not m or not any(m.groups()[1:]) or not re.match(r"\d{4}-", s):
        return ""
    w, d, h, mi, sec = (int(x or 0) for x in m.groups()[1:])
    sign = -1 if m[1] == "-" else 1
    out = dt.datetime.fromisoformat(s) + sign * dt.timedelta(days=7 * w + d) + sign * dt.timedelta(hours=h, minutes=mi, seconds=sec)
    return out.isoformat(sep=" ") if len(s) > 10 or h or mi or sec else out.date().isoformat()
