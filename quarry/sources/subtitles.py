"""Subtitles: readers of cues (start ms, end ms, text) and writers of files."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from .files import decode

Cue = tuple[int, int, str]
FIELDS = "start bigint, `end` bigint, text string"
LAST_MS = 4000

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?"
_TIMING = re.compile(rf"\s*{_TIME}\s*-->\s*{_TIME}")


def ms(h: str | None, m: str, s: str, f: str | None) -> int:
    return ((int(h or 0) * 60 + int(m)) * 60 + int(s)) * 1000 + int((f or "0").ljust(3, "0")[:3])


def clean(cues: Iterator[Cue]) -> Iterator[Cue]:
    """Starts below 0 become 0, cues without text or length go, repeats go; by start and end."""
    fine = {(max(0, s), e, t) for s, e, t in cues if t.strip() and e > max(0, s)}
    yield from sorted(fine)


def markup(text: str) -> str:
    return re.sub(r"\{\\[^}]*\}", "", text)


def srt(text: str) -> Iterator[Cue]:
    """A cue begins at each timing line; a last line of digits before it is its number."""
    at, body = None, []

    def close(more: bool) -> Iterator[Cue]:
        while body and not body[-1].strip():
            body.pop()
        if more and body and body[-1].strip().isascii() and body[-1].strip().isdigit():
            body.pop()
        if at:
            yield (*at, markup("\n".join(body)).strip())

    for line in text.splitlines():
        if m := _TIMING.match(line):
            yield from close(True)
            at, body[:] = (ms(*m.groups()[:4]), ms(*m.groups()[4:])), []
        elif at:
            body.append(line)
    yield from close(False)


def vtt(text: str) -> Iterator[Cue]:
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = block.strip("\n").split("\n")
        for k in (0, 1):
            if k < len(lines) and not lines[0].startswith("NOTE") and (m := _TIMING.match(lines[k])):
                yield ms(*m.groups()[:4]), ms(*m.groups()[4:]), html.unescape(re.sub(r"</?(c|v|ruby|rt|lang)\b[^>]*>", "", "\n".join(lines[k + 1 :]))).strip()
                break


def lrc(text: str) -> Iterator[Cue]:
    """Leading time tags repeat a line; a positive offset shows it earlier; each ends where the next begins."""
    offset, entries = 0, []
    for line in text.splitlines():
        if m := re.fullmatch(r"\s*\[offset:\s*([+-]?\d+)\s*\]\s*", line, re.IGNORECASE):
            offset = int(m[1])
        elif m := re.match(r"(?:\[\d+:\d{1,2}(?:[.:]\d{1,3})?\])+", line):
            lyric = re.sub(r"<\d+:\d{1,2}(?:\.\d{1,3})?>", "", line[m.end() :]).strip()
            entries += [(ms(None, a, b, c), lyric) for a, b, c in re.findall(r"\[(\d+):(\d{1,2})(?:[.:](\d{1,3}))?\]", m[0])]
    yield from (tuple_ for tuple_ in _until_next(sorted(entries, key=lambda e: e[0]), -offset))


def _until_next(entries: list[tuple[int, str]], shift: int = 0) -> Iterator[Cue]:
    for i, (t, s) in enumerate(entries):
        if s:
            yield t + shift, (entries[i + 1][0] if i + 1 < len(entries) else t + LAST_MS) + shift, s


def microdvd(text: str, rate: float = 23.976) -> Iterator[Cue]:
    """Frames; a first line may give the rate; a missing end is the next start."""
    rows = [(int(a), int(b or 0), t) for a, b, t in re.findall(r"^\{(\d+)\}\{(\d*)\}(.*)$", text, re.MULTILINE)]
    if rows and rows[0][0] <= 1 and re.fullmatch(r"\s*\d+(\.\d+)?\s*", rows[0][2]) and 1 < float(rows[0][2]) < 200:
        rate = float(rows.pop(0)[2])
    at = lambda f: round(f * 1000 / rate)
    for i, (a, b, t) in enumerate(rows):
        end = at(b) if b > a else at(rows[i + 1][0]) if i + 1 < len(rows) else at(a) + LAST_MS
        yield at(a), end, re.sub(r"\{[^}]*\}", "", t).replace("|", "\n").strip()


def sami(text: str) -> Iterator[Cue]:
    """The most frequent class wins, the first one of equals; classless lines belong to all; &nbsp; clears."""
    syncs = [(int(t), body) for t, body in re.findall(r"<sync\s+start\s*=\s*[\"']?(\d+)[^>]*>(.*?)(?=<sync|</body|\Z)", text, re.IGNORECASE | re.DOTALL)]
    parts = [(t, (m[1].lower() if (m := re.search(r"<p[^>]*class\s*=\s*[\"']?([\w-]+)", b, re.IGNORECASE)) else None), b) for t, b in syncs]
    count: dict[str, int] = {}
    for _, c, _ in parts:
        if c:
            count[c] = count.get(c, 0) + 1
    best = max(count, key=lambda c: count[c]) if count else None
    show = lambda b: html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", "\n", b, flags=re.IGNORECASE))).replace(" ", " ").strip()
    by_time = {t: show(b) for t, c, b in parts if c in (None, best)}
    yield from _until_next(sorted(by_time.items()))


def ass(text: str) -> Iterator[Cue]:
    """Fields in the order of the Format line; the text is the last and keeps its commas; drawings go."""
    order = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
    events = False
    for line in text.splitlines():
        if line.startswith("["):
            events = line.strip().lower() == "[events]"
        elif events and line.lower().startswith("format:"):
            order = [x.strip().lower() for x in line.split(":", 1)[1].split(",")]
        elif events and line.lower().startswith("dialogue:"):
            v = dict(zip(order, line.split(":", 1)[1].split(",", len(order) - 1), strict=False))
            a, b = (re.fullmatch(_TIME, v.get(k, "").strip()) for k in ("start", "end"))
            if a and b and not re.search(r"\\p[1-9]", v.get("text", "")):
                yield ms(*a.groups()), ms(*b.groups()), re.sub(r"\{[^}]*\}", "", v["text"]).replace("\\N", "\n").replace("\\n", "\n").replace("\\h", " ").strip()


def ttml(text: str) -> Iterator[Cue]:
    for attrs, body in re.findall(r"<(?:\w+:)?p\b([^>]*)>(.*?)</(?:\w+:)?p>", text, re.DOTALL):
        a, b = (re.search(rf'\b{k}="([^"]+)"', attrs) for k in ("begin", "end"))
        times = [ms(*m.groups()) if (m := re.fullmatch(_TIME, x[1])) else round(float(x[1][:-1]) * 1000) if re.fullmatch(r"[\d.]+s", x[1]) else None for x in (a, b) if x]
        if len(times) == 2 and None not in times:
            yield times[0], times[1], html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:\w+:)?br\s*/>", "\n", body))).strip()


READERS: dict[str, Callable[[str], Iterator[Cue]]] = {"srt": srt, "vtt": vtt, "lrc": lrc, "sub": microdvd, "smi": sami, "ass": ass, "ssa": ass, "ttml": ttml}


def parser(kind: str) -> Callable[[bytes], Iterator[Cue]]:
    read = READERS[kind]
    return lambda data: clean(read(decode(data)))


def clock(t: int, sep: str = ",") -> str:
    return f"{t // 3_600_000:02}:{t // 60_000 % 60:02}:{t // 1000 % 60:02}{sep}{t % 1000:03}"


def write(kind: str, cues: list[Cue]) -> str:
    """A file of srt, vtt, lrc, sub (at 23.976 frames a second) or txt."""
    if kind == "srt":
        return "".join(f"{i}\n{clock(a)} --> {clock(b)}\n{t}\n\n" for i, (a, b, t) in enumerate(cues, 1))
    if kind == "vtt":
        return "WEBVTT\n\n" + "".join(f"{clock(a, '.')} --> {clock(b, '.')}\n{html.escape(t, False).replace('--&gt;', '→')}\n\n" for a, b, t in cues)
    if kind == "lrc":
        tag = lambda t: f"[{t // 60_000:02}:{t // 1000 % 60:02}.{t % 1000 // 10:02}]"
        out = []
        for i, (a, b, t) in enumerate(cues):
            out.append(tag(a) + t.replace("\n", " "))
            if i + 1 == len(cues) or cues[i + 1][0] - b >= 10:
                out.append(tag(b))
        return "\n".join(out) + "\n"
    if kind == "sub":
        frame = lambda t: round(t * 23.976 / 1000)
        return "".join(f"{{{frame(a)}}}{{{max(frame(b), frame(a) + 1)}}}{t.replace(chr(10), '|')}\n" for a, b, t in cues)
    lines = [x for _, _, t in cues for x in t.split("\n") if x.strip()]
    return "\n".join(x for i, x in enumerate(lines) if i == 0 or x != lines[i - 1]) + "\n"
