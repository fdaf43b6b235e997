"""Names and paths: natural order, rename steps, filters, safe names, extensions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column, width: int = 4) -> Column:
    """A text that sorts as people count: digit runs by value, leading zeros and case ignored.

    Each digit run becomes its length without leading zeros, in ``width`` digits, and the digits; other runs stay, lower-cased.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda r: F.regexp_replace(r, "^0+", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(r)).cast("string"), width, "0"), bare(r))).otherwise(r)), "")


def folder_key(path: Column) -> Column:
    """Sorts by folder levels, sub-folders before files, each level in natural order."""
    parts = F.split(path, r"[/\\]")
    return F.transform(parts, lambda p, i: F.struct((i == F.size(parts) - 1).alias("is_file"), natural_key(p).alias("name")))


#: The pattern and replacement of the rename steps that take no text.
FIXED_STEPS = {
    "spaces_to_underscores": (r"\s+", "_"),
    "remove_copy_number": (r"\s*\(\d+\)$", ""),
    "remove_brackets": (r"\s*(\([^)]*\)|\[[^\]]*\]|\{[^}]*\})", ""),
    "remove_leading_number": (r"^\d+[\s._-]*", ""),
    "remove_symbols": (r"[^\p{L}\p{N}\s._-]", ""),
}


def rename(name: Column, steps: list[tuple[str, str, str]]) -> Column:
    """``name`` after steps (kind, find, replace); a step without its text, or with a broken expression, changes nothing."""
    for kind, find, put in steps:
        if kind in ("replace", "remove") and find:
            name = F.regexp_replace(name, "(?i)" + _quoted(find), "" if kind == "remove" else put.replace("\\", r"\\").replace("$", r"\$"))
        elif kind == "prefix" and put:
            name = F.concat(F.lit(put), name)
        elif kind == "suffix" and put:
            name = F.concat(name, F.lit(put))
        elif kind == "regex" and find and _compiles(find):
            name = F.regexp_replace(name, find, put)
        elif kind in FIXED_STEPS:
            name = F.regexp_replace(name, *FIXED_STEPS[kind])
            name = F.trim(name) if kind == "remove_brackets" else name
        elif kind in ("lowercase", "uppercase"):
            name = F.lower(name) if kind == "lowercase" else F.upper(name)
    return name


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def file_filter(name: Column, patterns: list[str]) -> Column:
    """Whether a file name matches any pattern: ``*`` and ``?`` wildcards, or an expression between slashes; no pattern matches all."""
    usable = []
    for p in patterns:
        if len(p) > 2 and p.startswith("/") and p.endswith("/"):
            if _compiles(p[1:-1]):
                usable.append(p[1:-1])
        else:
            usable.append("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.strip()) + "$")
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in usable)) if usable else F.lit(True)


#: Characters that no file name may have, and device names.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def safe_name(name: Column, otherwise: str = "converted") -> Column:
    """A file name that any system takes."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, FORBIDDEN, "_")), r"[. ]+$", "")
    stem = F.upper(F.regexp_extract(clean, r"^([^.]*)", 1))
    clean = F.when(stem.isin(*DEVICES), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(clean == "", F.lit(otherwise)).otherwise(clean)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column, compound: tuple[str, ...] = ()) -> Column:
    """The longest known compound extension of a path (such as tar.gz), else its last; lower-cased, without the dot."""
    low = F.lower(file_name(path))
    out = F.regexp_extract(low, r"\.([^.]+)$", 1)
    for c in sorted(compound, key=len):
        out = F.when(low.endswith("." + c), F.lit(c)).otherwise(out)
    return out


def size_text(size: Column) -> Column:
    """Megabytes of 1,000,000 bytes as a whole number of bytes."""
    return (size * 1_000_000).cast("long")


def most_bytes(megabytes: Column) -> Column:
    """A maximum in megabytes of 1,000,000 bytes, cut to whole bytes."""
    return (megabytes.cast("double") * 1_000_000).cast("long")


def least_bytes(megabytes: Column) -> Column:
    """A minimum, to the nearest byte: one that is cut would let a file pass that is a byte too short."""
    scaled = megabytes.cast("double") * 1_000_000
    return F.when(scaled < 0, F.ceil(scaled - 0.5)).otherwise(F.floor(scaled + 0.5)).cast("long")


def percent_bytes(source: Column, percent: Column) -> Column:
    """A maximum as a percentage of a source's size, cut to whole bytes."""
    return (source.cast("double") * (percent / 100.0)).cast("long")


#: Files that a watch folder leaves alone, by extension and by name.
TEMPORARY = "tmp temp part partial crdownload download opdownload !ut filepart".split()
SYSTEM = ("desktop.ini", "thumbs.db")


def ignored(path: Column, root: str, known: list[str], output: str | None = None, originals: str | None = None, subfolders: bool = True, include: Column | None = None) -> Column:
    """Does a watch of the folder ``root`` leave a file alone?

    So it is with temporary, hidden and system files, backups, extensions that are not ``known``, what lies in the folders of outputs or
    originals, in sub-folders if those are not watched, and what ``include`` (a test of the name) leaves out. An output folder that is the
    watched folder itself, or above it, keeps nothing out.
    """
    name, root = file_name(path), root.rstrip("/")
    inside = lambda folder: path.startswith(folder.rstrip("/") + "/")
    out = (name == "") | name.startswith("~$") | name.startswith(".") | name.endswith("~") | F.lower(name).isin(*SYSTEM) | extension(path).isin(*TEMPORARY) | ~extension(path).isin(*known)
    for folder in filter(None, (output, originals)):
        if (folder.rstrip("/") + "/").startswith(root + "/") and folder.rstrip("/") != root:
            out = out | inside(folder)
    if not subfolders:
        out = out | (F.regexp_replace(path, r"/[^/]*$", "") != root)
    if include is not None:
        out = out | ~F.coalesce(include, F.lit(False))
    return F.coalesce(out, F.lit(True))


def page_range_problem(expression: Column, pages: Column) -> Column:
    """"invalid" or "past the end" for a list of pages such as 1-3,5,7- that can't be used, else null; empty means every page.

    Dashes, commas and digits of other scripts count as their plain forms.
    """
    digits = "".join(chr(zero + d) for zero in (0x660, 0x6F0, 0x966, 0xFF10) for d in range(10))
    text = F.trim(F.translate(F.coalesce(expression, F.lit("")), "–—−－，、،" + digits, "----,,," + "0123456789" * 4))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    side = r"(?:\s*0*[1-9][0-9]{0,9}\s*)"
    fine = F.forall(parts, lambda p: p.rlike(f"^(?:{side}|{side}-{side}?|-{side})$"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.try_cast("long"))
    fits = F.forall(numbers, lambda n: F.coalesce(n <= 2_147_483_647, F.lit(False)))
    last = F.coalesce(F.array_max(numbers), F.lit(0))
    broken = ~fine | ~fits | ((last == 0) & ~text.contains("-"))
    return F.when(text == "", None).when(broken, "invalid").when(last > pages, "past the end")
