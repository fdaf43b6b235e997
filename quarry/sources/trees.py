"""Tree formats as JSON text: YAML (1.2 core types), TOML, XML, property lists, lenient JSON, JSON Lines.

JSON text keeps key order, long integers and floats apart from integers, which a fixed or inferred schema would lose.
"""

from __future__ import annotations

import base64
import datetime
import json
import math
import plistlib
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

from .files import decode

MAX_DEPTH, MAX_VALUES = 256, 5_000_000


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=_plain, allow_nan=True)


def _plain(v: object) -> object:
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (datetime.date, datetime.time)):
        return v.isoformat()
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    if isinstance(v, plistlib.UID):
        return {"CF$UID": v.data}
    return str(v)


def bounded(value: object) -> object:
    """The value, if it is neither nested too deeply nor too large once copies are written out."""
    count, stack = 0, [(value, 0)]
    while stack:
        v, depth = stack.pop()
        count += 1
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        if count > MAX_VALUES:
            raise ValueError("too many values")
        stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return value


#: Plain scalars of the YAML 1.2 core schema.
_NULL, _TRUE, _FALSE = {"", "~", "null", "Null", "NULL"}, {"true", "True", "TRUE"}, {"false", "False", "FALSE"}
_INTEGER, _HEX, _OCTAL, _FLOAT = (re.compile(p) for p in (r"[-+]?[0-9]+", r"0x[0-9a-fA-F]+", r"0o[0-7]+", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?"))


def core_scalar(text: str) -> object:
    if text in _NULL:
        return None
    if text in _TRUE or text in _FALSE:
        return text in _TRUE
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", text):
        return -math.inf if text[0] == "-" else math.inf
    if text in (".nan", ".NaN", ".NAN"):
        return math.nan
    if _INTEGER.fullmatch(text):
        return int(text)
    if _HEX.fullmatch(text):
        return int(text, 16)
    if _OCTAL.fullmatch(text):
        return int(text[2:], 8)
    return float(text) if _FLOAT.fullmatch(text) else text


def yaml_value(text: str) -> object:
    """A document, or a list of several; only plain scalars are typed, merge keys are resolved, repeated keys keep the last value."""
    import yaml

    count = 0

    def build(node: object, depth: int) -> object:
        nonlocal count
        count += 1
        if count > MAX_VALUES or depth > MAX_DEPTH:
            raise ValueError("too large or nested too deeply")
        if isinstance(node, yaml.ScalarNode):
            return core_scalar(node.value) if node.style is None else node.value
        if isinstance(node, yaml.SequenceNode):
            return [build(x, depth + 1) for x in node.value]
        out: dict = {}
        merged: dict = {}
        for k, v in node.value:
            if isinstance(k, yaml.ScalarNode) and k.value == "<<" and k.style is None:
                for part in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                    merged = build(part, depth + 1) | merged
                continue
            key = build(k, depth + 1)
            out[key if isinstance(key, str) else k.value if isinstance(k, yaml.ScalarNode) else dump(key)] = build(v, depth + 1)
        return merged | out if merged else out

    docs = [build(n, 0) if n is not None else None for n in yaml.compose_all(text, Loader=yaml.BaseLoader)]
    return docs[0] if len(docs) == 1 else docs


def xml_value(text: str) -> object:
    """{root: ...}: attributes as @name, text as #text, repeated elements as arrays; values stay text."""

    def name(tag: str) -> str:
        return tag.rpartition("}")[2]

    def build(e: ElementTree.Element, depth: int) -> object:
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        body = (e.text or "") + "".join(c.tail or "" for c in e)
        if not e.attrib and not len(e):
            return body
        out: dict = {f"@{name(k)}": v for k, v in e.attrib.items()}
        for c in e:
            k, v = name(c.tag), build(c, depth + 1)
            if k not in out:
                out[k] = v
            elif isinstance(out[k], _Many):
                out[k].append(v)
            else:
                out[k] = _Many([out[k], v])
        if body.strip():
            out["#text"] = body.strip()
        return out

    root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", text, flags=re.DOTALL))
    return {name(root.tag): build(root, 0)}


class _Many(list):
    """Values of a repeated element."""


_LENIENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*[}\]])', re.DOTALL)


def json_value(text: str) -> object:
    """JSON with comments and trailing commas."""
    return json.loads(_LENIENT.sub(lambda m: m[1] or " ", text))


def plist_value(data: bytes) -> object:
    return plistlib.loads(data)


def _one(parse) -> object:
    def run(data: bytes) -> Iterator[tuple]:
        yield (dump(bounded(parse(data))),)

    return run


#: Parsers of whole files to one JSON text.
yaml_json = _one(lambda d: yaml_value(decode(d)))
toml_json = _one(lambda d: tomllib.loads(decode(d)))
xml_json = _one(lambda d: xml_value(decode(d)))
plist_json = _one(plist_value)
lenient_json = _one(lambda d: json_value(decode(d)))
JSON = "json string"


def json_lines(data: bytes) -> Iterator[tuple]:
    """(line, json) of each line that is not blank; a broken line fails with its number."""
    for n, line in enumerate(decode(data).split("\n"), 1):
        if line.strip():
            try:
                yield n, dump(json.loads(line))
            except ValueError as e:
                raise ValueError(f"line {n} is not JSON: {e}") from e


JSON_LINES = "line int, json string"


def to_toml(value: dict, prefix: str = "") -> str:
    """TOML of a tree: plain keys first, then tables; nulls are left out, a list of tables is an array of tables."""
    key = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)

    def scalar(v: object) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float) and not math.isfinite(v):
            return "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(scalar(x) for x in v if x is not None) + "]"
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{key(k)} = {scalar(x)}" for k, x in v.items() if x is not None) + " }"
        return json.dumps(v, ensure_ascii=False)

    out, tables = [], []
    for k, v in value.items():
        if v is None:
            continue
        name = f"{prefix}{key(k)}"
        if isinstance(v, dict):
            tables.append(f"\n[{name}]\n{to_toml(v, name + '.')}")
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            tables += [f"\n[[{name}]]\n{to_toml(x, name + '.')}" for x in v]
        else:
            out.append(f"{key(k)} = {scalar(v)}\n")
    return "".join(out + tables)


def to_yaml(value: object, indent: int = 0) -> str:
    """Block YAML; texts that a reader would type otherwise are quoted."""
    pad = "  " * indent

    def scalar(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return ".nan" if math.isnan(v) else ".inf" if v == math.inf else "-.inf" if v == -math.inf else repr(v)
        if isinstance(v, int):
            return str(v)
        plain = re.fullmatch(r"[A-Za-z_][\w ./-]*", v) and v == v.strip() and core_scalar(v) is v and v.lower() not in ("yes", "no", "on", "off", "y", "n")
        return v if plain else json.dumps(v, ensure_ascii=False)

    if isinstance(value, dict) and value:
        return "".join(f"{pad}{scalar(k)}:" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for v in value)
    return pad + ("{}" if value == {} else "[]" if value == [] else scalar(value)) + "\n"
