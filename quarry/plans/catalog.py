"""Formats and conversion edges as tables.

Edges follow from rules (readers times writers of an engine), so the catalogue states the lists and not each edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Format ids by category, with file extensions where they differ, read-only ones marked by a trailing "-".
FORMATS = {
    "spreadsheet": "xlsx xlsm xltx xls xlt ods ots fods- csv tsv:tsv,tab et- numbers- sdc-",
    "data": "json jsonl:jsonl,ndjson yaml:yaml,yml toml xml vcf:vcf,vcard har- ics:ics,ical plist-",
    "subtitle": "srt ass ssa- vtt smi:smi,sami lrc krc- ttml:ttml,dfxp sub scc-",
    "geo": "geojson kml kmz gpx shp fit- osm-",
    "document": "txt md:md,markdown html:html,htm mhtml:mhtml,mht docx hwpx pdf",
    "email": "eml msg-",
    "archive": "zip",
    "image": "png jpg:jpg,jpeg webp svg",
}
#: The lists from which the built-in engines' edges follow.
TREES = "json jsonl yaml toml xml".split()
SUBTITLES_IN, SUBTITLES_OUT = "srt ass ssa vtt smi lrc krc ttml sub scc".split(), "srt ass vtt smi lrc ttml sub txt".split()
GEO, GEO_IN = "geojson kml kmz gpx shp".split(), "fit osm".split()
SHEETS_IN, SHEETS_OUT = "xlsx xlsm xltx xls xlt ods csv tsv".split(), "xlsx ods csv tsv".split()

EDGE = "engine string, `from` string, `to` string, cost int, direct_only boolean, image_sources_only boolean, not_for_image_sources boolean, unshaped boolean, special string, sources array<string>"


def formats(spark: SparkSession) -> DataFrame:
    """id, category, extensions, writable."""
    rows = []
    for category, names in FORMATS.items():
        for name in names.split():
            ident, _, ext = name.removesuffix("-").partition(":")
            rows.append((ident, category, ext.split(",") if ext else [ident], not name.endswith("-")))
    return spark.createDataFrame(rows, "id string, category string, extensions array<string>, writable boolean")


def edges(spark: SparkSession) -> DataFrame:
    """All edges of the built-in engines for data, subtitles, geography, sheets, text and e-mail."""
    out: list[tuple] = []

    def add(engine: str, a: str, b: str, cost: int = 10, direct: bool = False, special: str | None = None) -> None:
        out.append((engine, a, b, cost, direct, False, False, False, special, None))

    for a in TREES:
        for b in TREES:
            if a != b:
                add("data", a, b)
        add("data", a, "csv")
        add("data", "csv", a)
    for kind in ("vcf", "ics"):
        add("data", kind, "csv")
        add("data", "csv", kind)
    for b in [*TREES, "csv"]:
        add("data", "har", b)
        add("data", "plist", b)
    add("data", "plist", "txt")
    add("data", "txt", "csv", direct=True)
    for a in SUBTITLES_IN:
        for b in SUBTITLES_OUT:
            add("subtitle", a, b, direct=b == "txt")
    for a in [*GEO, *GEO_IN]:
        for b in GEO:
            if a != b or a in ("shp", "geojson"):
                add("geo", a, b)
        add("geo", a, "csv")
        if a in GEO:
            add("geo", "csv", a)
    for a in SHEETS_IN:
        for b in SHEETS_OUT:
            if a != b and not (b == "xlsx" and a in ("xlsm", "xltx")):
                add("spreadsheet", a, b)
    add("markdown", "md", "html", 4)
    add("markdown", "md", "txt", 5)
    add("markdown", "txt", "txt", 4)
    for a, b in (("eml", "html"), ("eml", "txt"), ("eml", "zip"), ("msg", "eml"), ("msg", "html"), ("msg", "txt"), ("msg", "zip"), ("mhtml", "html")):
        add("eml", a, b)
    for a in ("docx", "html", "mhtml"):
        for b in ("xlsx", "ods", "csv"):
            add("document-tables", a, b, direct=True)
    return spark.createDataFrame(out, EDGE)
