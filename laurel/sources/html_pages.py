"""Rows from HTML pages: competition index, competition detail, registrations, live rounds.

Pages are spread over the cluster as rows; each task reads its own pages batch by batch, and everything
after cell extraction is done with columns. Pages of regular markup are cut at their tags; those with
anything else go through the standard library parser, and tables are built from either in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.keys import valid_person_id
from laurel.functions.times import compact_date_range

_ROUNDS = (
    "array<struct<i:string,name:string,rs:array<struct<i:string,f:string,co:bigint,tl:bigint,"
    "s:bigint,name:string>>>>"
)
_CELL = "struct<text:string,href:string,link_text:string>"
_TABLES = f"array<struct<text:string,head:array<string>,head_classes:array<string>,rows:array<array<{_CELL}>>>>"

# What a page's tables are built from, in the order of the page: pairs of one of these and its value.
_DATA, _TABLE, _PART, _ROW, _HEAD, _CELL_OF, _LINK, _TABLE_END, _HEAD_END, _CELL_END, _LINK_END = range(11)
_ENDS = {"table": _TABLE_END, "th": _HEAD_END, "td": _CELL_END, "a": _LINK_END}

# Tags that every version of the parser reads alike, without "<" and ">": complete attributes, comments without "--".
_WORD = r"[a-zA-Z][-a-zA-Z0-9_:.]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[-a-zA-Z0-9_#:.%]++)"""
_ATTRIBUTE = re.compile(rf"({_WORD})(?:=({_VALUE}))?")
_TAG = re.compile(rf"(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++{_WORD}(?:={_VALUE})?)*+)[ \t\n\r\f]*+(/?)")
_ASIDE = re.compile(r"!--(?!-)(?:[^-]|-(?!-))*+--|!doctype.*+", re.I | re.S)
# Elements whose text is read as it is, and those that are read in different ways.
_RAW = frozenset(("script", "style", "title", "textarea"))
_ODD = frozenset(("xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))
# Pages of one batch that goes back; bounds its memory.
_PAGES = 1000


def _text(data: str) -> tuple | None:
    data = data.strip()
    return (_DATA, data) if data else None


def _start(tag: str, attrs: list) -> tuple | None:
    if tag == "a":
        return _LINK, dict(attrs).get("href")
    if tag == "th":
        return _HEAD, (dict(attrs).get("class") or "").split()
    if tag in ("thead", "tbody"):
        return _PART, tag
    code = {"table": _TABLE, "tr": _ROW, "td": _CELL_OF}.get(tag)
    return None if code is None else (code, None)


def _end(tag: str) -> tuple | None:
    return (_ENDS[tag], None) if tag in _ENDS else None


class _Parser(HTMLParser):
    """The standard library's parser; ``steps`` is what it found."""

    def __init__(self) -> None:
        super().__init__()
        self.steps: list = []

    def _add(self, step: tuple | None) -> None:
        if step:
            self.steps.append(step)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(_start(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self._add(_end(tag))

    def handle_data(self, data: str) -> None:
        self._add(_text(data))


def _parsed(html: str) -> list:
    parser = _Parser()
    parser.feed(html)
    parser.close()
    return parser.steps


@lru_cache(maxsize=1024)
def _regular_tag(tag: str) -> tuple[str, tuple] | None:
    """A tag's name (of raw text only, else empty) and what it stands for; none if it is not regular."""
    found = _TAG.fullmatch(tag)
    if not found:
        return ("", ()) if _ASIDE.fullmatch(tag) else None
    ended, name, attributes, closed = found.groups()
    name = name.lower()
    if name in _ODD or ended and (attributes or closed) or name in _RAW and (ended or closed):
        return None
    if ended:
        steps = [_end(name)]
    elif "&" in attributes:
        steps = _parsed(f"<{tag}>")
    else:
        given = _ATTRIBUTE.findall(attributes)
        attrs = [(n.lower(), (v[1:-1] if v[0] in "'\"" else v) if v else None) for n, v in given]
        steps = [_start(name, attrs), _end(name) if closed else None]
    return name if name in _RAW else "", tuple(step for step in steps if step)


def _regular(html: str) -> list | None:
    """What ``_parsed`` finds, for pages of regular markup, cut at its tags; none for others."""
    steps, raw = [], ""
    # With a document type before it, the text that begins a page is one piece like the others.
    for piece in f"!doctype>{html}".split("<"):
        tag, closed, data = piece.partition(">")
        if not closed:
            return None
        if raw:
            # Nothing but its end may follow an element of raw text.
            if tag.lower() != f"/{raw}":
                return None
            raw = ""
        else:
            found = _regular_tag(tag)
            if found is None:
                return None
            raw, made = found
            steps += made
        if data:
            if "&" in data and raw not in ("script", "style"):
                data = unescape(data)
            data = data.strip()
            if data:
                steps.append((_DATA, data))
    return None if raw else steps


def _page_tables(html: str | None) -> list[dict]:
    """Tables of a page: their text, header cells, body rows and the first link of each cell."""
    steps = _regular(html or "")
    if steps is None:
        steps = _parsed(html or "")
    tables, opened, table = [], [], None
    for step, value in steps:
        if step == _TABLE:
            table = {"text": [], "head": [], "head_classes": [], "rows": [], "part": "", "cell": None, "in_link": False}
            tables.append(table)
            opened.append(table)
        elif table is None:
            continue
        elif step == _DATA:
            for each in opened:
                each["text"].append(value)
            cell = table["cell"]
            if cell is not None:
                cell["text"].append(value)
                if table["in_link"] and cell["link"] is not None:
                    cell["link"].append(value)
        elif step == _CELL_OF:
            if table["rows"]:
                table["cell"] = {"text": [], "href": None, "link": None}
                table["rows"][-1].append(table["cell"])
        elif step == _CELL_END:
            table["cell"] = None
        elif step == _LINK:
            cell = table["cell"]
            if cell is not None and cell["href"] is None and value:
                cell["href"], cell["link"], table["in_link"] = value, [], True
        elif step == _LINK_END:
            table["in_link"] = False
        elif step == _ROW:
            if table["part"] == "tbody":
                table["rows"].append([])
        elif step == _PART:
            table["part"] = value
        elif step == _HEAD:
            table["cell"] = {"text": [], "href": None, "link": None}
            table["head_classes"].extend(value)
        elif step == _HEAD_END:
            if table["cell"] is not None:
                if table["part"] == "thead":
                    table["head"].append(" ".join(table["cell"]["text"]))
                table["cell"] = None
        elif step == _TABLE_END:
            opened.pop()
            table = opened[-1] if opened else None
    return tables


class _Lists:
    """Lists of lists as Arrow takes them: where each begins, and all items."""

    def __init__(self) -> None:
        self.offsets, self.items = [0], []

    def add(self, items: list) -> None:
        self.items.extend(items)
        self.offsets.append(len(self.items))

    def array(self, items: pa.Array, missing: list | None = None) -> pa.Array:
        mask = None if missing is None else pa.array(missing, pa.bool_())
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), items, mask=mask)


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def _tables_array(pages: list[list[dict] | None]) -> pa.Array:
    """The tables of pages as one array of ``_TABLES``; null for a page that cannot be read."""
    tables, heads, classes, rows, cells = (_Lists() for _ in range(5))
    for page in pages:
        tables.add(page or [])
    for table in tables.items:
        heads.add(table["head"])
        classes.add(table["head_classes"])
        rows.add(table["rows"])
    for row in rows.items:
        cells.add(row)
    cell = pa.StructArray.from_arrays(
        [
            _strings([" ".join(c["text"]) for c in cells.items]),
            _strings([c["href"] for c in cells.items]),
            _strings([None if c["link"] is None else " ".join(c["link"]) for c in cells.items]),
        ],
        ["text", "href", "link_text"],
    )
    table = pa.StructArray.from_arrays(
        [
            _strings([" ".join(t["text"]) for t in tables.items]),
            heads.array(_strings(heads.items)),
            classes.array(_strings(classes.items)),
            rows.array(cells.array(cell)),
        ],
        ["text", "head", "head_classes", "rows"],
    )
    return tables.array(table, [page is None for page in pages])


def page_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``tables`` in place of their HTML; a page that cannot be read has a ``page_error``."""
    keep = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"tables {_TABLES}", "page_error string"]
    )

    def read(page: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            return _page_tables(page), None
        except Exception as error:  # noqa: BLE001 - whatever the parser trips over, only this page is lost
            return None, f"page cannot be read: {type(error).__name__}"

    names = [f.name for f in keep]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _PAGES):
                batch = whole.slice(start, _PAGES)
                found = [read(page) for page in batch.column(html).to_pylist()]
                made = [_tables_array([f[0] for f in found]), _strings([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "tables", "page_error"])

    return pages.mapInArrow(parse, schema)


def _first_table(pages: DataFrame, wanted) -> DataFrame:
    """Rows of the first fitting table; pages without one keep an error."""
    keep = [c for c in pages.columns if c not in ("tables", "page_error")]
    found = pages.withColumn("_t", F.get(F.filter("tables", wanted), F.lit(0)))
    return found.select(
        *keep,
        F.col("_t.head").alias("_head"),
        F.coalesce("page_error", F.when(F.col("_t").isNull(), "table was not found")).alias("error"),
        F.posexplode_outer("_t.rows").alias("position", "_cells"),
    )


def _cell(index) -> Column:
    return F.get("_cells", index if isinstance(index, Column) else F.lit(index))


def competition_index(pages: DataFrame) -> DataFrame:
    """Competitions listed on index pages (``page_tables`` first)."""
    rows = _first_table(
        pages, lambda t: t["text"].contains("Competition Name") & t["text"].contains("Date")
    )
    keep = [c for c in rows.columns if c not in ("_head", "_cells", "error", "position")]
    usable = (F.size("_cells") >= 5) & _cell(1)["href"].isNotNull()
    dates = compact_date_range(_cell(0)["text"])
    slug = F.regexp_extract(F.regexp_extract(_cell(1)["href"], r"^([^?#]*?)/*(?:[?#].*)?$", 1), r"/(?:competition|live)/(.*)$", 1)
    province = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in fixed.PROVINCE_COUNTRIES.items() for x in pair]), _cell(2)["text"]
    )
    return rows.where(F.col("error").isNotNull() | F.coalesce(usable, F.lit(False))).select(
        *keep,
        F.lit(fixed.SECOND_SOURCE).alias("source"),
        slug.alias("source_id"),
        _cell(1)["link_text"].alias("name"),
        dates["start"].alias("start_date"),
        dates["end"].alias("end_date"),
        F.coalesce(province, F.lit(fixed.PROVINCE_DEFAULT)).alias("country_code"),
        _cell(3)["text"].alias("city"),
        "error",
    )


def competition_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """Official id linked from a competition's own page; null when there is none."""
    link = F.regexp_extract(html, r'href="[^"]*worldcubeassociation\.org/competitions/([^"/?#]+)', 1)
    return pages.withColumn("official_id", F.nullif(link, F.lit(""))).drop(html)


def registrations(pages: DataFrame) -> DataFrame:
    """Returning competitors of registration pages (``page_tables`` first).

    The region is resolved to a country by ``export.country_codes``.
    """
    rows = _first_table(
        pages,
        lambda t: F.array_contains(t["head_classes"], "header-username")
        & F.array_contains(t["head_classes"], "header-region"),
    )
    keep = [c for c in rows.columns if c not in ("_head", "_cells", "error", "position")]
    name_at = F.array_position("_head", F.lit("Name")).cast("int") - 1
    region_at = F.array_position("_head", F.lit("Region")).cast("int") - 1
    changed = (name_at < 0) | (region_at < 0)
    profile = _cell(F.greatest(name_at, F.lit(0)))
    person = F.regexp_extract(profile["href"], r"/results/person/([^/?#]+)", 1)
    error = F.coalesce("error", F.when(changed, "table columns changed"))
    usable = (F.size("_cells") > F.greatest(name_at, region_at)) & valid_person_id(person)
    return rows.where(error.isNotNull() | F.coalesce(usable, F.lit(False))).select(
        *keep,
        F.lit(fixed.SECOND_SOURCE).alias("source"),
        F.upper(F.trim(person)).alias("person_id"),
        profile["link_text"].alias("name"),
        _cell(F.greatest(region_at, F.lit(0)))["text"].alias("region"),
        "position",
        error.alias("error"),
    )


_CONTAINER = r'(?s)<[a-zA-Z]+\b[^>]*\bid="live-container"[^>]*>'


def live_rounds(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rounds in the live container's JSON attribute; a round's number is its 1-based place."""

    def attribute(name: str) -> Column:
        quoted = F.regexp_extract("_tag", rf"\b{name}=(\"[^\"]*\"|'[^']*')", 1)
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def unescaped(text: Column) -> Column:
        for code, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            text = F.replace(text, F.lit(code), F.lit(char))
        return text

    keep = [c for c in pages.columns if c != html]
    # Each attribute is extracted once and then referred to by name.
    rows = (
        pages.select(*keep, F.regexp_extract(html, _CONTAINER, 0).alias("_tag"))
        .withColumns(
            {
                "_type": attribute("data-type"),
                "live_id": attribute("data-c").try_cast("long"),
                "_text": unescaped(attribute("data-events")),
            }
        )
        .withColumn("_events", F.from_json("_text", _ROUNDS))
    )
    error = (
        F.when(F.col("_tag") == "", "live container was not found")
        .when(F.col("_type") != "WCA", "not an official competition")
        .when(F.col("live_id").isNull() | F.col("_events").isNull(), "invalid live metadata")
        .when(F.size("_events") == 0, "live page has no rounds")
    )
    events = rows.select(*keep, "live_id", error.alias("error"), F.explode_outer("_events").alias("_e"))
    found = events.select(*keep, "live_id", "error", "_e", F.posexplode_outer("_e.rs").alias("_pos", "_r"))
    r = F.col("_r")
    return found.where(F.col("error").isNotNull() | r.isNotNull()).select(
        *keep,
        "live_id",
        F.col("_e.i").alias("event_id"),
        F.coalesce(F.nullif("_e.name", F.lit("")), "_e.i").alias("event_name"),
        r["i"].alias("round_id"),
        (F.col("_pos") + 1).alias("round_number"),
        F.coalesce(r["name"], F.lit("")).alias("round_name"),
        F.coalesce(r["f"], F.lit("")).alias("format"),
        F.coalesce(r["co"], F.lit(0)).alias("cutoff"),
        F.coalesce(r["tl"], F.lit(0)).alias("time_limit"),
        F.coalesce(r["s"], F.lit(0)).alias("source_status"),
        "error",
    )
