"""Pages as rows: a small document tree from the standard parser, and the label/value pairs found in it.

extract_specs(pages) emits one row per pair with the extractor that found it and ordinals; which rows count,
keeping the first of a name in a group, and the least size of a group are decided relationally.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import LABEL_MAX, PAIR, VALUE_MAX, repair_one

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that a new one of the key's tag ends, up to the given container.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("td", "th", "tr"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "p": (("p",), ("div", "section", "td", "li", "body"))}
SKIPPED = frozenset("script style nav footer header aside head noscript".split())
HEADINGS = frozenset(("h2", "h3", "h4"))
DEFAULT_GROUP = "Specifications"

#: Parts of classes and ids of containers, headings, and the two halves of a row.
SPEC_HINTS = ("spec", "tech", "detail", "feature", "attr", "param", "datasheet", "characterist", "propert", "product-info", "harakteristik", "options", "product-params", "sku-props")
HEADING_HINTS = ("title", "heading", "caption", "subtitle")
LABEL_HINTS = ("label", "name", "term", "key", "ttl", "caption")
VALUE_HINTS = ("value", "val", "data", "nfo", "desc")
CONTEXT_HINTS = ("spec", "tech", "detail", "характерис", "param")
NOISE = re.compile(r"(related|also|similar|recommend|accessor|review|comment|share|buy|price|cart|menu|navigation|newsletter|social|follow)", re.I)
NAME_KEYS = ("name", "label", "title", "key", "displayName", "attributeName", "featureName")
VALUE_KEYS = ("value", "val", "displayValue", "attributeValue", "featureValue", "text")
DIRECT = ("weight", "width", "height", "depth", "color", "material")
NOT_NAMES = frozenset("id uid url slug sku ean type key code".split())
STATE_BYTES, STATE_DEPTH = 2_000_000, 30
_CODE_NAME = re.compile(r"[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z0-9]+(_[a-z0-9]+)+")
_PAIR = re.compile(PAIR)
_NUMBER = re.compile(r"-?\d+(?:[.,]\d+)?")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "place")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up, self.place = tag, attrs, [], up, 0

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        for k in self.elements():
            yield k
            yield from k.walk()

    def text(self, gap: str = "") -> str:
        if gap:
            return gap.join(p for p in (x.strip() for x in self._pieces()) if p)
        return "".join(self._pieces())

    def _pieces(self) -> Iterator[str]:
        for k in self.kids:
            if isinstance(k, Node):
                yield from k._pieces()
            else:
                yield k

    @property
    def classes(self) -> str:
        return self.attrs.get("class", "").lower()

    @property
    def hints(self) -> str:
        return f"{' '.join(self.attrs.get('class', '').split())} {self.attrs.get('id', '')}".lower()

    def hinted(self, parts: tuple[str, ...]) -> bool:
        h = self.hints
        return any(p in h for p in parts)

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def every(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, stops = ENDS.get(tag, ((), ()))
        n = self.at
        while n.up is not None and n.tag not in stops:
            if n.tag in closes:
                self.at = n.up
                if tag != "tr":
                    break
            n = n.up
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        node.place = len(self.at.kids)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up or self.root

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.up is not None:
            if n.tag == tag:
                self.at = n.up
                return
            n = n.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def tidy(s: str) -> str:
    return " ".join(repair_one(s).split())


def facets(value: str) -> bool:
    t = value.split()
    other = {x.lower().strip(".,;:()") for x in t if not _NUMBER.fullmatch(x)}
    return len(t) >= 8 and sum(1 for x in t if _NUMBER.fullmatch(x)) >= 5 and len(other) <= 2


def is_pair(label: str, value: str) -> bool:
    return 1 < len(label) < LABEL_MAX and 0 < len(value) < VALUE_MAX and label != value and not facets(value)


Pairs = list[tuple[str, str]]


def _heading(text: str, low: int, high: int) -> str | None:
    return text if low <= len(text) < high and not NOISE.match(text) else None


def nearest_heading(node: Node) -> str | None:
    """The closest heading before a node among its own and its ancestors' elder siblings, six levels up."""
    for _ in range(6):
        if node is None or node.up is None:
            return None
        for sib in reversed(node.up.kids[: node.place]):
            if not isinstance(sib, Node):
                continue
            own = sib if sib.tag in HEADINGS else None
            if own is None and sib.tag in ("div", "span") and sib.hinted(HEADING_HINTS):
                found = _heading(tidy(sib.text()), 3, 60)
                if found:
                    return found
            own = own or sib.first(*HEADINGS)
            found = own and _heading(tidy(own.text()), 1, 100)
            if found:
                return found
        node = node.up
    return None


def vendor_rows(root: Node) -> list[tuple[str, str, str]]:
    out = []
    for row in (n for n in root.walk() if "rowtable__" in n.classes):
        label, value = (next((n for n in row.walk() if part in n.classes), None) for part in ("rowtabletitle", "rowtableitemviewbox"))
        if label and value and (a := tidy(label.text())) and (b := tidy(value.text())):
            out.append((nearest_heading(row) or DEFAULT_GROUP, a, b))
    return out


def _plain(v: object) -> str | None:
    """A scalar, or a quantity with its unit text, as text."""
    if isinstance(v, dict):
        inner = v.get("value")
        return None if inner is None or not str(inner).strip() else f"{str(inner).strip()} {str(v.get('unitText') or '').strip()}".strip()
    return str(v).strip() or None if isinstance(v, (str, int, float)) else None


def _type_of(node: dict) -> str:
    t = node.get("@type", "")
    return " ".join(map(str, t)) if isinstance(t, list) else str(t)


def product_pairs(node: object) -> Iterator[tuple[str, str]]:
    """Pairs of all nodes of a JSON-LD document whose type is a product, in document order."""
    if isinstance(node, dict):
        if "Product" in _type_of(node):
            props = node.get("additionalProperty") or []
            for p in [props] if isinstance(props, dict) else props if isinstance(props, list) else []:
                if isinstance(p, dict):
                    raw = p.get("value") if p.get("value") is not None else p.get("unitText")
                    a, b = tidy(str(p.get("name") or p.get("propertyID") or "")), tidy(_plain(raw) or "")
                    if is_pair(a, b):
                        yield a, b
            yield from ((k.capitalize(), tidy(v)) for k in DIRECT if (v := _plain(node.get(k))))
        node = list(node.values())
    for item in node if isinstance(node, list) else []:
        yield from product_pairs(item)


def _state_pair(d: dict) -> tuple[str, str] | None:
    name = next((d[k].strip() for k in NAME_KEYS if isinstance(d.get(k), str) and d[k].strip()), None)
    if not name:
        return None
    flat = [v for k in VALUE_KEYS for v in ([d.get(k)] if not isinstance(d.get(k), dict) else [d[k].get(x) for x in VALUE_KEYS])]
    usable = (tidy(str(v)) for v in flat if isinstance(v, (str, int, float)) and str(v).strip())
    value = next((v for v in usable if is_pair(tidy(name), v)), None)
    bad = value is None or _CODE_NAME.fullmatch(tidy(name)) or re.fullmatch(r"\d{10,}", value) or tidy(name).lower() in NOT_NAMES
    return None if bad else (tidy(name), value)


def state_pairs(node: object, depth: int = 0) -> Iterator[tuple[str, str]]:
    """Pairs of lists of three objects or more that look like specifications, anywhere in application state."""
    if depth > STATE_DEPTH or not isinstance(node, (dict, list)):
        return
    if isinstance(node, list):
        found = [p for p in (_state_pair(x) for x in node if isinstance(x, dict)) if p]
        if len(found) >= 3:
            yield from found
    for x in node.values() if isinstance(node, dict) else node:
        yield from state_pairs(x, depth + 1)


def _scripts(root: Node) -> tuple[list[object], list[object]]:
    products, states = [], []
    for n in root.every("script"):
        kind, name, raw = n.attrs.get("type", "").lower(), n.attrs.get("id", "").lower(), n.text()
        state = kind == "application/json" or "next_data" in name or "nuxt" in name
        if kind == "application/ld+json" or state and 0 < len(raw) <= STATE_BYTES:
            try:
                (states if state else products).append(json.loads(raw))
            except ValueError:
                continue
    return products, states


def table_score(table: Node, context: str) -> int:
    """Twice the rows of two cells, more for hints around it, less for wide tables; 0 under two rows."""
    widths = [len(r.every("td", "th")) for r in table.every("tr")]
    if len(widths) < 2:
        return 0
    return 2 * widths.count(2) + 5 * table.hinted(SPEC_HINTS) + 3 * any(k in context.lower() for k in CONTEXT_HINTS) - 10 * (max(widths) > 4)


def table_rows(table: Node, group: str) -> Iterator[tuple[str, str, str]]:
    for row in table.every("tr"):
        cells = row.every("td", "th")
        t = [tidy(c.text()) for c in cells[:3]]
        if len(cells) == 1 and cells[0].tag == "th":
            group = t[0] or group
        elif len(cells) == 2 and all(t) and t[0] != t[1] and len(t[0]) < 120 and not facets(t[1]):
            yield group, t[0], t[1]
        elif len(cells) >= 3 and all(t) and len(t[0]) < 120:
            last = bool(re.search(r"\d", t[2])) or not re.search(r"\d", t[1])
            value = t[2] if last else t[1]
            if not facets(value):
                if last:
                    yield group, f"{t[0]} ({t[1]})", value
                yield group, t[0], value


def definition_pairs(dl: Node) -> Iterator[tuple[str, str]]:
    term = ""
    for k in dl.elements():
        if k.tag == "dt":
            term = tidy(k.text())
        elif k.tag == "dd" and term:
            if value := tidy(k.text()):
                yield term, value
            term = ""


def hinted_pair(row: Node) -> tuple[str, str] | None:
    """A row with exactly one outermost label element and one value element, apart from each other."""

    def outermost(parts: tuple[str, ...]) -> list[Node]:
        out: list[Node] = []
        for n in row.walk():
            if n.hinted(parts) and not any(inside(n, o) for o in out):
                out.append(n)
        return out

    def inside(n: Node | None, o: Node) -> bool:
        while n is not None and n is not o:
            n = n.up
        return n is o

    a, b = outermost(LABEL_HINTS), outermost(VALUE_HINTS)
    if len(a) != 1 or len(b) != 1 or inside(a[0], b[0]) or inside(b[0], a[0]):
        return None
    pair = tidy(a[0].text()), tidy(b[0].text())
    return pair if is_pair(*pair) else None


def _two_children(n: Node) -> tuple[str, str] | None:
    kids = n.elements()
    pair = (tidy(kids[0].text()), tidy(kids[1].text())) if len(kids) == 2 else ("", "")
    return pair if is_pair(*pair) else None


def _colon(n: Node, blocks: tuple[str, ...]) -> tuple[str, str] | None:
    m = None if n.first(*blocks) else _PAIR.match(tidy(n.text()))
    pair = (m[1].strip(), m[2].strip()) if m else ("", "")
    return pair if is_pair(*pair) else None


def list_pairs(ul: Node) -> Pairs:
    found = (_two_children(li) or hinted_pair(li) or _colon(li, ("ul", "ol", "table")) for li in ul.elements() if li.tag == "li")
    return [p for p in found if p]


def container_pairs(box: Node) -> Pairs:
    rows = [p for p in (_two_children(k) or hinted_pair(k) for k in box.elements()) if p]
    if len(rows) >= 3:
        return rows
    lines = [p for p in (_colon(n, ("ul", "ol", "table", "div", "p")) for n in box.every("li", "p", "div", "span")) if p]
    return lines if len(lines) >= 3 else rows


def page_rows(html: str) -> list[tuple[str, bool, str, str, str]]:
    """(extractor, vendor, group, name, value) in the order in which they count."""
    root = parse(html)
    products, states = _scripts(root)
    for n in list(root.walk()):
        if n.tag in SKIPPED and n.up is not None:
            n.up.kids[n.place] = ""
    vendor = [("vendor", True, *r) for r in vendor_rows(root)]
    if vendor:
        return vendor
    out, heading = [], DEFAULT_GROUP
    for n in root.walk():
        if n.tag in HEADINGS:
            heading = _heading(tidy(n.text()), 1, 100) or heading
        elif n.tag == "table" and table_score(n, heading) >= 1:
            out += [("table", False, *r) for r in table_rows(n, heading)]
        elif n.tag == "dl":
            out += [("dl", False, heading, *p) for p in definition_pairs(n)]
        elif n.tag in ("ul", "ol") or n.tag in ("div", "section") and n.hinted(SPEC_HINTS):
            pairs = list_pairs(n) if n.tag in ("ul", "ol") else container_pairs(n)
            if len(pairs) >= 3:
                group = nearest_heading(n) or heading
                out += [("list" if n.tag in ("ul", "ol") else "div", False, group, *p) for p in pairs]
    out += [("jsonld", False, DEFAULT_GROUP, *p) for x in products for p in product_pairs(x)]
    state = [("state", False, DEFAULT_GROUP, *p) for x in states for p in state_pairs(x)]
    return out + (state if len(state) >= 3 else [])


ROWS = "page_id long, seq int, extractor string, grp string, name string, value string"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, k, r[0], *r[2:]) for i, html in zip(b["page_id"], b["html"], strict=True) for k, r in enumerate(page_rows(html or ""))]
        yield pd.DataFrame(rows, columns=["page_id", "seq", "extractor", "grp", "name", "value"])


def extract_specs(pages: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, seq, extractor, grp, name, value): the first row of each name in a group, in groups of `least` names or more."""
    rows = pages.select("page_id", "html").mapInPandas(_extract, ROWS)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "grp", "name").orderBy("seq"))).where("r = 1").drop("r")
    return first.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "grp"))).where(F.col("n") >= least).drop("n")


#: Words of a link to a page of specifications, and words that rule a link out.
LINK_WORDS = ("technical specifications", "full specifications", "specifications", "specification", "tech specs", "tech spec", "techspec", "specs", "spec sheet", "datasheet", "data sheet", "технічні характеристики", "технические характеристики", "характеристики", "характеристика", "специфікації", "спецификации", "параметри", "параметры")
LINK_NEGATIVES = ("support", "download", "driver", "manual", "warranty", "review", "faq", "where to buy", "buy", "community", "news", "blog", "compare")


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
            for k, a in enumerate(parse(html or "").every("a")):
                to = urljoin(url or "", a.attrs.get("href", "")).split("#")[0]
                rows.append((i, k, to, tidy(a.text(" ")).lower(), urlparse(to).hostname == urlparse(url or "").hostname, to == (url or "").split("#")[0]))
        yield pd.DataFrame(rows, columns=["page_id", "seq", "link", "text", "same_host", "self"])


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").mapInPandas(_links, "page_id long, seq int, link string, text string, same_host boolean, self boolean")


def spec_links(pages: DataFrame, most: int = 2) -> DataFrame:
    """(page_id, link, score, rank): links of the page's own host whose text names specifications, the longest name first."""
    score = F.array_max(F.transform(F.filter(F.array(*map(F.lit, LINK_WORDS)), lambda w: F.contains(F.col("text"), w)), lambda w: F.length(w)))
    none_of = ~F.exists(F.array(*map(F.lit, LINK_NEGATIVES)), lambda w: F.contains(F.col("text"), w))
    good = links(pages).where("same_host and not self").where(F.col("link").rlike("^https?://") & none_of).withColumn("score", score).where("score is not null")
    best = good.groupBy("page_id", "link").agg(F.max("score").alias("score"), F.min("seq").alias("seq"))
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "seq")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("seq")




def _generic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, html in zip(b["page_id"], b["html"], strict=True):
            root = parse(html or "")
            pairs = [(c[0].text(" "), c[1].text(" ")) for r in root.every("tr") if len(c := r.every("td", "th")) >= 2]
            for dl in root.every("dl"):
                pairs += zip((n.text(" ") for n in dl.every("dt")), (n.text(" ") for n in dl.every("dd")), strict=False)
            rows += [(i, k, " ".join(a.split()), " ".join(v.split())) for k, (a, v) in enumerate(pairs) if a and v]
        yield pd.DataFrame(rows, columns=["page_id", "seq", "name", "value"])


def plain_rows(pages: DataFrame) -> DataFrame:
    """(page_id, seq, name, value): the first two cells of all table rows, and terms with definitions, without any gate."""
    return pages.select("page_id", "html").mapInPandas(_generic, "page_id long, seq int, name string, value string")
