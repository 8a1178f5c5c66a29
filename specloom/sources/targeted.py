"""Rows of a page that may answer one attribute: by the patterns of known sites, by tables and lists, by linked data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame

from specloom.sources.html import Node, parse

#: Sites by the end of their host, with the selectors of a row and, inside it, of its label and value.
ROW_PATTERNS = (
    ("asus.com", "[class*=rowTable__]", "[class*=rowTableTitle]", "[class*=rowTableItemViewBox]"),
    ("gsmarena.com", "table.specs-list tr", "td.ttl", "td.nfo"),
    ("notebookcheck.net", "table.datasheet tr", "th", "td"),
    ("anandtech.com", "table.specification tr", "td:first-child", "td:last-child"),
    ("rtings.com", "table.test-results tr", "td:first-child", "td:last-child"),
    ("techpowerup.com", ".gpuz-specs table tr", "td:first-child", "td:last-child"),
)
#: Sites whose labels and values are paired in order.
FLAT_PATTERNS = (("techpowerup.com", "section.techpowerup-specs dl dt", "section.techpowerup-specs dl dd"),)

#: The order in which kinds of rows count: the first that has one for an attribute is taken.
ROW, FLAT, GENERIC = 0, 1, 2
_STEP = re.compile(r"(?P<tag>[a-z0-9]+)?(?:\.(?P<name>[\w-]+))?(?:\[class\*=(?P<part>\w+)\])?(?::(?P<end>first|last)-child)?")


def _fits(n: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if m["tag"] and n.tag != m["tag"] or m["name"] and m["name"] not in n.attrs.get("class", "").split():
        return False
    if m["part"] and m["part"] not in n.attrs.get("class", ""):
        return False
    return not m["end"] or n.up.elements()[0 if m["end"] == "first" else -1] is n


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of root that fit the last step of a selector and lie within fitting ones for the others, in document order."""
    *outer, last = selector.split()
    out = []
    for n in root.walk():
        if not _fits(n, last):
            continue
        up, left = n.up, len(outer)
        while left and up is not None and up.up is not None:
            left -= _fits(up, outer[left - 1])
            up = up.up
        if not left:
            out.append(n)
    return out


def _pair(label: Node, value: Node | None) -> tuple[str, str] | None:
    return (label.text(" "), value.text(" ")) if value is not None else None


def site_rows(root: Node, host: str) -> Iterator[tuple[int, str, str]]:
    """(kind, label, value) of the site's own patterns, then of all table rows and definition lists."""
    for end, rows, label, value in ROW_PATTERNS:
        if host.endswith(end):
            for row in select(root, rows):
                found = select(row, label)[:1]
                if found and (p := _pair(found[0], next(iter(select(row, value)), None))):
                    yield ROW, *p
    for end, labels, values in FLAT_PATTERNS:
        if host.endswith(end):
            yield from ((FLAT, *_pair(a, b)) for a, b in zip(select(root, labels), select(root, values), strict=False))
    for table in root.every("table"):
        for row in table.every("tr"):
            cells = row.every("td", "th")
            if len(cells) >= 2:
                yield GENERIC, *_pair(cells[0], cells[1])
    for dl in root.every("dl"):
        yield from ((GENERIC, *_pair(a, b)) for a, b in zip(dl.every("dt"), dl.every("dd"), strict=False))


def _extract_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(i, k, *r) for i, url, html in zip(b["page_id"], b["url"], b["html"], strict=True) for k, r in enumerate(site_rows(parse(html or ""), urlparse(url or "").hostname or ""))]
        yield pd.DataFrame(out, columns=["page_id", "seq", "kind", "label", "value"])


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, label, value) of (page_id, url, html); see site_rows. Null pages have no rows."""
    return pages.select("page_id", "url", "html").mapInPandas(_extract_rows, "page_id long, seq int, kind int, label string, value string")


def linked_nodes(node: object) -> Iterator[dict]:
    """Products and technical articles, outer ones first; what has a graph is that graph and nothing else."""
    if isinstance(node, dict):
        if "@graph" in node:
            yield from linked_nodes(node["@graph"])
            return
        kind = node.get("@type", "")
        if any(k in (" ".join(map(str, kind)) if isinstance(kind, list) else str(kind)) for k in ("Product", "TechArticle")):
            yield node
    for x in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from linked_nodes(x)


def _properties(node: dict) -> Iterator[tuple[str, str]]:
    given = node.get("additionalProperty") or []
    for p in given if isinstance(given, list) else []:
        name, value = (p.get("name") or p.get("propertyID"), p.get("value") or p.get("unitText")) if isinstance(p, dict) else (None, None)
        if name and value:
            yield str(name), str(value)


def _extract_linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, html in zip(b["page_id"], b["html"], strict=True):
            docs = []
            for n in parse(html or "").every("script"):
                if n.attrs.get("type") == "application/ld+json":
                    try:
                        docs.append(json.loads(n.text()))
                    except ValueError:
                        continue
            for at, node in enumerate(linked_nodes(docs)):
                out += [(i, at, k, name, value, None) for k, (name, value) in enumerate(_properties(node))]
                told = node.get("description") or node.get("text")
                if told:
                    out.append((i, at, len(out), None, None, str(told)))
        yield pd.DataFrame(out, columns=["page_id", "node", "seq", "label", "value", "told"])


def linked_rows(pages: DataFrame) -> DataFrame:
    """(page_id, node, seq, label, value, told) of a page's linked data: properties, and what a node's description tells."""
    return pages.select("page_id", "html").mapInPandas(_extract_linked, "page_id long, node int, seq int, label string, value string, told string")
