"""Links of listing pages: HTML anchors, JSON feeds, RSS and Atom."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.sources.parsers import decoded

LINKS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType())]))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self._open: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._open = (dict(attrs).get("href") or "", [])

    def handle_data(self, data):
        if self._open:
            self._open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            href, parts = self._open
            title = " ".join("".join(parts).replace("\ufeff", "").split())
            if href and title:
                self.found.append((title, href))
            self._open = None


def html_links(body: bytes, content_type: str, charset: str | None) -> list[tuple[str, str]]:
    a = _Anchors()
    a.feed(decoded(body, charset))
    return a.found


# Names under which feeds keep their items, and items their title and address.
_LISTS, _WRAPPERS = ("items", "list", "results", "news", "articles"), ("data", "result", "payload")
_TITLES, _ADDRESSES = ("title", "name", "subject"), ("url", "href", "link")


def _items(node) -> list:
    if isinstance(node, list):
        return node
    if not isinstance(node, dict):
        return []
    return next((node[k] for k in _LISTS if isinstance(node.get(k), list)), None) or next((x for k in _WRAPPERS if (x := _items(node.get(k)))), [])


def json_links(body: bytes, content_type: str, charset: str | None) -> list[tuple[str, str]]:
    if "json" not in content_type:
        raise ValueError("not JSON")
    first = lambda item, names: next((s for k in names if (s := str(item.get(k) or "").strip())), "")
    found = [(first(i, _TITLES), first(i, _ADDRESSES)) for i in _items(json.loads(body.decode(charset or "utf-8"))) if isinstance(i, dict)]
    return [x for x in found if all(x)]


def rss_links(body: bytes, content_type: str, charset: str | None) -> list[tuple[str, str]]:
    if not any(k in content_type for k in ("xml", "rss", "atom")):
        raise ValueError("not XML")
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    found = []
    for entry in ElementTree.fromstring(body).iter():
        if local(entry) in ("item", "entry"):
            title = next(((c.text or "").strip() for c in entry if local(c) == "title"), "")
            links = [c for c in entry if local(c) == "link"]
            href = next((t for c in links[:1] if (t := (c.text or "").strip())), "") or next((h for c in links if (h := c.get("href"))), "")
            if title and href:
                found.append((title, href))
    return found


#: Adapters by name; callers may add theirs.
ADAPTERS: dict[str, Callable[[bytes, str, str | None], list[tuple[str, str]]]] = {"generic_html_v1": html_links, "json_links_v1": json_links, "rss_v1": rss_links}


def discover(df: DataFrame, keys: list[str], adapter: str = "adapter", body: str = "body", url: str = "url", content_type: str = "content_type", charset: str = "charset") -> DataFrame:
    """Adds ``links`` (absolute) and ``link_error`` to each listing; a listing that can't be read, or of an unknown adapter, is an error row."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("links", LINKS), T.StructField("link_error", T.StringType())])
    adapters = dict(ADAPTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, links, errors = batch[keys].copy(), [], []
            for a, b, u, t, c in zip(*(batch[x] for x in ("__a", "__b", "__u", "__t", "__c"))):
                try:
                    if a not in adapters:
                        raise ValueError(f"unknown adapter: {a}")
                    links.append([{"title": x, "url": urljoin(u or "", y)} for x, y in adapters[a](bytes(b or b""), (t or "").lower(), c)])
                    errors.append(None)
                except Exception as e:  # one bad listing is a row
                    links.append([])
                    errors.append(str(e))
            out["links"], out["link_error"] = links, errors
            yield out

    cols = {"__a": adapter, "__b": body, "__u": url, "__t": content_type, "__c": charset}
    return df.select(*keys, *(F.col(c).alias(n) for n, c in cols.items())).mapInPandas(run, schema)
