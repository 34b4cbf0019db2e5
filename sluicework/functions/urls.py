"""Column functions on URLs."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Suffixes of documents, labels of links to a following page, and page numbers that count as such.
DOCUMENTS = ["pdf", "xlsx", "xls", "xlsm", "doc", "docx"]
NEXT_LABELS = ["下一页", "下页", "后一页", "next", "nextpage", ">", ">>"]
PAGE_LABELS = ["1", "2", "3", "4", "5", "下一页"]


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def registrable(c: Column) -> Column:
    """The last two labels of a host, three below a two-letter country's usual second level."""
    h = host(c)
    return F.when(h.rlike("\\.(com|edu|gov|org|net|ac)\\.[a-z]{2}$"), F.regexp_extract(h, "([^.]+\\.[^.]+\\.[^.]+)$", 1)).otherwise(F.regexp_extract(h, "([^.]+\\.[^.]+)$", 1))


def host_allowed(h: Column, domains: Column) -> Column:
    """Whether a host is one of the domains, below one, or below the suffix of a ``*.`` entry."""

    def fits(d: Column) -> Column:
        entry = F.lower(F.trim(d))
        bare = F.ltrim(entry, F.lit("."))
        return F.when(entry.startswith("*."), h.endswith(F.substring(entry, F.lit(2), F.length(entry)))).otherwise((h == bare) | h.endswith(F.concat(F.lit("."), bare)))

    return F.coalesce(F.exists(domains, fits), F.lit(False))


def file_extension_in(url: Column) -> Column:
    """Whether a URL names a document, in its path or in its query."""
    low = F.element_at(F.split(F.lower(url), "#", 2), 1)
    path = F.element_at(F.split(low, "\\?", 2), 1)
    return path.rlike(f"\\.({'|'.join(DOCUMENTS)})$") | (low.contains("?") & low.rlike(f"\\.({'|'.join(DOCUMENTS)})(?=&|$)"))


def is_attachment(title: Column, url: Column, title_terms: list[str]) -> Column:
    """Whether a link leads to a document: by its address, else by a term in its title."""
    return file_extension_in(url) | F.exists(F.array(*map(F.lit, title_terms)), lambda t: title.contains(t))


def file_name(url: Column) -> Column:
    """The name under which a document is offered: the query's fileName, else the path's last part, both decoded; null if there is none."""
    named = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("fileName")))
    last = F.try_url_decode(F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(last, F.lit("")))


def is_page_below(url: Column, suffix: str) -> Column:
    """Whether a URL is a page, no index, of a host below the suffix."""
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(host(url).endswith(suffix) & path.rlike("\\.s?html?$") & ~name.rlike("^(index|default)"), F.lit(False))


def is_next_page(title: Column, url: Column) -> Column:
    label = F.lower(F.regexp_replace(title, "(?U)\\s+", ""))
    return label.isin(NEXT_LABELS) | (F.lower(url).contains("page=") & label.isin(PAGE_LABELS))


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC 3986 resolution, which no built-in does."""
    return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(base, link)], dtype=object)
