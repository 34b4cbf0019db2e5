"""A cycle of the monitor: listings page by page, details and what hangs on them, what changed since the last cycle.

Fetching is the injected transport's (``fetch_all``). The loops here are over pages and levels, whose number is a setting, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions import urls
from sluicework.session import checkpointed
from sluicework.sources.fetch import fetch_all
from sluicework.sources.links import discover

Transport = Callable[[str, dict], dict]


def _links(pages: DataFrame, keys: list[str], transport: Transport, adapter: Column) -> DataFrame:
    """(keys, page, links, error) of pages given as keys, url and allowed_domains; the id of a request tells which keys it is for."""
    asked = pages.withColumn("id", F.sha2(F.concat_ws("|", *keys, "url"), 256)).withColumns({c: F.lit(None).cast("string") for c in ("etag", "last_modified")})
    got = checkpointed(fetch_all(asked, transport))  # a page is asked for once
    held = asked.select("id", *keys, F.col("url").alias("page"), adapter.alias("adapter")).join(got, "id")
    found = discover(held.withColumnRenamed("error", "__error"), [*keys, "page", "__error"])
    return found.select(*keys, "page", "links", F.coalesce("__error", "link_error").alias("error"))


def walk(sources: DataFrame, transport: Transport) -> tuple[DataFrame, DataFrame]:
    """Follows each source's links to a next page, at most ``max_pages`` pages, none twice.

    sources: id, entry_url, allowed_domains, adapter, max_pages. Gives the pages (id, page, step, error) and the links (id, title, url, first step),
    each address once for a source. Only sources of the generic HTML adapter have following pages. A step takes all sources' pages at once, so there are as many as the
    largest ``max_pages``, whatever the number of sources.
    """
    own = sources.select(F.col("id").alias("source_id"), "allowed_domains", "adapter", "max_pages")
    ahead = sources.select(F.col("id").alias("source_id"), F.col("entry_url").alias("url"), "allowed_domains", "adapter")
    seen = links = None
    for step in range(1, (sources.agg(F.max("max_pages")).first()[0] or 0) + 1):
        got = checkpointed(_links(ahead, ["source_id"], transport, F.col("adapter")).withColumn("step", F.lit(step)))
        seen = got.drop("links") if seen is None else checkpointed(seen.unionByName(got.drop("links")))
        new = got.select("source_id", "step", F.explode("links").alias("l")).select("source_id", "step", "l.title", "l.url")
        links = new if links is None else links.unionByName(new)
        following = new.where(urls.is_next_page(F.col("title"), F.col("url"))).select("source_id", "url").distinct()
        following = following.join(seen.select("source_id", F.col("page").alias("url")), ["source_id", "url"], "left_anti")
        # The number of pages is the source's setting: of several labelled links the first addresses fill it up.
        room = own.where(F.col("adapter") == "generic_html_v1").join(seen.groupBy("source_id").agg(F.count("*").alias("n")), "source_id").where("n < max_pages")
        ranked = following.join(room, "source_id").withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("url")))
        ahead = checkpointed(ranked.where("n + k <= max_pages").select("source_id", "url", "allowed_domains", "adapter"))
        if ahead.isEmpty():
            break
    if links is None:
        raise ValueError("no source has a page")
    return seen, links.groupBy("source_id", "url").agg(F.min(F.struct("step", "title")).alias("f")).select("source_id", "f.title", "url", "f.step")


def attachments(details: DataFrame, transport: Transport, title_terms: list[str], suffix: str) -> DataFrame:
    """Documents that hang on detail pages, or on pages that those link to: two levels, no more.

    details: id, url, allowed_domains. Gives (id, title, url, level), each address once at its least level. A page of the second level is
    no index, lies below ``suffix``, and is asked for once for each detail.
    """
    own = details.select(F.col("id").alias("detail"), "url", "allowed_domains")
    generic, keys = F.lit("generic_html_v1"), ["detail", "allowed_domains"]
    first = checkpointed(_links(own, keys, transport, generic).select(*keys, "page", F.explode("links").alias("l")).select(*keys, "page", "l.title", "l.url"))
    is_document = urls.is_attachment(F.col("title"), F.col("url"), title_terms)
    pages = first.where(~is_document & urls.is_page_below(F.col("url"), suffix) & (F.col("url") != F.col("page"))).select(*keys, "url").distinct()
    second = _links(pages, keys, transport, generic).select("detail", F.explode("links").alias("l")).select("detail", "l.title", "l.url")
    both = first.where(is_document).select("detail", "title", "url", F.lit(1).alias("level")).unionByName(second.where(is_document).withColumn("level", F.lit(2)))
    return both.groupBy("detail", "url").agg(F.min(F.struct("level", "title")).alias("f")).select(F.col("detail").alias("id"), "f.title", "url", "f.level")


def detected(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """What each fetch tells: ``error``, ``not_modified``, ``new``, ``unchanged`` or ``changed``, with the state to keep.

    fetched: id, status, digest, etag, last_modified, error, one row an id; state: the same id, digest, etag and last_modified of the last cycle. After an
    error or a 304 the old state stays.
    """
    old = state.select("id", *(F.col(c).alias(f"__{c}") for c in ("digest", "etag", "last_modified")), F.lit(True).alias("__held"))
    both = fetched.join(old, "id", "left")
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("status") == 304, "not_modified").when(F.col("__held").isNull(), "new")
        .when(F.col("digest").eqNullSafe(F.col("__digest")), "unchanged").otherwise("changed")
    )
    stays = outcome.isin("error", "not_modified")
    return both.select("id", outcome.alias("outcome"), *(F.when(stays, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("digest", "etag", "last_modified")))


def detail_retries(notices: DataFrame, told: DataFrame, each: int = 20) -> DataFrame:
    """Failed details to be tried again, the newest ``each`` of a source, with the kind of event they give: ``content_change`` if the notice was told of before, else ``new``."""
    newest = Window.partitionBy("source_id").orderBy(F.col("first_seen_at").desc(), "id")
    failed = notices.where("detail_status = 'failed'").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= each)
    known = told.select(F.col("notice_id").alias("id"), F.lit(True).alias("__told")).distinct()
    return failed.join(known, "id", "left").withColumn("event_type", F.when(F.col("__told"), "content_change").otherwise("new")).drop("__told")
