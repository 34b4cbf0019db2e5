"""Conditional fetching as a partitioned map; the transport is injected, so that tests and replays need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions.urls import host, host_allowed

REFUSED = "address not allowed"

FETCHED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()), T.StructField("body", T.BinaryType()),
    T.StructField("elapsed_ms", T.IntegerType()), T.StructField("charset", T.StringType()), T.StructField("etag", T.StringType()), T.StructField("last_modified", T.StringType()),
    T.StructField("not_modified", T.BooleanType()), T.StructField("error", T.StringType()),
])


def headers(etag: str | None = None, last_modified: str | None = None, referer: str | None = None, agent: str = "sluicework/1.0") -> dict[str, str]:
    pairs = {"User-Agent": agent, "If-None-Match": etag, "If-Modified-Since": last_modified, "Referer": referer}
    return {k: v for k, v in pairs.items() if v}


def retry_legacy_tls(error: BaseException) -> bool:
    """Only failures of the handshake itself may be tried again with old settings, never those of a certificate."""
    text = str(error).lower()
    return "certificate" not in text and any(k in text for k in ("handshake", "unsafe_legacy", "dh_key_too_small", "unsupported protocol", "sslv3_alert"))


def fetch_all(sources: DataFrame, transport: Callable[[str, dict], dict], most_bytes: int = 20 * 2**20, partitions: int | None = None, legacy: Callable[[str, dict], dict] | None = None) -> DataFrame:
    """Fetches id, url, allowed_domains, etag, last_modified rows, one failure never touching another.

    transport(url, headers) gives status, url (after redirects), body, content_type, charset, etag,
    last_modified. The host must be allowed before and after redirects; 304 is ``not_modified``; a larger body
    than allowed, or any exception, is an ``error``. ``legacy``, a transport with old settings, is tried once when a handshake
    fails, never for a certificate.
    """

    def one(row) -> dict:
        out = dict.fromkeys(FETCHED.names) | {"id": row.id, "url": row.url, "not_modified": False}
        began = time.monotonic()
        try:
            if not row.may:
                raise ValueError(REFUSED)
            sent = headers(row.etag, row.last_modified)
            try:
                got = transport(row.url, sent)
            except Exception as e:
                if legacy is None or not retry_legacy_tls(e):
                    raise
                got = legacy(row.url, sent)
            if got.get("status") == 304:
                out |= {"status": 304, "not_modified": True, "url": got.get("url") or row.url}
            elif len(got.get("body") or b"") > most_bytes:
                raise ValueError("body too large")
            else:
                out |= {k: got.get(k) for k in ("status", "content_type", "body", "charset", "etag", "last_modified")} | {"url": got.get("url") or row.url}
        except Exception as e:  # the row says what failed
            out["error"] = str(e)
        return out | {"elapsed_ms": int((time.monotonic() - began) * 1000), "allowed_domains": row.allowed_domains}

    schema = T.StructType([*FETCHED.fields, T.StructField("allowed_domains", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(r) for r in batch.itertuples()], columns=schema.names)
            for c in ("status", "elapsed_ms"):
                out[c] = out[c].astype("Int32")
            yield out

    fits = host_allowed(host(F.col("url")), F.col("allowed_domains"))
    rows = sources.select("id", "url", "allowed_domains", "etag", "last_modified", (fits & F.lower("url").rlike("^https?://")).alias("may"))
    got = (rows.repartition(partitions) if partitions else rows).mapInPandas(run, schema)
    # A redirect may lead anywhere: what came from an address that isn't allowed is dropped, and the row says so.
    strayed = F.col("error").isNull() & ~fits
    kept = {n: F.when(~strayed, F.col(n)) for n in ("status", "content_type", "body", "charset", "etag", "last_modified")}
    refused = {"not_modified": F.col("not_modified") & ~strayed, "error": F.when(strayed, "redirected to an address not allowed").otherwise(F.col("error"))}
    return got.withColumns(kept | refused).select(*FETCHED.names)
