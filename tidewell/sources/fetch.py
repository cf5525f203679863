"""Conditional requests: what a cache holds of an address is offered as validators, and kept where the answer is that nothing changed.

A client is a plug-in named by its import path: ``get(url, headers)`` gives (status, headers, body) or
raises. Requests run in tasks on Arrow batches, a client a task; a request that fails is made once more.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "url string, method string, status int, body string, etag string, last_modified string, reused boolean, attempts int, error string"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]


class StandInClient:
    """A deterministic client without a network: the entity tag is the address's digest; what holds ``fail`` fails, what holds ``gone`` answers 404."""

    def get(self, url: str, headers: dict[str, str], method: str = "GET") -> tuple[int, dict[str, str], str]:
        if "fail" in url:
            raise OSError("no connection")
        etag = hashlib.sha1(url.encode()).hexdigest()[:8]
        if "gone" in url:
            return 404, {}, ""
        if headers.get("If-None-Match") == etag:
            return 304, {}, ""
        return 200, {"ETag": etag, "Last-Modified": "Mon, 01 Jan 2024 00:00:00 GMT"}, f"{method} {url}"


def _requests(client: str):
    module, name = client.split(":")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = getattr(importlib.import_module(module), name)()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                validators = {"If-None-Match": row["etag"], "If-Modified-Since": row["last_modified"]}
                headers = {k: v for k, v in validators.items() if v} if row["method"] == "GET" else {}
                error = None
                for attempt in (1, 2):
                    try:
                        status, got, body = one.get(row["url"], headers, row["method"])
                        if status != 304 and not 200 <= status < 300:
                            raise OSError(f"status {status}")
                        got = {k.lower(): v for k, v in got.items()}
                        same = status == 304
                        # what hasn't changed keeps its body and validators
                        kept = (row["body"], row["etag"], row["last_modified"]) if same else (body, got.get("etag"), got.get("last-modified"))
                        out.append((row["url"], row["method"], status, *kept, same, attempt, None))
                        break
                    except Exception as e:  # noqa: BLE001  one request's failure is a row
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append((row["url"], row["method"], None, None, None, None, False, 2, error))
            columns = list(zip(*out, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in ANSWER.split(", ")])

    return run


def fetched(requests: DataFrame, cache: DataFrame, client: str = f"{__name__}:StandInClient") -> DataFrame:
    """ANSWER rows of requests (url, method): each address once a method.

    cache (url, etag, last_modified, body; unique by url) gives validators to GET requests; an answer of 304 keeps
    what is there. Addresses without a cached body are asked for without validators.
    """
    held = cache.where("body IS NOT NULL").select(F.col("url").alias("_u"), "etag", "last_modified", "body")
    asked = requests.select("url", F.upper(F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("GET"))).alias("method")).where("url <> ''").distinct()
    rows = asked.join(held, F.col("url") == F.col("_u"), "left").select("url", "method", "etag", "last_modified", "body")
    return rows.mapInArrow(_requests(client), ANSWER)
