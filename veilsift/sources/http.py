"""Polite fetching: pacing by host, retries, a response cache. Requests are rows; a host's requests share a task."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "veilsift/0.1 (batch scanner)"

# What is tried again, what is worth keeping besides success, and the bounds of waiting.
RETRIED = frozenset({429, 500, 502, 503, 504})
KEPT = frozenset({403, 404, 410})
MOST_RETRIES, MOST_WAIT, MOST_BACKOFF = 4, 60.0, 30.0
JITTER_PACE, JITTER_BACKOFF = 0.4, 0.3

Transport = Callable[[str, str, bytes | None], tuple[int, str, dict[str, str]]]

REQUEST = "method string, url string, body string"
RESPONSE = "key string, url string, status int, text string, error string, outcome string"


def cache_key(method: str, url: str, body: str | None = None) -> str:
    return hashlib.sha256("\n".join([method, url, body or ""]).encode()).hexdigest()


def key_column(method: str = "method", url: str = "url", body: str = "body"):
    return F.sha2(F.concat_ws("\n", F.col(method), F.col(url), F.coalesce(F.col(body), F.lit(""))), 256)


def worth_keeping(status: int) -> bool:
    return 200 <= status < 300 or status in KEPT


def backoff(attempt: int, retry_after: str | None = None, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait after the attempt-th failure: what the server asks for, bounded, or twice as long each time."""
    try:
        asked = float(retry_after) if retry_after is not None else None
    except ValueError:
        asked = None
    if asked is not None:
        return min(max(asked, 0.0), MOST_WAIT)
    base = min(2.0 ** min(attempt - 1, 16), MOST_BACKOFF)
    return base * (1 + JITTER_BACKOFF * draw())


def due(last: float | None, now: float, rate: float, drawn: float) -> float:
    """When a host may be asked again that was last asked at `last`: 1/rate seconds later and some jitter more, or at
    once. A rate of 0 or less sets no pace."""
    return now if last is None or rate <= 0 else max(now, last + (1 + JITTER_PACE * drawn) / rate)


@dataclass
class Pacer:
    """Paces the requests of one task, which asks one at a time; what else asks its hosts is in no other task."""

    rate: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[], float] = random.random
    asked: dict[str, float] = field(default_factory=dict)

    def wait(self, host: str) -> float:
        now = self.clock()
        self.asked[host] = due(self.asked.get(host), now, self.rate, self.draw())
        if (pause := self.asked[host] - now) > 0:
            self.sleep(pause)
        return pause


def direct(method: str, url: str, body: bytes | None) -> tuple[int, str, dict[str, str]]:
    """The transport that goes to the network."""
    request = urllib.request.Request(url, data=body, method=method, headers={"User-Agent": AGENT, "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=30) as r:
            return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace"), dict(e.headers)


def attempt(method: str, url: str, body: str | None, transport: Transport, pacer: Pacer) -> tuple[int, str, str | None, str]:
    """Status, text, error and outcome of one request, tried again as often as allowed."""
    host = urllib.parse.urlsplit(url).netloc
    status, text, error = 0, "", None
    for n in range(1, MOST_RETRIES + 2):
        pacer.wait(host)
        asked = None
        try:
            status, text, headers = transport(method, url, body.encode() if body else None)
            error, asked = None, headers.get("Retry-After")
            if status not in RETRIED:
                return status, text, None, "ok" if 200 <= status < 300 else "refused"
        except OSError as e:
            status, text, error = 0, "", f"{type(e).__name__}: {e}"
        if n <= MOST_RETRIES:
            pacer.sleep(backoff(n, asked, pacer.draw))
    return status, text, error, "gave up"


def fetch(requests: DataFrame, cache: DataFrame | None = None, rate: float = 1.0, hosts_at_once: int = 6, transport: Transport = direct) -> DataFrame:
    """Responses to requests (REQUEST). Those in a cache of earlier responses aren't sent again; the others are dealt by
    host to as many tasks as hosts may be asked at once, so that a host's pace holds across the cluster."""
    keyed = requests.withColumn("key", key_column()).withColumn("host", F.parse_url("url", F.lit("HOST")))
    todo = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(rate)
        for batch in batches:
            rows = [(r["key"], r["url"], *attempt(r["method"], r["url"], r["body"], transport, pacer)) for r in batch.to_pylist()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            names = ["key", "url", "status", "text", "error", "outcome"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    sent = todo.dropDuplicates(["key"]).repartition(hosts_at_once, "host").select("key", "method", "url", "body").mapInArrow(run, RESPONSE)
    if cache is None:
        return sent
    known = cache.join(keyed.select("key").distinct(), "key", "left_semi").withColumn("outcome", F.lit("cached"))
    return sent.unionByName(known.select("key", "url", "status", "text", "error", "outcome"))


def cacheable(responses: DataFrame) -> DataFrame:
    return responses.where(F.col("status").between(200, 299) | F.col("status").isin(*KEPT))


def outcomes(responses: DataFrame) -> DataFrame:
    return responses.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def json_or_none(status: int, text: str | None):
    try:
        return json.loads(text) if status == 200 and text else None
    except ValueError:
        return None

