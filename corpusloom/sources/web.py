"""Where a crawl's responses come from: the web, or a table of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls

RESPONSES = "url string, error string, status int, content_type string, html string"
TIMEOUT = 20
#: What a browser would send (fixed values of the protocol).
HEADERS = {"Accept": "text/html,application/xhtml+xml", "Accept-Language": "en-US,en;q=0.9"}


def seed_table(spark: SparkSession, seeds: list[str]) -> DataFrame:
    """url, rank of a site's seeds, in their order. The list is the site's own."""
    return spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, rank int")


def http(timeout: float = TIMEOUT, headers: dict[str, str] | None = None, delay: float = 0.0, tasks: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A fetch over HTTP in the tasks, redirects followed; the requested URL stays the page's URL.

    A request that fails gives its error and no status; an answer with another status than 200 is no
    error. Hosts are dealt to `tasks` tasks, so they are asked in parallel; a host is asked from one task only,
    one page at a time, and not before `delay` seconds after its last answer. A task takes its hosts in turn, so that one's
    pause is used for the others.
    """
    sent = HEADERS | (headers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        import urllib.error
        import urllib.request

        opener, ready = urllib.request.build_opener(), {}
        for frame in frames:
            rows = []
            turn = frame.groupby("_host", dropna=False).cumcount()
            for url, host in frame.assign(_turn=turn).sort_values("_turn", kind="stable")[["url", "_host"]].itertuples(index=False):
                time.sleep(max(0.0, ready.get(host, 0.0) - time.monotonic()))
                error = status = kind = body = None
                try:
                    with opener.open(urllib.request.Request(url, headers=sent), timeout=timeout) as answer:
                        status, kind = answer.status, answer.headers.get("Content-Type", "")
                        body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
                except urllib.error.HTTPError as e:
                    status, kind = e.code, e.headers.get("Content-Type", "")
                except Exception as e:  # noqa: BLE001  any failure of a request is that page's error
                    error = f"{type(e).__name__}: {e}"
                rows.append((url, error, status, kind, body))
                ready[host] = time.monotonic() + delay
            yield pd.DataFrame(rows, columns=["url", "error", "status", "content_type", "html"]).astype({"status": "Int32"})

    return lambda frontier: frontier.select("url", F.coalesce(urls.netloc(F.col("url")), F.lit("")).alias("_host")).repartition(tasks, "_host").mapInPandas(run, RESPONSES)


def archive(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch from a table of responses (url, error, status, content_type, html); a URL that isn't there is a failed request.

    URLs are compared in their normal form; of several responses of a URL one is taken.
    """
    known = pages.withColumn("_key", urls.normalize(F.col("url"))).drop("url")

    def fetch(frontier: DataFrame) -> DataFrame:
        found = known.join(frontier.select("url"), F.col("_key") == F.col("url")).dropDuplicates(["url"])
        lost = frontier.select("url").join(found.select("url"), "url", "left_anti").select("url", F.lit("not in the archive").alias("error"))
        return found.select("url", "error", F.col("status").cast("int").alias("status"), "content_type", "html").unionByName(lost, allowMissingColumns=True)

    return fetch
