"""A page source as a Spark data source: titles in, page rows and error rows out.

The transport is a function from a title to a page (a dict of columns) or an exception; it runs in the
tasks, held to a rate that all partitions share. Titles come from category members by a bounded walk.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import keyed, normalize_title

PAGE = "page_id bigint, revision_id bigint, page_title string, category_group string, raw_text string, is_redirect boolean, redirect_target string, is_disambiguation boolean"


# A query of the public wiki action interface, and what marks a page of meanings.
QUERY = {
    "action": "query", "format": "json", "formatversion": "2", "maxlag": "5", "prop": "extracts|revisions|categories|info|pageprops",
    "explaintext": "1", "exsectionformat": "wiki", "rvprop": "ids|timestamp", "cllimit": "max", "redirects": "1",
}
MEANINGS = ("may refer to:", "{{disambiguation", "disambiguation page")


class Missing(LookupError):
    """The source has no such page: asking again is no use."""


class Lagging(OSError):
    """The source asks for a pause."""


def _key(title: str | None) -> str:
    return " ".join((title or "").replace("_", " ").split()).casefold()


def page_of(said: dict, title: str) -> dict:
    """The page in an answer to QUERY. It is a redirect if its title is another than the one asked for."""
    if (said.get("error") or {}).get("code") == "maxlag":
        raise Lagging("maxlag")
    query = said.get("query") or {}
    page = next(iter(query.get("pages") or ()), None)
    if page is None or page.get("missing"):
        raise Missing(title)
    text = page.get("extract") or ""
    target = next((r.get("to") for r in reversed(query.get("redirects") or []) if _key(r.get("from")) == _key(title)), None)
    meant = bool((page.get("pageprops") or {}).get("disambiguation")) or any(m in text[:500].casefold() for m in MEANINGS)
    revision = next(iter(page.get("revisions") or ()), {}).get("revid", 0)
    return {
        "page_id": int(page["pageid"]), "revision_id": int(revision), "page_title": page.get("title", title), "raw_text": text,
        "is_redirect": target is not None and _key(target) != _key(title), "redirect_target": target, "is_disambiguation": meant,
    }


def http_transport(endpoint: str, agent: str, timeout: float = 30.0) -> Callable[[str, str], dict]:
    """A transport for ``fetch`` that asks a wiki's action interface; ``agent`` names the caller to it."""

    def transport(group: str, title: str) -> dict:
        asked = urllib.request.Request(f"{endpoint}?{urllib.parse.urlencode({**QUERY, 'titles': title})}", headers={"User-Agent": agent})
        with urllib.request.urlopen(asked, timeout=timeout) as response:
            return page_of(json.load(response), title)

    return transport


def category_members(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(group, title): pages below each seed category, through subcategories up to ``depth``. ``edges``
    has parent, child, is_category; ``seeds`` has group, parent."""
    frontier, found = seeds.select("group", "parent"), None
    for level in range(depth + 1):
        below = frontier.join(edges, "parent")
        pages = below.where("not is_category").select("group", F.col("child").alias("title"))
        found = pages if found is None else found.unionByName(pages)
        frontier = below.where("is_category").select("group", F.col("child").alias("parent")).distinct()
    w = Window.partitionBy("group", "key").orderBy("title")
    return found.withColumn("key", normalize_title(F.col("title"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sample_titles(members: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """Up to the quota of titles of each group in keyed order; the first group, by name, wins a title."""
    quota = F.lit(None).cast("int")
    for name, n in quotas.items():
        quota = F.when(F.col("group") == name, F.lit(n)).otherwise(quota)
    w = Window.partitionBy("group").orderBy(keyed(seed, F.col("group"), F.col("key")), "key")
    drawn = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)
    first = Window.partitionBy("key").orderBy("group", "rank")
    return drawn.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def ask(titles: DataFrame, transport: Callable[[str, str], dict], per_second: float = 8.0, attempts: int = 5, base_delay: float = 2.0) -> DataFrame:
    """A row for each title: its page, or the error after all attempts. Every reading asks again, so write it first."""
    partitions = max(titles.rdd.getNumPartitions(), 1)
    gap = partitions / per_second
    names = [x.split()[0] for x in PAGE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            rows = []
            for group, title in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                page, error = {}, None
                for attempt in range(attempts):
                    time.sleep(max(0.0, last + gap - time.monotonic()))
                    last = time.monotonic()
                    try:
                        page, error = transport(group, title), None
                        break
                    except Missing as e:
                        error = f"missing: {e}"
                        break
                    except Exception as e:  # noqa: BLE001  becomes an error row
                        error = f"{type(e).__name__}: {e}"[:500]
                        if attempt + 1 < attempts:
                            time.sleep(base_delay * 2**attempt)
                rows.append({**{n: page.get(n) for n in names}, "title": title, "error": error} | ({"category_group": group}))
            yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([*((n, pa.int64() if k == "bigint" else pa.bool_() if k == "boolean" else pa.string()) for n, k in (x.split() for x in PAGE.split(", "))), ("title", pa.string()), ("error", pa.string())])
    return titles.select("group", "title").mapInArrow(work, f"{PAGE}, title string, error string")


def split_asked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): each page once."""
    good = Window.partitionBy("page_id").orderBy("title")
    pages = rows.where("error is null").withColumn("_r", F.row_number().over(good)).where("_r = 1").drop("_r", "error", "title")
    return pages, rows.where("error is not null").select("title", "category_group", "error")


def fetch(titles: DataFrame, transport: Callable[[str, str], dict], per_second: float = 8.0, attempts: int = 5, base_delay: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of the titles; each of the two asks for itself when it is read."""
    return split_asked(ask(titles, transport, per_second, attempts, base_delay))
