"""Lists of page addresses, their request key, and source-kind dispatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import strip
from quarrystone.schemas import FETCHED


def url_error(url: Column) -> Column:
    """What is wrong with a page address, or null."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.when(~scheme.isin("http", "https"), F.concat(F.lit("only http and https addresses are read: "), url)).when(
        name == "", F.concat(F.lit("an address needs a host: "), url)
    ).when(authority.contains("@"), F.concat(F.lit("addresses must not hold credentials: "), url))


def parse_url_list(lists: DataFrame, value: str = "value", most: int = 20) -> DataFrame:
    """(pos, url): the addresses of a text, one a line, each once in the order first seen. Faulty ones, none at all and
    more than ``most`` raise an error when read."""
    each = lists.select(F.posexplode(F.split(value, "\\r\\n|\\r|\\n", -1)).alias("line", "raw")).select("line", strip(F.col("raw")).alias("url")).where("url <> ''")
    sure = F.when(url_error(F.col("url")).isNull(), F.col("url")).otherwise(F.raise_error(url_error(F.col("url"))).cast("string"))
    first = each.withColumn("url", sure).groupBy("url").agg(F.min("line").alias("line"))
    # at most `most` addresses pass, so one task may number them
    numbered = first.withColumn("pos", (F.row_number().over(Window.orderBy("line")) - 1)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    within = F.when(F.col("n") <= most, F.col("pos")).otherwise(F.raise_error(F.lit(f"at most {most} addresses can be read at once")).cast("int"))
    return numbered.select(within.alias("pos"), "url")


def urls_from_text(spark: SparkSession, value: str, most: int = 20) -> list[str]:
    """The addresses of one text as a list; empty input is an error."""
    found = parse_url_list(spark.createDataFrame([(value,)], "value string"), most=most).orderBy("pos").collect()
    if not found:
        raise ValueError("Provide at least one address")
    return [r.url for r in found]


def request_key(urls: DataFrame) -> DataFrame:
    """One row ``request_key``: the first 16 hex digits of the SHA-256 of the ordered addresses as a compact JSON list.

    The list of addresses of one request is what is hashed, in one task.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])
    return urls.agg(F.substring(F.sha2(F.to_json(listed), 256), 1, 16).alias("request_key"))


def source_kind(sources: list[str], kind: str = "auto") -> str:
    """``web`` for addresses, ``pdf`` for paths of PDF files; a mix, nothing and unknown kinds are errors."""
    given = [s.strip() for s in sources if s and s.strip()]
    if not given:
        raise ValueError("Provide at least one source")
    if kind in ("web", "url"):
        return "web"
    if kind == "pdf":
        return "pdf"
    if kind != "auto":
        raise ValueError(f"unknown source type: {kind}")
    web = [s.lower().startswith(("http://", "https://")) for s in given]
    paper = [s.lower().endswith(".pdf") and not w for s, w in zip(given, web)]
    if all(web):
        return "web"
    if all(paper):
        return "pdf"
    raise ValueError("sources must be all addresses or all PDF files")


def read_response(final_url: str, content_type: str, body: bytes, most: int) -> str:
    """A response as text; raises for other kinds of content, addresses that left the web, and bodies over ``most`` bytes."""
    if not final_url.lower().startswith(("http://", "https://")):
        raise ValueError(f"redirected to an address that isn't read: {final_url}")
    kind = content_type.split(";")[0].strip().lower()
    if kind not in ("text/html", "application/xhtml+xml"):
        raise ValueError(f"not a web page: {kind or 'unknown content'}")
    if len(body) > most:
        raise ValueError(f"a page has more than {most} bytes")
    charset = next((p.split("=", 1)[1].strip("\"' ") for p in content_type.split(";")[1:] if p.strip().lower().startswith("charset=")), "utf-8")
    try:
        return body.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", errors="replace")


def http_fetcher(timeout: float, most: int) -> Callable[[str], tuple[str, str]]:
    """Fetches one address: (final address, text)."""

    def fetch(url: str) -> tuple[str, str]:
        from urllib.request import Request, urlopen

        request = Request(url, headers={"User-Agent": "quarrystone/0.1", "Accept": "text/html,application/xhtml+xml"})
        with urlopen(request, timeout=timeout) as r:
            return r.geturl(), read_response(r.geturl(), r.headers.get("Content-Type", ""), r.read(most + 1), most)

    return fetch


def fetch_pages(urls: DataFrame, fetcher: Callable[[str], tuple[str, str]]) -> DataFrame:
    """(pos, requested_url, final_url, html): every address fetched; any failure fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [fetcher(u) for u in p["url"]]
            yield pd.DataFrame({"pos": p["pos"], "requested_url": p["url"], "final_url": [g[0] for g in got], "html": [g[1] for g in got]})

    return urls.select("pos", "url").mapInPandas(run, FETCHED)
