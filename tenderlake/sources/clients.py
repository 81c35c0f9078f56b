"""Clients of remote services: bounded retries, page chains and offset pages, and a Spark source.

A transport is a function (method, url, parameters, headers) -> (status, headers, body); the
default one is of the standard library.  Nothing here runs unless it is called, and tests give
their own transport and clock.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Transport = Callable[[str, str, dict, dict], tuple[int, dict, bytes]]


class Restricted(Exception):
    """The register does not disclose this company; asking again does not help."""


def http(method: str, url: str, parameters: dict, headers: dict, timeout: float = 30) -> tuple[int, dict, bytes]:
    body = json.dumps(parameters).encode() if method == "POST" else None
    if method == "GET" and parameters:
        url += "?" + urllib.parse.urlencode(parameters)
    ask = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers} if body else headers, method=method)
    try:
        with urllib.request.urlopen(ask, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def fetch(transport: Transport, method: str, url: str, parameters: dict | None = None, headers: dict | None = None, tries: int = 5,
          most: float = 60, final: tuple[int, ...] = (), sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    """(status, body) of the first answer below 400 or in ``final``.  Others, and network errors,
    are tried again after 1, 2, 4 ... seconds, at most ``most``, or as a 429 asks."""
    said: object = None
    for n in range(tries):
        wait = min(2.0**n, most)
        try:
            status, got, body = transport(method, url, parameters or {}, headers or {})
            if status < 400 or status in final:
                return status, body
            said = f"status {status}"
            asked = {k.lower(): v for k, v in got.items()}.get("retry-after", "")
            if status == 429 and asked.isdigit():
                wait = min(float(asked), most)
        except OSError as e:
            said = e
        if n < tries - 1:
            sleep(wait)
    raise RuntimeError(f"{url}: no answer in {tries} tries ({said}; {parameters})")


def token_pages(transport: Transport, url: str, query: dict, rows: str = "notices", token: str = "iterationNextToken", total: str = "totalNoticeCount",
                pages: int | None = None, **retry) -> Iterator[dict]:
    """Rows of pages that each name the next, until one is empty or last, or ``pages`` are read."""
    seen, at, n = 0, None, 0
    while pages is None or n < pages:
        _, body = fetch(transport, "POST", url, query | ({token: at} if at else {}), **{"tries": 8} | retry)
        page = json.loads(body)
        yield from page.get(rows, [])
        seen, at, n = seen + len(page.get(rows, [])), page.get(token), n + 1
        if not page.get(rows) or not at or seen >= page.get(total, 0):
            return


def offset_page(transport: Transport, url: str, query: dict, offset: int, limit: int = 100, **retry) -> dict:
    return json.loads(fetch(transport, "GET", url, query | {"limit": limit, "offset": offset}, **retry)[1])


def export(transport: Transport, url: str, query: dict, **retry) -> list[dict]:
    """The whole result as one JSON list, for services whose pages end at a fixed offset."""
    return json.loads(fetch(transport, "GET", url, query, **retry)[1])


def company(transport: Transport, base: str, siren: str, key: str, **retry) -> dict | None:
    """A register answer; None if unknown, ``Restricted`` if it is not disclosed."""
    status, body = fetch(transport, "GET", f"{base}/siren/{siren}", headers={"X-INSEE-Api-Key-Integration": key}, final=(403, 404), **retry)
    if status == 403:
        raise Restricted(siren)
    return None if status == 404 else json.loads(body)


def companies_by_name(transport: Transport, base: str, name: str, key: str, past: bool = False, limit: int = 20, **retry) -> list[dict]:
    """Establishments of companies of a name, five fields each, or, with ``past``, companies that ever bore it."""
    shape = 'periode(denominationUniteLegale:"%s")' if past else 'denominationUniteLegale:"%s"'
    _, body = fetch(transport, "GET", f"{base}/{'siren' if past else 'siret'}", {"q": shape % name.replace('"', ""), "nombre": limit},
                    {"X-INSEE-Api-Key-Integration": key}, **retry)
    got = json.loads(body)
    if past:
        return got.get("unitesLegales", [])
    return [{"siren": e.get("siren"), "siret": e.get("siret"), "denomination": e.get("uniteLegale", {}).get("denominationUniteLegale"),
             "etat_administratif": e.get("uniteLegale", {}).get("etatAdministratifUniteLegale"), "est_siege": e.get("etablissementSiege")}
            for e in got.get("etablissements", [])]


def search_page(transport: Transport, url: str, query: str) -> str:
    """The HTML of a web search; empty on any failure."""
    try:
        status, _, body = transport("GET", url, {"q": query}, {"User-Agent": "Mozilla/5.0"})
        return body.decode(errors="replace") if status < 400 else ""
    except OSError:
        return ""


def landed(transport: Transport, url: str, target: str, force: bool = False, **retry) -> str:
    """A file fetched once; an earlier copy stands unless ``force``."""
    path = Path(target)
    if force or not path.exists():
        body = fetch(transport, "GET", url, **retry)[1]
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        part.write_bytes(body)
        part.rename(path)
    return str(path)


def only_csv(archive: str, folder: str) -> str:
    """The one CSV file of a zip archive, extracted; an error if there is none or more."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if len(names) != 1:
            raise ValueError(f"{archive}: {len(names)} CSV files, not one")
        return z.extract(names[0], folder)


class _Offset(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)


def paged_source(transport: Transport, name: str = "offset_pages") -> type[DataSource]:
    """A Spark source of offset pages, one partition a page, rows as JSON text.  Options: url,
    where, limit (100), pages (all).  The driver asks for the total once."""

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "avis string"

        def reader(self, schema):
            return Reader(dict(self.options))

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.url, self.query = options["url"], {"where": options.get("where", "")}
            self.limit, self.pages = int(options.get("limit", 100)), options.get("pages")

        def partitions(self):
            total = offset_page(transport, self.url, self.query, 0, 1)["total_count"]
            n = -(-total // self.limit)
            return [_Offset(i * self.limit) for i in range(n if self.pages is None else min(n, int(self.pages)))]

        def read(self, partition):
            for row in offset_page(transport, self.url, self.query, partition.value, self.limit).get("results", []):
                yield (json.dumps(row, ensure_ascii=False),)

    return Pages


# The fields of a notice that are asked for, and the form of a request.
NOTICE_FIELDS = ("publication-number", "publication-date", "notice-title", "buyer-name", "buyer-identifier", "buyer-country", "classification-cpv", "total-value", "winner-name", "winner-identifier")
RESULT_NOTICES = "buyer-country={country} AND publication-date>={day:%Y%m%d} AND form-type=result"


def notice_request(today: datetime.date, prefix: str | None = None, country: str = "FRA", years: int = 3, limit: int = 250) -> dict:
    """The request for result notices of a country in the last 365 days a year; with a prefix, of categories that begin so."""
    query = RESULT_NOTICES.format(country=country, day=today - datetime.timedelta(days=365 * years))
    if prefix:
        query = f"classification-cpv={prefix}* AND {query}"
    return {"query": query, "fields": list(NOTICE_FIELDS), "limit": limit, "scope": "ALL", "paginationMode": "ITERATION"}


def token_source(transport: Transport, name: str = "token_pages", **retry) -> type[DataSource]:
    """A Spark stream of pages that each name the next, rows as JSON text.  Options: url, request (JSON), and
    pages, how many a batch reads (1).

    The offset of the stream is the token of the next page, so a stopped stream goes on where its
    checkpoint says and asks for no page twice; a batch that is run again reads the pages from its first
    token.  At the end of the chain the stream has no more rows.
    """

    class Chain(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "avis string"

        def simpleStreamReader(self, schema):
            return Reader(dict(self.options))

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.url, self.request, self.pages = options["url"], json.loads(options.get("request", "{}")), int(options.get("pages", 1))

        def initialOffset(self):
            return {"token": "", "seen": 0, "page": 0, "end": 0}

        def _page(self, at: dict):
            _, body = fetch(transport, "POST", self.url, self.request | ({"iterationNextToken": at["token"]} if at["token"] else {}), **{"tries": 8} | retry)
            page = json.loads(body)
            rows, token = page.get("notices", []), page.get("iterationNextToken") or ""
            seen = at["seen"] + len(rows)
            end = not rows or not token or seen >= page.get("totalNoticeCount", 0)
            return [(json.dumps(r, ensure_ascii=False),) for r in rows], {"token": token, "seen": seen, "page": at["page"] + 1, "end": int(end)}

        def read(self, start):
            rows, at = [], start
            for _ in range(self.pages):
                if at["end"]:
                    break
                more, at = self._page(at)
                rows += more
            return iter(rows), at

        def readBetweenOffsets(self, start, end):
            at = start
            while at["page"] < end["page"]:
                more, at = self._page(at)
                yield from more

    return Chain
