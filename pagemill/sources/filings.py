"""Filings of companies as a data source with partitions, pushed filters and one budget of requests (SRC-10, SRC-12).

A company's listing is one request. Requests of all partitions share the interval: time is cut into slots of that length,
and partition i of n may ask only in slots i, n + i, 2n + i and so on, so two requests of the whole read are never closer
than the interval (as far as clocks agree), and every partition gets its part of the rate.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "ticker string, cik long, form string, accession string, document string, filing_date string, error string"
#: Fixed value: least seconds between two requests.
INTERVAL = 0.12


class Slots:
    """Waits for the next free slot of partition `own` of `of`; start is the same moment for all of them."""

    def __init__(self, start: float, own: int, of: int, interval: float = INTERVAL, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.start, self.own, self.of, self.interval, self.clock, self.sleep, self.used = start, own, of, interval, clock, sleep, -1

    def __call__(self) -> None:
        if self.interval <= 0:
            return
        now = self.clock()
        first = max(0, -int(-((now - self.start) / self.interval - self.own) // self.of))
        turn = max(self.used + 1, first)
        self.used = turn
        due = self.start + (turn * self.of + self.own) * self.interval
        if due > now:
            self.sleep(due - now)


class Companies(InputPartition):
    def __init__(self, own: int, of: int, start: float, rows: list[tuple[str, int]]):
        super().__init__(own)
        self.own, self.of, self.start, self.rows = own, of, start, rows


class FilingsReader(DataSourceReader):
    def __init__(self, get: Callable[[str], bytes], options: dict[str, str]):
        self.get, self.options = get, options
        self.tickers: set[str] | None = None
        self.forms: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on ticker and form are taken over (others are left to the engine): fewer requests, fewer rows."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("ticker",), ("form",)):
                yield f
            elif f.attribute == ("ticker",):
                self.tickers = values if self.tickers is None else self.tickers & values
            else:
                self.forms = values if self.forms is None else self.forms & values

    def partitions(self) -> list[InputPartition]:
        """The wanted companies, dealt in turn; unknown tickers have none."""
        known = {x["ticker"].upper(): int(x["cik_str"]) for x in json.loads(self.get(self.options["map_url"])).values()}
        asked = self.options.get("tickers")
        names = [t.strip().upper() for t in asked.split(",")] if asked else sorted(known)
        rows = [(t, known[t]) for t in dict.fromkeys(names) if t in known and (self.tickers is None or t in self.tickers)]
        of = max(1, min(int(self.options.get("partitions", "4")), len(rows)))
        start = time.time() + float(self.options.get("interval", INTERVAL))
        return [Companies(i, of, start, rows[i::of]) for i in range(of)]

    def read(self, partition: Companies) -> Iterator[tuple]:
        wait = Slots(partition.start, partition.own, partition.of, float(self.options.get("interval", INTERVAL)))
        forms = {x.strip() for x in self.options.get("forms", "").split(",") if x.strip()}
        most = int(self.options.get("per_company", "0"))
        for ticker, cik in partition.rows:
            wait()
            try:
                recent = json.loads(self.get(self.options["submissions_url"].format(cik=cik))).get("filings", {}).get("recent", {})
            except Exception as e:  # noqa: BLE001 - a company's failure is data here
                yield ticker, cik, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            found = 0
            for form, accession, document, date in zip(*(recent.get(k, []) for k in ("form", "accessionNumber", "primaryDocument", "filingDate"))):
                if (forms and form not in forms) or not document or not document.lower().endswith((".htm", ".html")):
                    continue
                found += 1  # the first per_company of the wanted forms, whatever the reader filters besides
                if self.forms is None or form in self.forms:
                    yield ticker, cik, form, accession.replace("-", ""), document, date, None
                if found == most:
                    break


def filings(spark: SparkSession, get: Callable[[str], bytes], **options) -> DataFrame:
    """SRC-12: (ticker, cik, form, accession, document, filing_date, error) of companies' listings.

    get fetches a URL in driver and tasks. Options: map_url (JSON of ticker and cik_str), submissions_url (with {cik}), tickers
    and forms (comma-separated; all if missing), per_company (first so many of the forms; 0: all), partitions, interval. A
    company whose listing fails is one row with an error; a condition on form leaves that row out.
    """

    class Filings(DataSource):
        @classmethod
        def name(cls) -> str:
            return "filings"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FilingsReader(get, dict(self.options))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Filings)
    return spark.read.format("filings").options(**{k: str(v) for k, v in options.items()}).load()
