"""HTTP source: monthly requests with retries, as a Spark data source with one partition per month."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class FetchConfig:
    """Pacing of a source that answers an over-long or hasty request with nothing."""

    retries: int = 5
    pause: float = 1.0
    pause_after_error: float = 15.0
    timeout: float = 40.0
    fund_type: str = "EMK"
    base_url: str = ""


def month_chunks(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """Inclusive ranges of a month at most that cover [start, end]; each begins the day after the one before ends."""
    out, at, k = [], start, 0
    while at <= end:
        k += 1
        y, m = divmod(start.year * 12 + start.month - 1 + k, 12)
        nxt = dt.date(y, m + 1, min(start.day, (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day))
        out.append((at, min(nxt - dt.timedelta(days=1), end)))
        at = nxt
    return out


def payload(start: dt.date, end: dt.date, config: FetchConfig) -> dict:
    """Body of a request; dates as yyyymmdd."""
    return {"fontip": config.fund_type, "bastarih": start.strftime("%Y%m%d"), "bittarih": end.strftime("%Y%m%d"), "fonkod": "", "fonturkod": "", "fongrup": "", "fonunvantip": "", "sfontur": "", "kurucukod": "", "islem": 1, "dil": "TR"}


def post(url: str, body: dict, timeout: float) -> list[dict]:
    """Rows of one answer; an error for any status but 200."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if answer.status != 200:
            raise OSError(f"status {answer.status}")
        return json.loads(answer.read()).get("data", [])


class NoAnswer(RuntimeError):
    """A period that never answered, or only with nothing although it must have rows."""


def ask(kind: str, start: dt.date, end: dt.date, config: FetchConfig, transport: Callable = post, sleep: Callable = time.sleep) -> list[dict] | None:
    """Rows of one month and kind (general or allocation); None after the last failure."""
    for attempt in range(config.retries):
        try:
            rows = transport(f"{config.base_url}/{kind}", payload(start, end, config), config.timeout)
            sleep(config.pause)
            return rows
        except Exception:
            if attempt + 1 < config.retries:
                sleep(config.pause_after_error)
    return None


def fetch_period(kind: str, start: dt.date, end: dt.date, config: FetchConfig, transport: Callable = post, sleep: Callable = time.sleep) -> list[dict]:
    """Rows of one month; none after the last failure. Use ``fetch_complete`` where a hole matters."""
    return ask(kind, start, end, config, transport, sleep) or []


def may_be_empty(start: dt.date, end: dt.date, today: dt.date) -> bool:
    """A period that begins today or later, or that holds only days of a weekend, may rightly have no rows."""
    return start >= today or all((start + dt.timedelta(days=i)).weekday() > 4 for i in range((end - start).days + 1))


def fetch_complete(kind: str, start: dt.date, end: dt.date, config: FetchConfig, today: dt.date, rounds: int = 4, wait: float = 60.0, transport: Callable = post, sleep: Callable = time.sleep) -> list[dict]:
    """Rows of one month, asked for again while the answer is missing or empty; NoAnswer if it stays so.

    A source that limits requests answers with nothing, so an empty answer says no more than a failure.
    """
    for turn in range(rounds):
        rows = ask(kind, start, end, config, transport, sleep)
        if rows or (rows is not None and may_be_empty(start, end, today)):
            return rows
        if turn + 1 < rounds:
            sleep(wait)
    raise NoAnswer(f"no answer for {kind} of {start} to {end}")


def fetch_strict(kind: str, start: dt.date, end: dt.date, config: FetchConfig, today: dt.date, rounds: int = 4, wait: float = 60.0, transport: Callable = post, sleep: Callable = time.sleep) -> list[dict]:
    """All months, each complete; NoAnswer names the first that isn't."""
    return [r for a, b in month_chunks(start, end) for r in fetch_complete(kind, a, b, config, today, rounds, wait, transport, sleep)]


class Month(InputPartition):
    def __init__(self, start: dt.date, end: dt.date) -> None:
        self.start, self.end = start, end


class FundSource(DataSource):
    """Format ``fund_api``: options kind, start, end, base_url, fund_type; rows as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "fund_api"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return FundReader(self.options)


class FundReader(DataSourceReader):
    transport: Callable = staticmethod(post)

    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Month]:
        return [Month(a, b) for a, b in month_chunks(dt.date.fromisoformat(self.options["start"]), dt.date.fromisoformat(self.options["end"]))]

    def read(self, partition: Month):
        o = self.options
        config = FetchConfig(base_url=o.get("base_url", ""), fund_type=o.get("fund_type", "EMK"), retries=int(o.get("retries", 5)), pause=float(o.get("pause", 1)), pause_after_error=float(o.get("pause_after_error", 15)))
        kind = o.get("kind", "general")
        if o.get("strict", "true") == "true":  # a month without an answer fails the job, it leaves no hole
            rows = fetch_complete(kind, partition.start, partition.end, config, dt.date.fromisoformat(o.get("today", str(dt.date.today()))), int(o.get("rounds", 4)), float(o.get("wait", 60)), self.transport)
        else:
            rows = fetch_period(kind, partition.start, partition.end, config, self.transport)
        for row in rows:
            yield (json.dumps(row, ensure_ascii=False),)


def read_api(spark: SparkSession, start: str, end: str, base_url: str, fund_type: str = "EMK", strict: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """General and allocation over HTTP, repeated rows once; with ``strict`` a month that never answers is an error.

    Rows are parsed once, as maps; their fields are the columns of the general table, or the instrument codes.
    """
    from terazi.metadata import ROWS
    from terazi.sources.readers import NAMES, canonical_allocation, canonical_general

    spark.dataSource.register(FundSource)

    def rows(kind: str, fields: list[str]) -> DataFrame:
        text = spark.read.format("fund_api").options(kind=kind, start=start, end=end, base_url=base_url, fund_type=fund_type, strict=str(strict).lower(), **{k: str(v) for k, v in options.items()}).load().distinct()
        lower = F.transform_keys(F.from_json("payload", "map<string,string>"), lambda k, _: F.lower(k))
        return text.select(lower.alias("m")).select(*(F.element_at("m", F.lit(f)).alias(f) for f in fields))

    general = rows("general", list(NAMES))
    codes = [r[0].lower() for r in ROWS]
    allocation = rows("allocation", ["fonkodu", "tarih", *codes])
    return canonical_general(general), canonical_allocation(allocation)


def last_years(spark: SparkSession, years: int, end: dt.date, base_url: str, fund_type: str = "EMK") -> tuple[DataFrame, DataFrame]:
    from terazi.sources.store import update_start

    return read_api(spark, str(update_start(None, end, years=years)), str(end), base_url, fund_type)
