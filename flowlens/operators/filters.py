"""The filter grammar of the pages, as Column expressions. All parts combine with AND."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.net import is_external

# Time ranges of the pages and protocol names of the filter box.
PRESETS = {
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
PRESET_NAMES = {
    "last_hour": "1h", "last_6_hours": "6h", "last_24_hours": "24h", "last_7_days": "7d",
    "last_30_days": "30d", "1d": "24h", "1m": "30d",
}
FILTER_PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1, "GRE": 47}
EXTERNAL_ONLY = "external_only"


def _wall_clock(value: datetime) -> Column:
    """A literal without a zone: compares as it is with such columns, else in the session zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


@dataclass(frozen=True)
class TimeWindow:
    """Inclusive at both ends; an open end is None."""

    since: datetime
    until: datetime | None = None

    def predicate(self, ts: str = "timestamp", ym: str | None = None) -> Column:
        """With `ym`, the month bounds are added so that partitions are pruned, too."""
        column = F.col(ts)
        inside = column >= _wall_clock(self.since)
        if self.until is not None:
            inside &= column <= _wall_clock(self.until)
        if ym is not None:
            inside &= F.col(ym) >= self.since.year * 100 + self.since.month
            if self.until is not None:
                inside &= F.col(ym) <= self.until.year * 100 + self.until.month
        return inside


def preset_window(name: str, as_of: datetime) -> TimeWindow:
    """A named range up to `as_of`; an unknown name means the last hour."""
    name = name.lower()
    return TimeWindow(as_of - PRESETS[PRESET_NAMES.get(name, name if name in PRESETS else "1h")], as_of)


def _minute(text: str | None) -> datetime | None:
    try:
        return datetime.strptime(text or "", "%Y-%m-%dT%H:%M")
    except ValueError:
        return None


def custom_window(
    start: str | None, end: str | None, as_of: datetime, open_end: bool = True
) -> TimeWindow:
    """Range from `YYYY-MM-DDTHH:MM` texts.

    Log page (`open_end`): a bad start means the last hour, a bad end leaves the end open.
    Summary page: anything bad means the last hour.
    """
    since, until = _minute(start), _minute(end)
    hour = preset_window("1h", as_of)
    if open_end:
        return TimeWindow(since or hour.since, until)
    return TimeWindow(since, until) if since and until else hour


def port_predicate(column: str, grammar: str) -> Column | None:
    """`n`, `a-b` (inclusive) or `a,b,c`; anything malformed is no filter."""
    text = grammar.strip()
    if "-" in text:
        try:
            low, high = (int(part) for part in text.split("-"))
        except ValueError:
            return None
        return F.col(column).between(low, high)
    if "," in text:
        ports = [int(p) for p in (part.strip() for part in text.split(",")) if p.isdecimal()]
        return F.col(column).isin(ports) if ports else None
    return F.col(column) == int(text) if text.isdecimal() else None


def protocol_predicate(column: str, text: str) -> Column | None:
    """Name (any case) or number; other text is no filter."""
    number = FILTER_PROTOCOLS.get(text.upper(), int(text) if text.isdecimal() else None)
    return None if number is None else F.col(column) == number


def contains_ci(column: str, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def any_contains(columns: list[str], needle: str, ignore_case: bool) -> Column:
    """The text, taken literally, in any of the columns."""
    found = F.lit(False)
    for name in columns:
        found |= contains_ci(name, needle) if ignore_case else F.contains(name, F.lit(needle))
    return found


def not_blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def between_digits(value: Column, low: str, high: str) -> list[Column]:
    """Bounds given as digit strings; others do not count."""
    parts = []
    if low.isdecimal():
        parts.append(value >= int(low))
    if high.isdecimal():
        parts.append(value <= int(high))
    return parts


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out &= part
    return out


@dataclass(frozen=True)
class FilterSpec:
    """Filters of the traffic log pages; blank fields do not filter. Columns are the unified ones."""

    window: TimeWindow | None = None
    src_ip: str = ""
    dst_ip: str = ""
    src_port: str = ""
    dst_port: str = ""
    action: str = ""
    device_name: str = ""
    app_category: str = ""
    hostname: str = ""
    src_user: str = ""
    dst_country: str = ""
    protocol: str = ""
    search: str = ""
    min_bytes: str = ""
    max_bytes: str = ""
    min_duration: str = ""
    max_duration: str = ""
    log_source: str = ""
    include_threats: bool = False

    SEARCHED = ("src_ip", "dst_ip", "hostname", "src_user", "app_category")
    EQUAL = (
        "dst_ip", "action", "device_name", "app_category", "hostname", "src_user", "dst_country",
    )

    def predicate(self, ts: str = "timestamp", ym: str | None = None) -> Column:
        parts = [] if self.window is None else [self.window.predicate(ts, ym)]
        if self.src_ip == EXTERNAL_ONLY:
            parts.append(is_external(F.col("src_ip")))
        elif self.src_ip:
            parts.append(F.col("src_ip") == self.src_ip)
        parts += [F.col(c) == getattr(self, c) for c in self.EQUAL if getattr(self, c)]
        parts += [
            p
            for p in (
                port_predicate("src_port", self.src_port),
                port_predicate("dst_port", self.dst_port),
                protocol_predicate("protocol", self.protocol),
            )
            if p is not None
        ]
        if self.search:
            parts.append(any_contains(list(self.SEARCHED), self.search, ignore_case=False))
        total = F.col("bytes_sent") + F.col("bytes_received")
        parts += between_digits(total, self.min_bytes, self.max_bytes)
        parts += between_digits(F.col("elapsed_time"), self.min_duration, self.max_duration)
        return _all(parts)

    def source_predicate(self) -> Column:
        """One source when named; otherwise all but the threats unless they are asked for."""
        if self.log_source:
            return F.col("log_source") == self.log_source
        return F.lit(True) if self.include_threats else F.col("log_source") != "threats"

    def apply(self, df: DataFrame, ts: str = "timestamp", ym: str | None = None) -> DataFrame:
        """Filter the unified frame once; Catalyst pushes the predicates into each source."""
        chosen = df.where(self.source_predicate()) if "log_source" in df.columns else df
        return chosen.where(self.predicate(ts, ym))


@dataclass(frozen=True)
class UrlFilterSpec:
    """Filters of the web-access page."""

    window: TimeWindow | None = None
    url: str = ""
    url_domain: str = ""
    url_category: str = ""
    action: str = ""
    source_address: str = ""
    destination_address: str = ""
    source_user: str = ""
    device_name: str = ""
    http_method: str = ""
    response_code: str = ""
    application: str = ""
    search: str = ""

    SEARCHED = ("url", "url_domain", "source_user", "user_agent", "rule_name")
    EQUAL = ("url_category", "action", "source_address", "destination_address", "http_method")
    WITHIN = ("url", "url_domain", "source_user", "device_name", "application")

    def predicate(self, ts: str = "timestamp", ym: str | None = None) -> Column:
        parts = [] if self.window is None else [self.window.predicate(ts, ym)]
        parts += [F.col(c) == getattr(self, c) for c in self.EQUAL if getattr(self, c)]
        parts += [contains_ci(c, getattr(self, c)) for c in self.WITHIN if getattr(self, c)]
        if self.response_code.isdecimal():
            parts.append(F.col("response_code") == int(self.response_code))
        if self.search:
            parts.append(any_contains(list(self.SEARCHED), self.search, ignore_case=True))
        return _all(parts)

    def apply(self, df: DataFrame, ts: str = "timestamp", ym: str | None = None) -> DataFrame:
        return df.where(self.predicate(ts, ym))
