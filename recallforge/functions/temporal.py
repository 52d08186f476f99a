"""Temporal expressions: of questions, once per question on the driver or as a pandas
UDF over a column; and of typed spans, normalised to intervals.

``parse`` reads a question: the first form that fits, in the order of FORMS, gives
start and end (both inclusive), recency and ordinal.  ``normalise`` maps typed spans
(as an entity extractor tags them) to half-open intervals.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, functions as F

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {m: k for k, m in enumerate(_MONTHS, 1)} | {m[:3]: k for k, m in enumerate(_MONTHS, 1)} | {"sept": 9}
_TEENS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
_NUMBER = {w: k for k, w in enumerate(_TEENS, 1)} | {"thirty": 30}
_N = r"(\d+|" + "|".join(_NUMBER) + ")"
_M = "(" + "|".join(m for m in _MONTH if m != "sept") + ")"
_DAY, _SECOND = timedelta(days=1), timedelta(seconds=1)


def _count(word: str) -> int:
    return int(word) if word.isdigit() else _NUMBER[word]


def _midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _days(start: datetime, n: int = 1) -> tuple[datetime, datetime]:
    """``n`` whole days, to their last second."""
    return start, start + n * _DAY - _SECOND


def _months(year: int, month: int, n: int = 1) -> tuple[datetime, datetime]:
    """``n`` whole months from one that may lie outside the year."""
    a, b = year * 12 + month - 1, year * 12 + month - 1 + n
    return datetime(a // 12, a % 12 + 1, 1), datetime(b // 12, b % 12 + 1, 1) - _SECOND


def _until(span: tuple[datetime, datetime], low: str, now: datetime) -> tuple[datetime, datetime]:
    return (span[0], now) if re.search(r"\bsince\b", low) else span


def _last_week(now: datetime) -> tuple[datetime, datetime]:
    monday = _midnight(now) - now.weekday() * _DAY
    return _days(monday - 7 * _DAY, 7)


def _weeks_ago(n: int, now: datetime) -> tuple[datetime, datetime]:
    at = now - timedelta(weeks=n)
    return _days(_midnight(at) - at.weekday() * _DAY, 7)


def _named_month(m: re.Match, low: str, now: datetime) -> tuple[datetime, datetime]:
    """Without a year the month is past: one that is still to come, or has just
    begun, is last year's."""
    month = _MONTH[m[1]]
    ahead = month > now.month or (month == now.month and now.day < 15)
    return _until(_months(int(m[2]) if m[2] else now.year - ahead, month), low, now)


def _quarter(now: datetime, back: int) -> tuple[datetime, datetime]:
    return _months(now.year, 3 * ((now.month - 1) // 3 - back) + 1, 3)


#: Form, and what it means: a span, given the match, the question and the moment.
FORMS = (
    (r"\byesterday\b", lambda m, low, now: _days(_midnight(now) - _DAY)),
    (r"\btoday\b", lambda m, low, now: (_midnight(now), now)),
    (rf"\b{_N}\s+days?\s+ago\b", lambda m, low, now: _days(_midnight(now - _count(m[1]) * _DAY))),
    (r"\blast\s+week\b", lambda m, low, now: _last_week(now)),
    (rf"\b{_N}\s+weeks?\s+ago\b", lambda m, low, now: _weeks_ago(_count(m[1]), now)),
    (r"\blast\s+month\b", lambda m, low, now: _months(now.year, now.month - 1)),
    (rf"\b{_N}\s+months?\s+ago\b", lambda m, low, now: _months(now.year, now.month - _count(m[1]))),
    (rf"\b(?:in|since|during|from)\s+{_M}(?:\s+(\d{{4}}))?\b", _named_month),
    (r"\b(?:in|during|from|since)\s+(\d{4})\b", lambda m, low, now: _until(_months(int(m[1]), 1, 12), low, now)),
    (r"\bq([1-4])\s*(\d{4})?\b", lambda m, low, now: _months(int(m[2] or now.year), 3 * int(m[1]) - 2, 3)),
    (r"\bthis\s+quarter\b", lambda m, low, now: _quarter(now, 0)),
    (r"\blast\s+quarter\b", lambda m, low, now: _quarter(now, 1)),
    (rf"\b(?:last|past)\s+{_N}\s+days?\b", lambda m, low, now: (_midnight(now - _count(m[1]) * _DAY), now)),
)
_RECENT = r"\b(latest|most\s+recent|current(?:ly)?|newest|up\s*to\s*date)\b"
_FIRST = r"\b(first|initial|earliest|original)\b"


def parse(text: str | None, now: datetime) -> dict | None:
    """start, end, recency, ordinal of a question; None without a temporal form.  A
    recency word means the last 48 hours and the newest; an ordinal has no range."""
    low = (text or "").lower().strip()
    if re.search(_RECENT, low):
        return {"start": now - 2 * _DAY, "end": now, "recency": True, "ordinal": "last"}
    if re.search(_FIRST, low):
        return {"start": None, "end": None, "recency": False, "ordinal": "first"}
    for form, means in FORMS:
        if m := re.search(form, low):
            try:
                start, end = means(m, low, now)
            except (ValueError, OverflowError):  # a year that no calendar has
                return None
            return {"start": start, "end": end, "recency": False, "ordinal": None}
    return None


def reference(text: Column, now: datetime) -> Column:
    """struct<start, end, recency, ordinal> of each question; null where none."""

    @F.pandas_udf("start timestamp, end timestamp, recency boolean, ordinal string")
    def run(texts: pd.Series) -> pd.DataFrame:
        early, late = datetime(1700, 1, 1), datetime(2200, 1, 1)  # what pandas can hold, about
        rows = [parse(t, now) or {"start": None, "end": None, "recency": False, "ordinal": None} for t in texts]
        rows = [r | {k: min(max(r[k], early), late) if r[k] else None for k in ("start", "end")} for r in rows]
        frame = pd.DataFrame(rows, columns=["start", "end", "recency", "ordinal"])
        return frame.assign(start=pd.to_datetime(frame["start"]), end=pd.to_datetime(frame["end"]), recency=frame["recency"].astype(bool))

    return run(text)


# --- typed spans -----------------------------------------------------------------

# Which label of a span wins, words of small numbers, days of units, and
# phrases with their offset and length in days.
_LABELS = ("event anchor", "time of day", "end date", "start date", "duration", "relative date", "date")
_FEW = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "a couple of": 2, "a few": 3, "several": 3}
_UNIT_DAYS = {"second": 0, "minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
_PHRASES = {
    "today": (0, 1), "tonight": (0, 1), "yesterday": (-1, 1), "tomorrow": (1, 1),
    "this week": (0, 7), "last week": (-7, 7), "next week": (7, 7),
    "this weekend": (0, 2), "last weekend": (-7, 2), "next weekend": (7, 2), "upcoming weekend": (7, 2),
}
LEAST_CONFIDENCE = 0.3
HORIZON = timedelta(days=365 * 100)
_DURATION = re.compile(r"^\s*(a|an|one|two|three|four|five|six|seven|eight|nine|ten|a\s+couple\s+of|a\s+few|several|\d+)\s+(second|minute|hour|day|week|month|quarter|year)s?\s*$", re.I)
_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@dataclass(frozen=True)
class Span:
    text: str
    label: str
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class Interval:
    """Half-open; ``origin`` tells how it was read."""

    start: datetime
    end: datetime
    confidence: float
    origin: str


def duration_days(text: str) -> int | None:
    """Whole days of a bare duration; None for none, and for less than a day."""
    m = _DURATION.match(text or "")
    if not m:
        return None
    word = " ".join(m[1].lower().split())
    n = (int(word) if word.isdigit() else _FEW[word]) * _UNIT_DAYS[m[2].lower()]
    return n or None


def _calendar_day(text: str, ref: datetime, prefer: int = 0) -> datetime | None:
    """The day that a text names: ISO, day and month in either order, a weekday, an
    amount of time ago or ahead, or a phrase; ``prefer`` -1 the past, 1 the future."""
    low = " ".join(text.lower().replace(",", " ").split())
    try:
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ].*)?", low):
            return datetime(int(m[1]), int(m[2]), int(m[3]))
        names = "|".join(sorted(_MONTH, key=len, reverse=True))
        m = re.fullmatch(rf"(?P<m>{names})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?: (?P<y>\d{{4}}))?", low) or re.fullmatch(rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?: of)? (?P<m>{names})\.?(?: (?P<y>\d{{4}}))?", low)
        if m:
            day = datetime(int(m["y"] or ref.year), _MONTH[m["m"]], int(m["d"]))
            if not m["y"] and prefer:
                ahead = day > _midnight(ref)
                day = day.replace(year=day.year + (prefer > 0 and not ahead) - (prefer < 0 and ahead))
            return day
        if m := re.fullmatch(rf"(?P<m>{names})(?: (?P<y>\d{{4}}))?", low):
            year, month = int(m["y"] or ref.year), _MONTH[m["m"]]
            if not m["y"] and prefer:
                year += (prefer > 0 and month <= ref.month) - (prefer < 0 and month > ref.month)
            return datetime(year, month, min(ref.day, calendar.monthrange(year, month)[1]))
    except ValueError:
        return None
    if low in _WEEKDAYS:
        back = (ref.weekday() - _WEEKDAYS.index(low)) % 7
        return _midnight(ref) + ((7 - back) if prefer > 0 else -(back or 7)) * _DAY
    if m := re.fullmatch(r"(?:in )?(.+?)(?: (ago|from now|later))?", low):
        if (m[2] or low.startswith("in ")) and (n := duration_days(m[1])):
            return _midnight(ref) + (-n if m[2] == "ago" else n) * _DAY
    if low in _PHRASES:
        return _midnight(ref) + _PHRASES[low][0] * _DAY
    return None


def _first_of(ref: datetime, months: int) -> datetime:
    k = ref.year * 12 + ref.month - 1 + months
    return datetime(k // 12, k % 12 + 1, 1)


def _absolute(text: str, ref: datetime) -> Interval | None:
    """A date; a year, month or quarter alone is its whole container."""
    low = text.lower().strip()
    if re.fullmatch(r"\d{4}", low):
        return Interval(datetime(int(low), 1, 1), datetime(int(low) + 1, 1, 1), 0.95, "date:year") if 0 < int(low) < 9999 else None
    if m := re.fullmatch(r"([a-z]+)\s*[,/\- ]\s*(\d{4})", low):
        if m[1] in _MONTH:
            start = datetime(int(m[2]), _MONTH[m[1]], 1)
            return Interval(start, _first_of(start, 1), 0.92, "date:year-month")
    if m := re.fullmatch(r"q([1-4])\s*[/\- ]\s*(\d{4})", low):
        start = datetime(int(m[2]), 3 * int(m[1]) - 2, 1)
        return Interval(start, _first_of(start, 3), 0.9, "date:quarter")
    day = _calendar_day(text, ref)
    return Interval(day, day + _DAY, 0.88, "date:absolute") if day else None


def _relative(text: str, ref: datetime) -> Interval | None:
    low = " ".join(text.lower().split())
    if m := re.fullmatch(r"(this|last|next) (month|year)", low):
        step = {"this": 0, "last": -1, "next": 1}[m[1]]
        start = _first_of(ref, step) if m[2] == "month" else datetime(ref.year + step, 1, 1)
        end = _first_of(start, 1) if m[2] == "month" else datetime(start.year + 1, 1, 1)
        return Interval(start, end, 0.9, f"relative:{m[1]}-{m[2]}")
    if low in _PHRASES:
        offset, n = _PHRASES[low]
        start = _midnight(ref) + offset * _DAY
        return Interval(start, start + n * _DAY, 0.9, "relative:canonical")
    if m := re.fullmatch(r"(next|upcoming|coming|this|last|previous|past) (.+)", low):
        prefer = 1 if m[1] in ("next", "upcoming", "coming") else -1 if m[1] in ("last", "previous", "past") else 0
        if day := _calendar_day(m[2], ref, prefer):
            return Interval(day, day + _DAY, 0.85, "relative:modifier")
    day = _calendar_day(text, ref)
    return Interval(day, day + _DAY, 0.7, "relative:fallback") if day else None


def _bounded(text: str, ref: datetime, label: str) -> Interval | None:
    """From a start date to the reference, or from the horizon to an end date."""
    lead = r"^(since|starting|from|as\s+of|after)\s+" if label == "start date" else r"^(until|through|by|before|to)\s+"
    day = _calendar_day(re.sub(lead, "", text, flags=re.I).strip(), ref)
    if day is None:
        return None
    return Interval(day, ref, 0.82, "start-date") if label == "start date" else Interval(ref - HORIZON, day + _DAY, 0.8, "end-date")


def _read(span: Span, ref: datetime) -> Interval | timedelta | None:
    text = (span.text or "").strip()
    if not text:
        return None
    if span.label == "date":
        return _absolute(text, ref)
    if span.label == "relative date":
        return _relative(text, ref)
    if span.label == "duration":
        n = duration_days(text)
        return timedelta(days=n) if n else None
    if span.label in ("start date", "end date"):
        return _bounded(text, ref, span.label)
    return None  # times of day and event anchors name no interval


def normalise(spans: Iterable[Span], ref: datetime) -> list[Interval]:
    """Intervals of typed spans.  Of spans at one place the label of most weight
    counts; a duration widens the anchor read before it and goes; what is unsure,
    beyond a hundred years, or empty goes too."""
    placed: dict[tuple[int, int], Span] = {}
    loose: list[Span] = []
    rank = lambda s: _LABELS.index(s.label) if s.label in _LABELS else -1
    for s in spans:
        at = (s.start, s.end)
        if at == (0, 0):
            if not any(u.text == s.text and u.label == s.label for u in loose):
                loose.append(s)
        elif at not in placed or rank(s) > rank(placed[at]):
            placed[at] = s
    out: list[Interval] = []
    anchored = False
    for s in [*loose, *placed.values()]:
        got = _read(s, ref)
        if isinstance(got, timedelta):
            if anchored:
                a = out[-1]
                out[-1] = Interval(a.start, a.start + got, min(a.confidence, 0.75), f"{a.origin}+duration")
        elif got is not None:
            out.append(got)
            anchored = True
    return [i for i in out if i.confidence >= LEAST_CONFIDENCE and i.start >= ref - HORIZON and i.end <= ref + HORIZON and i.start < i.end]


def merge(intervals: list[tuple[datetime, datetime, float]], least: float = LEAST_CONFIDENCE) -> tuple[datetime, datetime, float] | None:
    """The hull of half-open intervals of enough confidence, with the best one's."""
    kept = [i for i in intervals if i[2] >= least and i[0] < i[1]]
    return (min(i[0] for i in kept), max(i[1] for i in kept), max(i[2] for i in kept)) if kept else None


def query_range(spans: Iterable[Span], ref: datetime) -> tuple[list[str], tuple[datetime, datetime, float] | None]:
    """The entity names among a question's spans, and the hull of its temporal ones."""
    spans = list(spans)
    names = list(dict.fromkeys(s.text for s in spans if s.label not in _LABELS))
    found = normalise([s for s in spans if s.label in _LABELS], ref)
    return names, merge([(i.start, i.end, i.confidence) for i in found])


def intervals(spans: Column, ref: Column) -> Column:
    """struct<start, end, confidence> of each row's spans (array<struct<text, label,
    start, end>>) against its own reference time: their hull, null where none."""

    @F.pandas_udf("start timestamp, end timestamp, confidence double")
    def run(rows: pd.Series, refs: pd.Series) -> pd.DataFrame:
        out = []
        for found, at in zip(rows, refs, strict=True):
            hull = None
            if found is not None and not pd.isna(at):
                read = normalise([Span(s["text"], s["label"], s["start"] or 0, s["end"] or 0) for s in found], at.to_pydatetime())
                hull = merge([(i.start, i.end, i.confidence) for i in read])
            out.append(hull or (None, None, None))
        frame = pd.DataFrame(out, columns=["start", "end", "confidence"])
        return frame.assign(start=pd.to_datetime(frame["start"]), end=pd.to_datetime(frame["end"]), confidence=frame["confidence"].astype("float64"))

    return run(spans, ref)
