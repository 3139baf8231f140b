"""Period logic: ISO weeks, months, period ranges.

Two layers:

* Column expressions (``week_start_of``, ``iso_week_text`` ...) for work on
  whole tables; all are built-in Spark expressions and stay inside whole-stage
  codegen.
* Python resolvers (``week_range``, ``period_range`` ...) for the request
  parameters of one report; they turn request text into two date literals
  before planning, so the range filter reaches the parquet scan.

Semantics kept from the data model: ``week_number`` is the ISO week but
``year_number`` is the calendar year (2024-12-30 is year 2024, week 1), and a
week text ``YYYY-Www`` is not range-checked: week 00 is the week before week
01 and week 99 rolls into the next year.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted request formats and label texts.
DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
MONTH_RE = r"^\d{4}-\d{2}$"
WEEK_RE = r"^\d{4}-W\d{2}$"
MONTH_NAMES = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
               "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")
WEEK_LABEL = "Semana"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- column expressions -------------------------------------------------------

def week_number(d) -> Column:
    """ISO-8601 week of a date."""
    return F.weekofyear(_c(d)).cast("int")


def month_number(d) -> Column:
    return F.month(_c(d)).cast("int")


def year_number(d) -> Column:
    """Calendar year (not the ISO week-year)."""
    return F.year(_c(d)).cast("int")


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(d)).cast("int")


def week_start_of(d) -> Column:
    """Monday of the ISO week of a date."""
    return F.trunc(_c(d), "week")


def iso_week_text(d) -> Column:
    """``YYYY-Www`` with the ISO week-year (``o-\\WW``)."""
    return F.concat(F.lpad(iso_year(d).cast("string"), 4, "0"), F.lit("-W"),
                    F.lpad(week_number(d).cast("string"), 2, "0"))


def week_start_from_parts(year: Column, week: Column) -> Column:
    """Monday of ISO week ``week`` of ISO year ``year``; weeks roll over."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.trunc(jan4, "week"), (week - 1) * 7)


def week_bounds_of_text(text) -> tuple[Column, Column]:
    """(Monday, Sunday) of a ``YYYY-Www`` text; NULL when the text is malformed."""
    t = _c(text)
    ok = t.rlike(WEEK_RE)
    y = F.when(ok, F.substring(t, 1, 4).cast("int"))
    w = F.when(ok, F.substring(t, 7, 2).cast("int"))
    start = week_start_from_parts(y, w)
    return start, F.date_add(start, 6)


def month_bounds_of_text(text) -> tuple[Column, Column]:
    """(first, last) day of a ``YYYY-MM`` text; NULL for malformed or impossible months."""
    t = _c(text)
    first = F.when(t.rlike(MONTH_RE), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    return first, F.last_day(first)


def valid_or_default(text, pattern: str, default: str) -> Column:
    """Syntactic check of request text, falling back to ``default``."""
    t = _c(text)
    return F.when(t.isNotNull() & t.rlike(pattern), t).otherwise(F.lit(default))


def month_label(d) -> Column:
    """``Marzo 1997`` for a date."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.concat(F.element_at(names, F.month(_c(d))), F.lit(" "), F.year(_c(d)).cast("string"))


def month_key(d) -> Column:
    """Zero-padded ``YYYY-MM`` of a date."""
    return F.date_format(_c(d), "yyyy-MM")


def with_period_columns(df: DataFrame, date_col: str = "entry_date") -> DataFrame:
    """Recompute week_number / month_number / year_number from the entry date."""
    return (df.withColumn("week_number", week_number(date_col))
              .withColumn("month_number", month_number(date_col))
              .withColumn("year_number", year_number(date_col)))


def normalize_entry_date(df: DataFrame, week_text_col: str = "entry_week") -> DataFrame:
    """A weekly load is dated on the Monday of its week; a daily load keeps its
    date and gets the ISO week text of that date."""
    weekly = F.col("period_type") == "week"
    start, _ = week_bounds_of_text(week_text_col)
    return (df.withColumn("entry_date", F.when(weekly, start).otherwise(F.col("entry_date")))
              .withColumn(week_text_col, F.when(weekly, F.col(week_text_col))
                          .otherwise(iso_week_text("entry_date"))))


def request_bounds(kind, date_text, week_text, month_text, as_of: dt.date) -> tuple[Column, Column, Column]:
    """(kind, first day, last day) of requested periods, row by row.

    An unknown kind is a week; a text that is no date, week or month means the
    period of ``as_of``; a date that does not exist gives NULL bounds (no days).
    """
    asked = F.when(_c(kind).isin("day", "week", "month"), _c(kind)).otherwise(F.lit("week"))
    day = F.try_to_date(valid_or_default(date_text, DATE_RE, valid_date_or_today(None, as_of)), "yyyy-MM-dd")
    week = week_bounds_of_text(valid_or_default(week_text, WEEK_RE, valid_week_or_current(None, as_of)))
    month = month_bounds_of_text(valid_or_default(month_text, MONTH_RE, valid_month_or_current(None, as_of)))
    pick = lambda i: F.when(asked == "day", day).when(asked == "week", week[i]).otherwise(month[i])
    return asked, pick(0), pick(1)


# --- request parameter resolution (driver side, scalars only) ---------------

@dataclass(frozen=True)
class PeriodRange:
    start: dt.date
    end: dt.date
    label: str

    @property
    def start_s(self) -> str:
        return self.start.isoformat()

    @property
    def end_s(self) -> str:
        return self.end.isoformat()


def _today(as_of: dt.date | None) -> dt.date:
    return as_of or dt.date.today()


def valid_date_or_today(text: str | None, as_of: dt.date | None = None) -> str:
    if text and re.match(DATE_RE, text):
        return text
    return _today(as_of).isoformat()


def valid_month_or_current(text: str | None, as_of: dt.date | None = None) -> str:
    if text and re.match(MONTH_RE, text):
        return text
    return _today(as_of).strftime("%Y-%m")


def valid_week_or_current(text: str | None, as_of: dt.date | None = None) -> str:
    if text and re.match(WEEK_RE, text):
        return text
    y, w, _ = _today(as_of).isocalendar()
    return f"{y:04d}-W{w:02d}"


def week_range(text: str, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    text = valid_week_or_current(text, as_of)
    y, w = int(text[:4]), int(text[6:8])
    jan4 = dt.date(y, 1, 4)
    start = jan4 - dt.timedelta(days=jan4.weekday()) + dt.timedelta(weeks=w - 1)
    return start, start + dt.timedelta(days=6)


def month_range(text: str, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    text = valid_month_or_current(text, as_of)
    first = dt.date(int(text[:4]), int(text[5:7]), 1)
    nxt = dt.date(first.year + (first.month == 12), first.month % 12 + 1, 1)
    return first, nxt - dt.timedelta(days=1)


def date_text(d: dt.date) -> str:
    return d.strftime("%d/%m/%Y")


def period_range(period: str, date: str | None = None, week: str | None = None,
                 month: str | None = None, as_of: dt.date | None = None,
                 week_dates: bool = False) -> PeriodRange:
    """Resolve a (day | week | month) selection to an inclusive date range.

    ``week_dates``: label a week by its first and last day (the report)
    instead of its number (panel and rosters). A date that passes the syntax
    check but does not exist gives an empty range, labelled by its text.
    """
    period = period if period in ("day", "week", "month") else "week"
    text = {"day": valid_date_or_today(date, as_of), "week": valid_week_or_current(week, as_of),
            "month": valid_month_or_current(month, as_of)}[period]
    try:
        if period == "day":
            d = dt.date.fromisoformat(text)
            return PeriodRange(d, d, date_text(d))
        if period == "week":
            s, e = week_range(text, as_of)
            label = f"{date_text(s)} - {date_text(e)}" if week_dates else f"{WEEK_LABEL} {text[6:]}, {text[:4]}"
            return PeriodRange(s, e, label)
        s, e = month_range(text, as_of)
        return PeriodRange(s, e, f"{MONTH_NAMES[s.month - 1]} {s.year}")
    except (ValueError, OverflowError):
        return PeriodRange(dt.date(1970, 1, 2), dt.date(1970, 1, 1), text)
