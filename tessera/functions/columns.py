"""Column expressions.

Every function here returns a ``Column`` made only of built-in Spark
expressions, so it stays inside whole-stage codegen and runs on executors.
Missing-value conventions (see README): R-style "missing" includes NaN, so
numbers coming from text go through :func:`to_number`, which maps failed casts
and NaN to null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- numbers

def nan_to_null(col) -> Column:
    """NaN -> null (Spark orders NaN above every number and lets it poison avg)."""
    c = _c(col)
    return F.nanvl(c, F.lit(None).cast("double"))


def to_number(col) -> Column:
    """Text or number -> double; unparseable text and NaN become null.

    ``try_cast`` keeps ANSI mode from failing the job on one bad cell.
    """
    c = _c(col)
    return nan_to_null(c.try_cast("double"))


def is_missing(col, numeric: bool = True) -> Column:
    c = _c(col)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


# ---------------------------------------------------------------- bands

# The default banding of a prevalence (percent) indicator.
# Ordered upper cuts (exclusive) and the label of each band; a value at or
# above the last cut takes the last label.
DEFAULT_CUTS = (10.0, 20.0, 30.0, 40.0)
DEFAULT_LABELS = ("Very Low", "Low", "Moderate", "High", "Very High")


def classify_bands(col, cuts: Sequence[float] = DEFAULT_CUTS,
                   labels: Sequence[str] = DEFAULT_LABELS) -> Column:
    """Ordered ``<`` cuts; lower edge inclusive; null stays null (B-1)."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cuts")
    c = _c(col)
    expr = None
    for cut, label in zip(cuts, labels[:-1]):
        expr = F.when(c < F.lit(cut), F.lit(label)) if expr is None else expr.when(c < F.lit(cut), F.lit(label))
    last = F.lit(labels[-1])
    return expr.when(c.isNotNull(), last) if expr is not None else F.when(c.isNotNull(), last)


def rag_status(col, amber: float, green: float, higher_is_better: bool = True) -> Column:
    """Red/Amber/Green traffic light of a KPI value (B-21); null -> 'Red' is
    not assumed: a missing value is 'Grey'."""
    c = _c(col)
    if higher_is_better:
        return (F.when(c.isNull(), "Grey").when(c >= green, "Green")
                .when(c >= amber, "Amber").otherwise("Red"))
    return (F.when(c.isNull(), "Grey").when(c <= green, "Green")
            .when(c <= amber, "Amber").otherwise("Red"))


# ---------------------------------------------------------------- dates

def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a timestamp's wall-clock time.

    Computed on TIMESTAMP_NTZ with ``timestamp_diff``, so durations do not
    depend on the session time zone (no daylight-saving hour appears)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(col).cast("timestamp_ntz"))


def from_epoch_micros(col) -> Column:
    """Inverse of :func:`epoch_micros`: a TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(col), _epoch())


# Fixed value: the shape of a due date, with nothing before or after it.
DUE_PATTERN = r"^\d{4}-\d{2}-\d{2}\z"


def parse_due_date(col) -> Column:
    """``YYYY-MM-DD`` text -> end of that day (timestamp without zone) (B-2).

    Follows calendar roll-over of the source's date constructor: month 13 is
    January of the next year, Feb 31 is early March, day 0 is the last day of
    the previous month; years 0..99 mean 1900..1999. Text not matching the
    pattern (blanks around it included) gives null.
    """
    c = _c(col)
    ok = c.rlike(DUE_PATTERN)
    y = F.substring(c, 1, 4).cast("int")
    m = F.substring(c, 6, 2).cast("int")
    d = F.substring(c, 9, 2).cast("int")
    year = F.when(y < 100, y + 1900).otherwise(y)
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), m - 1), d - 1)
    end = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59.999))
    return F.when(ok, end)


def is_overdue(done_col, due_col, now) -> Column:
    """False when done or the due text is empty/invalid, else ``due_end < now`` (B-3).

    ``now`` is a literal timestamp parameter, never ``current_timestamp()``
    inside a test.
    """
    due_end = parse_due_date(due_col)
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    return F.coalesce(~_c(done_col) & due_end.isNotNull() & (due_end < now_c), F.lit(False))


# ---------------------------------------------------------------- tags / text

# ASCII whitespace spelled out (Java's and RE2's ``\s`` differ on \x0B) and
# anchored with ``\z`` (Java's ``$`` also matches before a final newline).
WS_CLASS = r"[ \t\n\r\f\x0B]"
_WS_LEFT = r"^" + WS_CLASS + "+"
_WS_RIGHT = WS_CLASS + r"+\z"


def strip_ws(col) -> Column:
    """Trim all leading and trailing whitespace (``trim`` strips spaces only);
    one regex pass over the text."""
    return F.regexp_replace(_c(col), _WS_LEFT + "|" + _WS_RIGHT, "")


def normalize_tags(col, max_tags: int = 10) -> Column:
    """Comma text -> trimmed, non-empty, first-occurrence distinct, first ``max_tags`` (B-4).

    ``array_distinct`` keeps the first occurrence, so order is preserved.
    Null text gives an empty array.
    """
    parts = F.split(F.coalesce(_c(col), F.lit("")), ",")
    cleaned = F.filter(F.transform(parts, lambda t: strip_ws(t)), lambda t: t != "")
    return F.slice(F.array_distinct(cleaned), 1, max_tags)


def collapse_ws(col) -> Column:
    return F.regexp_replace(strip_ws(col), WS_CLASS + "+", " ")


def normalize_text(col) -> Column:
    """Trim, collapse inner whitespace, lower-case (B-25, definition chosen here).

    One regex pass: every whitespace run becomes one space (leading and
    trailing runs included), then the single edge spaces are trimmed, which
    equals stripping first and collapsing after."""
    return F.lower(F.trim(F.regexp_replace(_c(col), WS_CLASS + "+", " ")))


def parse_read_minutes(col) -> Column:
    """``'6m'`` -> 6; anything else -> null (B-14)."""
    return F.regexp_extract(strip_ws(col), r"^(\d+)m$", 1).try_cast("int")


# ---------------------------------------------------------------- export

# Leading characters that make a spreadsheet read a cell as a
# formula; such cells get a leading apostrophe on export.
FORMULA_LEADS = ("=", "+", "-", "@", "\t", "\r")


def csv_safe(col) -> Column:
    """Neutralise spreadsheet formulas: prefix ``'`` when the text starts with
    one of :data:`FORMULA_LEADS` (A-8)."""
    c = _c(col)
    pattern = "^[" + re.escape("".join(FORMULA_LEADS)) + "]"
    return F.when(c.rlike(pattern), F.concat(F.lit("'"), c)).otherwise(c)


# ---------------------------------------------------------------- names

def clean_name(name: str, seen: dict | None = None) -> str:
    """One column name -> snake_case (A-2).

    camelCase and acronym runs are split (``ISOCode`` -> ``iso_code``),
    every run of non-alphanumerics becomes ``_``, leading digits get an ``x``
    prefix, an empty name becomes ``x``.
    """
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df):
    """Rename every column of ``df`` to unique snake_case; duplicates get
    ``_2``, ``_3``... Metadata only: no job runs."""
    out, counts = [], {}
    for n in df.columns:
        base = clean_name(n)
        k = counts.get(base, 0) + 1
        counts[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return df.toDF(*out)
