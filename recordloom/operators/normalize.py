"""Keys, enumerations and lifetimes of records.

Null scopes and blank ones are "default"; a blank subject is null. Unknown types and sources are told
apart by guards and never coerced, except on import. Lifetimes: identity and preference last for ever,
project 90 days, state 2 days; an untyped record never expires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import blank_to_null, trim

# Fixed values.
TYPES = ["identity", "project", "preference", "state"]
SOURCES = ["agent-inferred", "user-confirmed", "user-explicit"]
STATUSES = ["active", "superseded"]
DEFAULT_SCOPE = "default"
TTL_DAYS = {"identity": None, "preference": None, "project": 90.0, "state": 2.0}
GRACE_DAYS = 30.0
DUPLICATE_AT, RELATED_AT, SEMANTIC_AT, LEXICAL_AT = 0.88, 0.60, 0.35, 0.10
SHORT_LIFE_DAYS = 7
LEAST_PREFIX = 8


def days_setting(value: str | float | None, default: float | None) -> float | None:
    """Days of a setting; never, none and off mean without end, junk and negative numbers the default."""
    if value is None or str(value).strip() == "":
        return default
    text = str(value).strip().lower()
    if text in ("never", "none", "off"):
        return None
    try:
        days = float(text)
    except ValueError:
        return default
    return days if 0 <= days < float("inf") else default


def truthy(value: object) -> bool:
    """A flag as callers write it."""
    return str(value).strip().lower() in ("1", "true", "yes", "on")


def limit_setting(value: object, default: int = 5) -> int:
    """A positive whole number, else the default."""
    text = str(value).strip()
    return int(text) if text.isascii() and text.isdigit() and int(text) > 0 else default


@dataclass(frozen=True)
class Policy:
    """Lifetimes in days by type (None: for ever), grace before removal, and the duplicate threshold."""

    ttl_days: dict[str, float | None] = field(default_factory=lambda: dict(TTL_DAYS))
    grace_days: float = GRACE_DAYS
    duplicate_at: float = DUPLICATE_AT

    @staticmethod
    def of(settings: dict[str, str]) -> Policy:
        """From settings named ttl_<type>, grace and duplicate_at."""
        ttl = {t: days_setting(settings.get(f"ttl_{t}"), d) for t, d in TTL_DAYS.items()}
        grace = days_setting(settings.get("grace"), GRACE_DAYS)
        try:
            at = float(settings.get("duplicate_at", DUPLICATE_AT))
        except ValueError:
            at = DUPLICATE_AT
        return Policy(ttl, GRACE_DAYS if grace is None else grace, at if 0 < at <= 1 else DUPLICATE_AT)


def scope_key(c: Column | str = "scope") -> Column:
    return F.coalesce(F.nullif(F.lower(trim(c)), F.lit("")), F.lit(DEFAULT_SCOPE))


def subject_key(c: Column | str = "subject") -> Column:
    """Lower case, hyphens for dots, underscores and spaces; null if nothing is left."""
    s = F.regexp_replace(F.lower(trim(c)), "[\\s\\u00A0._]+", "-")
    return F.nullif(F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-\\z", ""), F.lit(""))


def id_key(c: Column | str) -> Column:
    """An id without label, quotes and other characters that are no hexadecimal digits at its ends."""
    s = F.regexp_replace(F.lower(trim(c)), "^[\"'`(\\[<]*\\s*id\\s*[:=]\\s*", "")
    return F.regexp_replace(F.regexp_replace(s, "^[^0-9a-f]+", ""), "[^0-9a-f]+\\z", "")


def text_key(c: Column | str = "text") -> Column:
    return F.lower(trim(c))


def trust(c: Column | str = "source") -> Column:
    """1, 2, 3 for the sources in order; null for any other."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == SOURCES[0], 1).when(c == SOURCES[1], 2).when(c == SOURCES[2], 3)


def known_type(c: Column | str = "type") -> Column:
    """Whether a type is absent or known."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.isin(*TYPES)


def known_source(c: Column | str = "source") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin(*SOURCES), F.lit(False))


def first_text(*columns: str) -> Column:
    """The first that is not blank, of several names a caller may use for the text."""
    return F.coalesce(*(F.when(blank_to_null(c).isNotNull(), F.col(c)) for c in columns))


def plus_days(c: Column, days: float) -> Column:
    return F.timestamp_micros(F.unix_micros(c) + F.lit(int(days * 86_400_000_000)))


def expiry(created: Column | str, type_: Column | str = "type", policy: Policy = Policy()) -> Column:  # noqa: B008
    created, type_ = (F.col(c) if isinstance(c, str) else c for c in (created, type_))
    out = F.lit(None).cast("timestamp")
    for t, days in policy.ttl_days.items():
        if days is not None:
            out = F.when(type_ == t, plus_days(created, days)).otherwise(out)
    return out


def expired(as_of: Column, expires: Column | str = "expires_at") -> Column:
    expires = F.col(expires) if isinstance(expires, str) else expires
    return F.coalesce(expires <= as_of, F.lit(False))


def live(as_of: Column) -> Column:
    """In a form that reaches the scan."""
    return (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def removable_at(policy: Policy = Policy()) -> Column:  # noqa: B008
    return plus_days(F.col("expires_at"), policy.grace_days)


def with_keys(df: DataFrame) -> DataFrame:
    """df with scope_key, subject_key and trust."""
    return df.withColumns({"scope_key": scope_key(), "subject_key": subject_key(), "trust": trust()})


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows of an unknown type or source): the latter are neither judged nor stored."""
    good = known_type() & (F.col("source").isNull() | known_source())
    return df.where(good), df.where(~good)
