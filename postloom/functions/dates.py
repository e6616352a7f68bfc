"""Quiet hours, digests and windows as expressions over local wall time; now is always given."""

from __future__ import annotations


def minutes(hhmm: str, fallback: int) -> str:
    """Minutes of the day of an HH:MM text; the fallback where it is none."""
    return rf"coalesce(try_cast(regexp_extract({hhmm}, '^([01]?[0-9]|2[0-3]):([0-5][0-9])$', 1) as int) * 60 + try_cast(regexp_extract({hhmm}, '^([01]?[0-9]|2[0-3]):([0-5][0-9])$', 2) as int), {fallback})"


def minute_of_day(ts: str) -> str:
    return f"(hour({ts}) * 60 + minute({ts}))"


def quiet(local: str, start: str, end: str) -> str:
    """Whether a local time lies in a window of minutes that may pass midnight; an empty window is never quiet."""
    m = minute_of_day(local)
    return f"case when {start} = {end} then false when {start} < {end} then {m} >= {start} and {m} < {end} else {m} >= {start} or {m} < {end} end"


def quiet_end(local: str, start: str, end: str) -> str:
    """When the quiet hours that a local time lies in end: today, or tomorrow if they began before a midnight still to come."""
    return f"(date_trunc('DAY', {local}) + make_interval(0, 0, 0, 0, 0, cast({end} + if({start} > {end} and {minute_of_day(local)} >= {start}, 1440, 0) as int)))"


def weekend(local: str) -> str:
    return f"(weekday({local}) >= 5)"


def trends_start(local: str) -> str:
    """Local midnight, or 24 hours ago before eight in the morning."""
    return f"case when hour({local}) < 8 then {local} - interval 24 hours else date_trunc('DAY', {local}) end"


def digest_mode(minutes_between: str) -> str:
    return f"case when {minutes_between} <= 0 then 'off' when {minutes_between} <= 60 then '1h' when {minutes_between} <= 180 then '3h' when {minutes_between} <= 360 then '6h' else 'daily' end"


def digest_due(mode: str, last: str, now: str, local: str, at: str, is_quiet: str) -> str:
    """Off never; hourly modes after their hours or at first; daily once after its minute of the local day. Never in quiet hours."""
    hours = f"case {mode} when '1h' then 1 when '3h' then 3 when '6h' then 6 end"
    since = f"(unix_timestamp({now}) - unix_timestamp({last})) / 3600.0D"
    daily = f"{minute_of_day(local)} >= {at} and ({last} is null or to_date({last}) < to_date({local}))"
    return f"case when {mode} = 'off' or {is_quiet} then false when {mode} = 'daily' then {daily} else {last} is null or {since} >= {hours} end"
