"""Date layouts: strftime to Java patterns, detection on the driver, detection in columns."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conversion of strftime fields.
JAVA = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM",
    "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD", "z": "xx", "Z": "z",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}
#: Date layouts in the order they are tried, time layouts, what joins them, zones.
DATES = (
    "%Y-%b-%d", "%Y-%m-%d", "%Y/%b/%d", "%Y/%m/%d", "%b/%d/%Y", "%d-%m-%Y", "%d/%b/%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y",
)
TIMES = ("%H/%M/%S", "%H:%M:%S")
JOINS = (" ", "/", ":")
ZONES = ("", " %z", "%z", " %Z", "%Z")
NAMED_ZONES = frozenset("UTC GMT EST EDT CST CDT MST MDT PST PDT CET CEST EET EEST WET BST JST IST".split())
DEFAULT = "%Y-%m-%d %H:%M:%S"


def java_pattern(layout: str) -> str:
    """A strftime layout as a Java pattern; all other characters are quoted."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while i < len(layout):
        if layout[i] == "%" and i + 1 < len(layout):
            field = layout[i + 1]
            i += 2
            if field == "%":
                literal += "%"
            elif field in JAVA:
                flush()
                out.append(JAVA[field])
            else:
                raise ValueError(f"no such date field: %{field}")
        else:
            literal += layout[i]
            i += 1
    flush()
    return "".join(out)


def matches(text: str, layout: str) -> bool:
    if layout.endswith("%Z"):
        name = re.search(r"[A-Z]{3,4}$", text)
        return bool(name) and name[0] in NAMED_ZONES and matches(text[: name.start()], layout[:-2])
    try:
        datetime.strptime(text, layout)
    except ValueError:
        return False
    return True


def detect(text: str) -> str | None:
    """The layout of a text that is a date, or None."""
    if not re.match(r"[\dA-Za-z]", text) or not re.search(r"\d", text) or len(text) < 6:
        return None
    for date in DATES:
        if matches(text, date):
            return date
    for time in TIMES:
        if matches(text, time):
            return time
    for date in DATES:
        for time in TIMES:
            for join in JOINS:
                for zone in ZONES:
                    if matches(text, date + join + time + zone):
                        return date + join + time + zone
                    if matches(text, time + join + date + zone):
                        return time + join + date + zone
    return None


def parsed(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(java_pattern(layout)))


def recognised(text: Column) -> Column:
    """The timestamp of a text in any known date-first layout, null for others."""
    shape = r"^([0-9A-Za-z]+)([-/])([0-9A-Za-z]+)\2([0-9A-Za-z]+)(?:[ :/]([0-9]{1,2})[:/]([0-9]{2})[:/]([0-9]{2}))?(?: ?([+-][0-9]{4}|[A-Z]{3,4}))?$"
    part = lambda n: F.regexp_extract(text, shape, n)
    clock = F.when(part(5) == "", F.lit("00:00:00")).otherwise(
        F.concat_ws(":", F.lpad(part(5), 2, "0"), part(6), part(7))
    )
    zone = F.when(part(8) == "", F.lit(None).cast("string")).otherwise(part(8))
    day = F.concat_ws("-", part(1), part(3), part(4))
    tries = []
    for layout in ("yyyy-MMM-dd", "yyyy-MM-dd", "MMM-dd-yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "MM-dd-yyyy"):
        whole = F.concat(day, F.lit(" "), clock)
        tries.append(
            F.when(zone.isNull(), F.try_to_timestamp(whole, F.lit(f"{layout} HH:mm:ss"))).otherwise(
                F.when(zone.rlike("[A-Z]"), F.try_to_timestamp(F.concat(whole, F.lit(" "), zone), F.lit(f"{layout} HH:mm:ss z"))).otherwise(
                    F.try_to_timestamp(F.concat(whole, F.lit(" "), zone), F.lit(f"{layout} HH:mm:ss xx"))
                )
            )
        )
    return F.when(text.rlike(shape), F.coalesce(*tries))


def shown(stamp: Column, layout: str | None) -> Column:
    return F.date_format(stamp, java_pattern(layout or DEFAULT))
