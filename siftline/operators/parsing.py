"""Record parsing: the modes of the parse clause as column expressions over `_raw`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.scalar import glob_regex, java_regex
from siftline.plans.clauses import QueryError


@dataclass(frozen=True)
class Mode:
    """kind: regex, wildcard, delimiter, line or quick."""

    kind: str
    pattern: str = ""
    quoters: str = ""
    flags: str = ""
    names: tuple[str, ...] = field(default=())


DEFAULT = "d/ /\"\"/r"
ESCAPED = {"t": "\t", "n": "\n", "r": "\r", "v": "\v"}


def _slashed(text: str) -> list[str]:
    """Pieces between slashes that no backslash precedes."""
    return [x.replace("\\/", "/") for x in re.split(r"(?<!\\)/", text)]


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPED.get(m[1], m[1]), text)


def mode(clause: str | None) -> Mode:
    clause = (clause or DEFAULT).strip()
    head = clause[:1].lower()
    if clause.startswith("/"):
        end = clause.rindex("/")
        if end == 0:
            raise QueryError(f"unclosed pattern: {clause}")
        pattern = clause[1:end].replace("\\/", "/")
        groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
        names = {i: n for n, i in groups.groupindex.items()}
        listed = tuple(names.get(i, "").upper() for i in range(1, groups.groups + 1))
        return Mode("regex", java_regex(pattern), names=listed)
    if head == "l" and clause.lower() == "l":
        return Mode("line")
    parts = _slashed(clause[1:].lstrip())
    if head not in "wdq" or len(parts) < 3:
        raise QueryError(f"unknown parse mode: {clause}")
    body, rest = parts[1], parts[2:]
    if head == "q":
        return Mode("quick", body, flags=rest[0].strip().lower())
    quoters = _plain(rest[0]) if len(rest) > 1 else ""
    if len(quoters) % 2:
        raise QueryError(f"quoters come in pairs: {quoters}")
    flags = (rest[1] if len(rest) > 1 else rest[0]).strip().lower()
    return Mode("wildcard" if head == "w" else "delimiter", body if head == "w" else _plain(body), quoters, flags)


def _quoted(quoters: str) -> list[str]:
    return [
        f"{re.escape(quoters[i])}[^{re.escape(quoters[i + 1])}]*{re.escape(quoters[i + 1])}"
        for i in range(0, len(quoters), 2)
    ]


def wildcard_regex(m: Mode) -> tuple[str, int]:
    """The pattern and its number of fields: '*' is a field, the text between is what separates them."""
    pieces = [_plain(x) for x in re.split(r"(?<!\\)\*", m.pattern)]
    alternatives = "|".join([*_quoted(m.quoters), ".*?"])
    out = "(?s)^" + re.escape(pieces[0])
    for i, piece in enumerate(pieces[1:], 1):
        last = i == len(pieces) - 1 and not piece
        out += "(.*)$" if last else f"({alternatives})" + re.escape(piece)
    return out, len(pieces) - 1


def delimited(raw: Column, m: Mode) -> Column:
    """The fields of a line as an array. A trailing delimiter gives an empty last field."""
    unit = f"[{re.escape(m.pattern)}]" if "c" in m.flags else re.escape(m.pattern)
    mark = f"(?:{unit})+" if "r" in m.flags else unit
    line = raw
    if not m.pattern.strip(" ") and "s" not in m.flags:
        line = F.btrim(raw, F.lit(" "))
    if not m.quoters:
        return F.split(line, mark, -1)
    # a quoted stretch counts where a field starts with it and a delimiter, or the end, follows it
    protected = "|".join(f"{q}(?={unit}|$)" for q in _quoted(m.quoters))
    token = f"(?s){mark}((?:{protected})|(?:(?!{unit}).)*)"
    return F.regexp_extract_all(F.concat(F.lit(m.pattern[:1] if "c" in m.flags else m.pattern), line), F.lit(token), F.lit(1))


def quick(raw: Column, m: Mode) -> Column:
    if "r" in m.flags:
        return raw.rlike(java_regex(m.pattern))
    return raw.rlike(glob_regex(m.pattern)) if "w" in m.flags else F.contains(raw, F.lit(_plain(m.pattern)))
