"""Scalar functions: name -> builder of a typed column from typed columns.

Positions in strings count from 0. A call whose arguments have the wrong form gives null.
"""

from __future__ import annotations

import re
import socket
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from siftline.functions import dates
from siftline.functions.values import (
    BOOLEAN, DATE, DOUBLE, INTEGER, LONG, STRING, TYPES, Val, common, constant, layout_of, number, stamp, text, typed, whole,
)
from siftline.plans.clauses import QueryError

FUNCTIONS: dict[str, Callable[..., Val]] = {}


def function(*names: str):
    def add(build: Callable[..., Val]) -> Callable[..., Val]:
        for name in names:
            FUNCTIONS[name] = build
        return build

    return add


def S(col: Column) -> Val:
    return Val(col, STRING)


def L(col: Column) -> Val:
    return Val(col.cast("long"), LONG)


def D(col: Column) -> Val:
    return Val(col.cast("double"), DOUBLE)


def flag(test: Column) -> Val:
    return L(F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0))


def const(v: Val, what: str):
    if v.literal is None:
        raise QueryError(f"{what} has to be a constant")
    return v.literal


def java_regex(pattern: str) -> str:
    """(?P<name> becomes a Java group."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def pattern_of(v: Val) -> str:
    return java_regex(str(const(v, "the pattern")))


def glob_regex(pattern: str) -> str:
    """'*' any run, '?' one character, '\\' escapes; anchored."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


# strings


@function("isnull")
def _isnull(e: Val) -> Val:
    return flag(F.coalesce(text(e), F.lit("")) == "")


@function("upper")
def _upper(s: Val) -> Val:
    return S(F.upper(text(s)))


@function("lower")
def _lower(s: Val) -> Val:
    return S(F.lower(text(s)))


@function("strlen")
def _strlen(s: Val) -> Val:
    return L(F.octet_length(text(s)))


@function("substr")
def _substr(s: Val, pos: Val, size: Val | None = None) -> Val:
    t, p = text(s), whole(pos)
    n = whole(size) if size else F.length(t) - p
    fits = (p >= 0) & (p < F.length(t)) & (n >= 0) & (p + n <= F.length(t))
    return S(F.when(fits, F.substring(t, p.cast("int") + 1, n.cast("int"))))


@function("instr")
def _instr(s: Val, sub: Val) -> Val:
    return L(F.instr(text(s), text(sub)) - 1)


@function("countstr")
def _countstr(s: Val, sub: Val) -> Val:
    t, u = text(s), text(sub)
    return L(F.when(F.length(u) > 0, (F.length(t) - F.length(F.replace(t, u, F.lit("")))) / F.length(u)))


@function("findnth")
def _findnth(s: Val, sub: Val, n: Val | None = None) -> Val:
    """Of the nth hit from the head the first position, from the tail the last one."""
    t, u, k = text(s), text(sub), int(const(n, "the number") if n else 1)
    parts = F.split(t, F.concat(F.lit("\\Q"), u, F.lit("\\E")), -1)
    hits = F.size(parts) - 1
    if k > 0:
        place = F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, x: a + F.length(x)) + F.length(u) * (k - 1)
        return L(F.when(hits >= k, place).otherwise(-1))
    reverse_parts = F.split(F.reverse(t), F.concat(F.lit("\\Q"), F.reverse(u), F.lit("\\E")), -1)
    ahead = F.aggregate(F.slice(reverse_parts, 1, -k), F.lit(0), lambda a, x: a + F.length(x)) + F.length(u) * (-k - 1)
    return L(F.when(hits >= -k, F.length(t) - 1 - ahead).otherwise(-1))


@function("comparestr")
def _comparestr(a: Val, b: Val) -> Val:
    x, y = text(a), text(b)
    return L(F.when(x < y, -1).when(x > y, 1).otherwise(0))


@function("nocasecomparestr")
def _nocasecomparestr(a: Val, b: Val) -> Val:
    return _comparestr(S(F.upper(text(a))), S(F.upper(text(b))))


@function("replace")
def _replace(s: Val, *pairs: Val) -> Val:
    """One pass from the left; at each place the first pair that fits wins."""
    if not pairs or len(pairs) % 2:
        raise QueryError("replace takes pairs")
    if len(pairs) == 2:
        return S(F.replace(text(s), text(pairs[0]), text(pairs[1])))
    olds = [str(const(p, "a text to replace")) for p in pairs[::2]]
    scan = "(?s)" + "|".join(re.escape(o) for o in olds) + "|."
    pieces = F.regexp_extract_all(text(s), F.lit(scan), F.lit(0))

    def swap(x: Column) -> Column:
        out = F.when(x == olds[0], text(pairs[1]))
        for old, new in zip(olds[1:], pairs[3::2], strict=True):
            out = out.when(x == old, text(new))
        return out.otherwise(x)

    return S(F.array_join(F.transform(pieces, swap), ""))


@function("regreplace")
def _regreplace(s: Val, pattern: Val, new: Val) -> Val:
    return S(F.regexp_replace(text(s), F.lit(pattern_of(pattern)), text(new)))


@function("regmatch")
def _regmatch(s: Val, pattern: Val, template: Val) -> Val:
    full = f"^(?:{pattern_of(pattern)})$"
    pieces = []
    for part in re.split(r"(\\\{|\{\d+\})", str(const(template, "the template"))):
        if re.fullmatch(r"\{\d+\}", part):
            pieces.append(F.regexp_extract(text(s), full, int(part[1:-1])))
        elif part:
            pieces.append(F.lit(part.replace("\\{", "{")))
    return S(F.when(text(s).rlike(full), F.concat(*pieces) if pieces else F.lit("")).otherwise(""))


def _hits(s: Val, pattern: Val, group: int = 0) -> Column:
    return F.regexp_extract_all(text(s), F.lit(pattern_of(pattern)), F.lit(group))


@function("regcount", "regcountpart")
def _regcount(s: Val, pattern: Val) -> Val:
    return L(F.size(_hits(s, pattern)))


@function("regget")
def _regget(s: Val, pattern: Val, n: Val, group: Val | None = None) -> Val:
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern_of(pattern))).groups
    g = int(const(group, "the group")) if group else 0
    g = min(g, groups) if g >= 0 else max(0, groups + 1 + g)
    hits = _hits(s, pattern, g)
    return S(F.when(F.size(hits) == 0, F.lit("")).otherwise(F.try_element_at(hits, whole(n).cast("int"))))


@function("reggetpart")
def _reggetpart(s: Val, pattern: Val, n: Val) -> Val:
    return S(F.try_element_at(_hits(s, pattern), F.nullif(whole(n).cast("int"), F.lit(0))))


def _range_of(parts: Column, start: Val, stop: Val | None, step: Val | None) -> Column:
    """parts from start to stop (counted from 1, or from the end if negative), backwards if stop comes first."""
    size = F.size(parts)
    place = lambda v: F.when(v < 0, size + v + 1).otherwise(v)
    a = place(whole(start))
    b = place(whole(stop)) if stop else size.cast("long")
    by = F.greatest(F.abs(whole(step)), F.lit(1)) if step else F.lit(1).cast("long")
    signed = F.when(b < a, -by).otherwise(by)
    inside = (a >= 1) & (a <= size) & (b >= 1)
    places = F.when(inside, F.sequence(a, F.least(b, size.cast("long")), signed))
    return F.transform(places, lambda i: F.get(parts, (i - 1).cast("int")))


@function("reggetparts")
def _reggetparts(s: Val, pattern: Val, start: Val, stop: Val | None = None, step: Val | None = None, mark: Val | None = None) -> Val:
    return S(F.array_join(_range_of(_hits(s, pattern), start, stop, step), str(const(mark, "the delimiter")) if mark else ","))


def _reduced(parts: Column, operation: str) -> Val:
    """SUM, AVERAGE, MAX, MIN, COUNT or UNIQUECOUNT of the numbers among parts."""
    numbers = F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    out = {
        "SUM": total,
        "AVERAGE": F.when(F.size(numbers) > 0, total / F.size(numbers)),
        "MAX": F.array_max(numbers),
        "MIN": F.array_min(numbers),
        "COUNT": F.size(numbers),
        "UNIQUECOUNT": F.size(F.array_distinct(numbers)),
    }.get(operation.upper())
    if out is None:
        raise QueryError(f"no such operation: {operation}")
    return L(out) if operation.upper() in ("COUNT", "UNIQUECOUNT") else D(out)


@function("regcalparts")
def _regcalparts(s: Val, pattern: Val, operation: Val, start: Val, stop: Val | None = None, step: Val | None = None) -> Val:
    return _reduced(_range_of(_hits(s, pattern), start, stop, step), str(const(operation, "the operation")))


def _tokens(s: Val, plain: str, quoters: Val | None) -> Column:
    """Runs of `plain` characters, where a stretch between quoters counts as plain."""
    alternatives = []
    pairs = str(const(quoters, "the quoters")) if quoters else ""
    for i in range(0, len(pairs) - 1, 2):
        a, b = re.escape(pairs[i]), re.escape(pairs[i + 1])
        alternatives.append(f"{a}[^{b}]*{b}")
    return F.regexp_extract_all(text(s), F.lit(f"(?:{'|'.join([*alternatives, plain])})+"), F.lit(0))


WORD = r"[^ \t\n\r,.!?;]"


@function("countword")
def _countword(s: Val, quoters: Val | None = None) -> Val:
    return L(F.size(_tokens(s, WORD, quoters)))


@function("getword")
def _getword(s: Val, n: Val, quoters: Val | None = None) -> Val:
    return S(F.try_element_at(_tokens(s, WORD, quoters), F.nullif(whole(n).cast("int"), F.lit(0))))


def _parts(s: Val, mark: Val, quoters: Val | None) -> Column:
    """Parts between delimiters; delimiters in a row count as one."""
    d = re.escape(str(const(mark, "the delimiter")))
    if not quoters:
        return F.split(text(s), f"(?:{d})+", -1)
    pairs = str(const(quoters, "the quoters"))
    quoted = "|".join(f"{re.escape(pairs[i])}[^{re.escape(pairs[i + 1])}]*{re.escape(pairs[i + 1])}" for i in range(0, len(pairs) - 1, 2))
    return F.regexp_extract_all(text(s), F.lit(f"(?:{quoted}|(?!{d}).)+"), F.lit(0))


@function("getpart")
def _getpart(s: Val, mark: Val, n: Val, quoters: Val | None = None) -> Val:
    return S(F.try_element_at(_parts(s, mark, quoters), F.nullif(whole(n).cast("int"), F.lit(0))))


@function("getparts")
def _getparts(s: Val, mark: Val, start: Val, stop: Val | None = None, step: Val | None = None, quoters: Val | None = None) -> Val:
    return S(F.array_join(_range_of(_parts(s, mark, quoters), start, stop, step), str(const(mark, "the delimiter"))))


@function("countpart")
def _countpart(s: Val, mark: Val, quoters: Val | None = None) -> Val:
    return L(F.size(_parts(s, mark, quoters)))


@function("calparts")
def _calparts(s: Val, mark: Val, operation: Val, start: Val, stop: Val | None = None, step: Val | None = None, quoters: Val | None = None) -> Val:
    return _reduced(_range_of(_parts(s, mark, quoters), start, stop, step), str(const(operation, "the operation")))


def _trimmed(s: Val, ch: Val | None, repeat: Val | None, left: bool, right: bool) -> Val:
    c = str(const(ch, "the character")) if ch else " "
    if len(c) != 1:
        raise QueryError("trim takes one character")
    body = r"[ \t]" if c == " " else re.escape(c)
    many = "*" if not repeat or const(repeat, "the flag") else "?"
    out = text(s)
    if left:
        out = F.regexp_replace(out, f"^{body}{many}", "")
    if right:
        out = F.regexp_replace(out, f"(?<!{body}){body}*$" if many == "*" else f"{body}$", "")
    return S(out)


@function("trimleft")
def _trimleft(s: Val, ch: Val | None = None, repeat: Val | None = None) -> Val:
    return _trimmed(s, ch, repeat, True, False)


@function("trimright")
def _trimright(s: Val, ch: Val | None = None, repeat: Val | None = None) -> Val:
    return _trimmed(s, ch, repeat, False, True)


@function("trim")
def _trim(s: Val, ch: Val | None = None, repeat: Val | None = None) -> Val:
    return _trimmed(s, ch, repeat, True, True)


@function("concat")
def _concat(*items: Val) -> Val:
    return S(F.concat(*[text(x) for x in items]))


@function("pad")
def _pad(seed: Val, n: Val) -> Val:
    return S(F.repeat(text(seed), F.greatest(whole(n), F.lit(0)).cast("int")))


@function("duplicate")
def _duplicate(e: Val, n: Val, mark: Val | None = None) -> Val:
    times = F.greatest(whole(n), F.lit(1)).cast("int")
    return S(F.array_join(F.array_repeat(text(e), times), str(const(mark, "the delimiter")) if mark else ","))


@function("camelstr")
def _camelstr(s: Val) -> Val:
    runs = F.regexp_extract_all(text(s), F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return S(F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), ""))


@function("snakestr")
def _snakestr(s: Val) -> Val:
    return S(F.concat(F.upper(F.left(text(s), F.lit(1))), F.lower(F.substr(text(s), F.lit(2)))))


@function("revertstr")
def _revertstr(s: Val) -> Val:
    return S(F.reverse(text(s)))


@function("ascii")
def _ascii(c: Val) -> Val:
    return L(F.when(text(c) != "", F.ascii(text(c))))


@function("char")
def _char(n: Val) -> Val:
    return S(F.char(whole(n)))


@function("urlencode")
def _urlencode(s: Val) -> Val:
    pieces = F.regexp_extract_all(F.url_encode(text(s)), F.lit(r"%..|[^%]+"), F.lit(0))
    low = F.transform(pieces, lambda x: F.when(x.startswith("%"), F.lower(x)).otherwise(x))
    return S(F.replace(F.replace(F.array_join(low, ""), F.lit("*"), F.lit("%2a")), F.lit("%7e"), F.lit("~")))


@function("urldecode")
def _urldecode(s: Val) -> Val:
    return S(F.try_url_decode(text(s)))


@function("base64encode")
def _base64encode(s: Val) -> Val:
    return S(F.base64(text(s).cast("binary")))


@function("base64decode")
def _base64decode(s: Val) -> Val:
    return S(F.unbase64(text(s)).cast("string"))


@function("md5")
def _md5(s: Val) -> Val:
    return S(F.md5(text(s)))


@function("hash")
def _hash(s: Val) -> Val:
    return L(F.xxhash64(text(s)))


#: Address forms.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
HEX4 = r"[0-9A-Fa-f]{1,4}"


@function("isip")
def _isip(s: Val) -> Val:
    return flag(text(s).rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"))


@function("isipv6")
def _isipv6(s: Val) -> Val:
    t = text(s)
    full = t.rlike(rf"^({HEX4}:){{7}}{HEX4}$")
    short = t.rlike(rf"^(({HEX4})(:{HEX4})*)?::(({HEX4})(:{HEX4})*)?$") & (F.regexp_count(t, F.lit(HEX4)) <= 7)
    return flag(full | short)


@function("ismac")
def _ismac(s: Val) -> Val:
    return flag(text(s).rlike(r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"))


#: Character classes of randstr.
CLASSES = {
    "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz", "d": "0123456789",
    "m": "~!@#$%^&*_-+=`|\\(){}[]:;\"'<>,.?/", "n": "_-", "s": " ", "x": "0123456789abcdef", "b": "01",
}


@function("randstr")
def _randstr(size: Val | None = None, flags: Val | None = None) -> Val:
    n = int(const(size, "the length")) if size else 8
    classes = str(const(flags, "the flags")) if flags else "uld"
    pool = "".join(CLASSES[c] for c in dict.fromkeys(classes.lower()) if c in CLASSES)
    if not pool:
        raise QueryError("randstr knows no such class")

    def pick(chars: str) -> Column:
        return F.substring(F.lit(chars), F.floor(F.rand() * len(chars)).cast("int") + 1, F.lit(1))

    compulsory = [pick(CLASSES[c.lower()]) for c in classes if c.isupper() and c.lower() in CLASSES][:n]
    return S(F.concat(*compulsory, *[pick(pool) for _ in range(n - len(compulsory))], F.lit("")))


# numbers

SIMPLE = {
    "abs": F.abs, "exp": F.exp, "log": F.log, "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "cbrt": F.cbrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh,
    "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
}
for _name, _build in SIMPLE.items():
    FUNCTIONS[_name] = lambda x, b=_build: D(b(number(x)))


@function("ceil")
def _ceil(x: Val) -> Val:
    return L(F.ceil(number(x)))


@function("floor")
def _floor(x: Val) -> Val:
    return L(F.floor(number(x)))


@function("round")
def _round(x: Val, scale: Val | None = None) -> Val:
    return D(F.round(number(x), max(0, int(const(scale, "the scale")) if scale else 0)))


def _nonzero(col: Column) -> Column:
    return F.when(col != 0, col)


@function("mod")
def _mod(a: Val, b: Val) -> Val:
    return L(whole(a) % _nonzero(whole(b)))


@function("fmod")
def _fmod(a: Val, b: Val) -> Val:
    return D(number(a) % _nonzero(number(b)))


@function("remainder")
def _remainder(a: Val, b: Val) -> Val:
    return D(number(a) - number(b) * F.rint(number(a) / _nonzero(number(b))))


@function("pow")
def _pow(a: Val, b: Val) -> Val:
    return D(F.pow(number(a), number(b)))


@function("exp2")
def _exp2(a: Val) -> Val:
    return D(F.pow(F.lit(2.0), number(a)))


@function("hypot")
def _hypot(a: Val, b: Val) -> Val:
    return D(F.hypot(number(a), number(b)))


@function("atan2")
def _atan2(a: Val, b: Val) -> Val:
    return D(F.atan2(number(a), number(b)))


@function("fma")
def _fma(a: Val, b: Val, c: Val) -> Val:
    return D(number(a) * number(b) + number(c))


@function("copysign")
def _copysign(a: Val, b: Val) -> Val:
    return D(F.abs(number(a)) * F.when(number(b) < 0, -1).otherwise(1))


@function("ilogb")
def _ilogb(a: Val) -> Val:
    return L(F.floor(F.log2(F.abs(number(a)))))


@function("scalbn", "scalbln")
def _scalbn(a: Val, n: Val) -> Val:
    return D(number(a) * F.pow(F.lit(2.0), number(n)))


@F.pandas_udf(DoubleType())
def _erf_udf(x: pd.Series) -> pd.Series:
    import math

    return x.map(lambda v: None if pd.isna(v) else math.erf(v))


@F.pandas_udf(DoubleType())
def _lgamma_udf(x: pd.Series) -> pd.Series:
    import math

    return x.map(lambda v: None if pd.isna(v) or (v <= 0 and v == int(v)) else math.lgamma(v))


@F.pandas_udf(DoubleType())
def _gamma_udf(x: pd.Series) -> pd.Series:
    import math

    return x.map(lambda v: None if pd.isna(v) or (v <= 0 and v == int(v)) or v > 171.6 else math.gamma(v))


for _name, _udf in (("erf", _erf_udf), ("lgamma", _lgamma_udf), ("tgamma", _gamma_udf)):
    FUNCTIONS[_name] = lambda x, u=_udf: D(u(number(x)))

INFINITE = float("inf")
LEAST_NORMAL = 2.2250738585072014e-308


@function("isfinite")
def _isfinite(x: Val) -> Val:
    return flag(~F.isnan(number(x)) & (F.abs(number(x)) < INFINITE))


@function("isinf")
def _isinf(x: Val) -> Val:
    return flag(F.abs(number(x)) == INFINITE)


@function("isnormal")
def _isnormal(x: Val) -> Val:
    return flag(~F.isnan(number(x)) & (F.abs(number(x)) < INFINITE) & (F.abs(number(x)) >= LEAST_NORMAL))


@function("fpclassify")
def _fpclassify(x: Val) -> Val:
    n = number(x)
    return S(
        F.when(F.isnan(n), "NAN").when(F.abs(n) == INFINITE, "INFINITE").when(n == 0, "ZERO")
        .when(F.abs(n) < LEAST_NORMAL, "SUBNORMAL").when(n.isNotNull(), "NORMAL")
    )


@function("pi")
def _pi() -> Val:
    return D(F.pi())


@function("random")
def _random(a: Val | None = None, b: Val | None = None) -> Val:
    least = whole(a) if a and b else F.lit(1)
    most = whole(b) if b else whole(a) if a else F.lit(100)
    return L(F.floor(F.rand() * (most - least + 1)) + least)


@function("sumall")
def _sumall(*items: Val) -> Val:
    total = number(items[0])
    for x in items[1:]:
        total = total + number(x)
    return D(total)


def _extreme(items: tuple[Val, ...], pick) -> Val:
    kind = items[0].kind
    for x in items[1:]:
        kind = common(kind, x.kind)
    cols = [typed(x, kind) for x in items]
    return Val(pick(*cols) if len(cols) > 1 else cols[0], kind, items[0].layout)


@function("greatest")
def _greatest(*items: Val) -> Val:
    return _extreme(items, F.greatest)


@function("least")
def _least(*items: Val) -> Val:
    return _extreme(items, F.least)


def _signed(n: Val, convert) -> Val:
    x = whole(n)
    return S(F.concat(F.when(x < 0, "-").otherwise(""), convert(F.abs(x))))


@function("dectohex")
def _dectohex(n: Val) -> Val:
    return _signed(n, F.hex)


@function("dectobin")
def _dectobin(n: Val) -> Val:
    return _signed(n, F.bin)


def _from_base(s: Val, digits: str, base: int) -> Val:
    t = text(s)
    body = F.regexp_replace(t, "^-", "")
    value = F.conv(body, base, 10).try_cast("long")
    return L(F.when(t.rlike(rf"^-?[{digits}]+$"), F.when(t.startswith("-"), -value).otherwise(value)).otherwise(0))


@function("hextodec")
def _hextodec(s: Val) -> Val:
    return _from_base(s, "0-9a-fA-F", 16)


@function("bintodec")
def _bintodec(s: Val) -> Val:
    return _from_base(s, "01", 2)


@function("comparenum")
def _comparenum(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    return L(F.when(x < y, -1).when(x > y, 1).when(x == y, 0))


# dates


def T(col: Column, like: Val | None = None, layout: str | None = None) -> Val:
    return Val(col, DATE, layout or (layout_of(like) if like else None))


@function("now")
def _now(x: Val | None = None) -> Val:
    return T(F.current_timestamp(), layout="%Y-%m-%d %H:%M:%S %z")


@function("todate")
def _todate(s: Val, layout: Val | None = None) -> Val:
    if layout:
        fixed = str(const(layout, "the layout"))
        return T(dates.parsed(text(s), fixed), layout=fixed)
    return T(stamp(s), s)


@function("dateformat")
def _dateformat(d: Val, layout: Val | None = None) -> Val:
    fixed = str(const(layout, "the layout")) if layout else None
    when = F.coalesce(dates.parsed(text(d), fixed), stamp(d)) if fixed and d.kind == STRING else stamp(d)
    return S(dates.shown(when, fixed or layout_of(d)))


@function("timediff")
def _timediff(a: Val, b: Val) -> Val:
    return D(F.unix_timestamp(stamp(a)) - F.unix_timestamp(stamp(b)))


@function("comparedate")
def _comparedate(a: Val, b: Val, layout: Val | None = None) -> Val:
    x, y = ((_todate(v, layout).col if layout else stamp(v)) for v in (a, b))
    return L(F.when(x < y, -1).when(x > y, 1).when(x == y, 0))


@function("addtime")
def _addtime(d: Val, n: Val, unit: Val | None = None) -> Val:
    u = str(const(unit, "the unit")).upper() if unit else "S"
    name = {"S": "secs", "M": "mins", "H": "hours", "D": "days", "N": "months", "Y": "years"}.get(u)
    if not name:
        raise QueryError(f"no such time unit: {u}")
    amount = whole(n).cast("decimal(18,6)" if u == "S" else "int")
    return T(stamp(d) + F.make_interval(**{name: amount}), d)


@function("truncdate")
def _truncdate(d: Val, seconds: Val) -> Val:
    n = whole(seconds)
    return T(F.timestamp_seconds(F.floor(F.unix_timestamp(stamp(d)) / n) * n), d)


@function("truncdateu")
def _truncdateu(d: Val, unit: Val) -> Val:
    u = {"s": "minute", "m": "hour", "h": "day", "b": "year"}.get(str(const(unit, "the unit")).lower(), "month")
    return T(F.date_trunc(u, stamp(d)), d)


@function("monthfirstday")
def _monthfirstday(d: Val) -> Val:
    return T(F.date_trunc("month", stamp(d)), d)


@function("monthfirstmonday")
def _monthfirstmonday(d: Val) -> Val:
    s = stamp(d)
    monday = F.next_day(F.date_sub(F.trunc(s.cast("date"), "month"), 1), "Mon")
    clock = F.unix_timestamp(s) - F.unix_timestamp(F.date_trunc("day", s))
    return T(F.timestamp_seconds(F.unix_timestamp(monday.cast("timestamp")) + clock), d)


@function("weekday")
def _weekday(d: Val) -> Val:
    return L(F.weekday(stamp(d)) + 1)


@function("yearday")
def _yearday(d: Val) -> Val:
    return L(F.dayofyear(stamp(d)) - 1)


@function("yearweek")
def _yearweek(d: Val) -> Val:
    day, of_week = F.dayofyear(stamp(d)) - 1, F.dayofweek(stamp(d)) - 1
    return L(F.floor(day / 7) + F.when(day % 7 >= of_week, 1).otherwise(0))


@function("isleap")
def _isleap(d: Val) -> Val:
    y = F.year(stamp(d))
    return flag(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0))


@function("datetolong")
def _datetolong(d: Val) -> Val:
    return L(F.unix_timestamp(stamp(d)))


@function("longtodate")
def _longtodate(n: Val) -> Val:
    return T(F.timestamp_seconds(whole(n)), layout="%Y-%m-%d %H:%M:%S %z")


@function("localtime")
def _localtime(d: Val) -> Val:
    return T(stamp(d), d)


@function("gmtime")
def _gmtime(d: Val, offset: Val) -> Val:
    h = whole(offset)
    local = F.unix_timestamp(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp"))
    zone = local - F.unix_timestamp(F.lit("2000-01-01 00:00:00").cast("timestamp"))
    moved = F.timestamp_seconds(F.unix_timestamp(stamp(d)) + h * 3600 - zone)
    return T(F.when(h.between(-12, 12), moved), d)


# types and choices


@function("datatype")
def _datatype(e: Val) -> Val:
    return constant(e.kind)


def _is_long(t: Column) -> Column:
    return t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("long").isNotNull()


def _is_double(t: Column) -> Column:
    return t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


@function("detectdt")
def _detectdt(s: Val) -> Val:
    t = text(s)
    return S(
        F.when(dates.recognised(t).isNotNull(), DATE).when(_is_long(t), LONG).when(_is_double(t), DOUBLE).otherwise(STRING)
    )


@function("islong")
def _islong(s: Val) -> Val:
    return flag(_is_long(text(s)))


@function("isdouble")
def _isdouble(s: Val) -> Val:
    return flag(_is_double(text(s)))


@function("isdate")
def _isdate(s: Val) -> Val:
    return flag(stamp(s).isNotNull())


@function("isstring")
def _isstring(s: Val) -> Val:
    return constant(1)


@function("toint")
def _toint(s: Val) -> Val:
    return Val(text(s).try_cast("int"), INTEGER)


@function("tolong")
def _tolong(s: Val) -> Val:
    return Val(whole(s), LONG)


@function("tofloat")
def _tofloat(s: Val) -> Val:
    return D(number(s))


@function("tostr")
def _tostr(e: Val) -> Val:
    return S(text(e))


def _same_kind(items: list[Val]) -> tuple[str, list[Column]]:
    kind = items[0].kind
    for x in items[1:]:
        kind = common(kind, x.kind)
    return kind, [typed(x, kind) for x in items]


@function("switch")
def _switch(x: Val, *rest: Val) -> Val:
    cases, results = list(rest[: len(rest) // 2 * 2 : 2]), list(rest[1 : len(rest) // 2 * 2 : 2])
    results.append(rest[-1] if len(rest) % 2 else x)
    kind, cols = _same_kind(results)
    out = None
    for case, result in zip(cases, cols, strict=False):
        test = F.coalesce(equal(x, case), F.lit(False))
        out = F.when(test, result) if out is None else out.when(test, result)
    return Val(cols[-1] if out is None else out.otherwise(cols[-1]), kind, results[0].layout)


def equal(a: Val, b: Val) -> Column:
    return compared("=", a, b)


def compared(op: str, a: Val, b: Val) -> Column:
    """A comparison in the common type; null where a value does not convert."""
    if DATE in (a.kind, b.kind):
        x, y = stamp(a), stamp(b)
    elif a.kind == STRING and b.kind == STRING:
        x, y = a.col, b.col
    elif {a.kind, b.kind} <= {LONG, INTEGER}:
        x, y = a.col, b.col
    else:
        x, y = number(a), number(b)
    return {"=": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def choose(tests: list[Column], results: list[Val]) -> Val:
    """when(): the first result whose test holds, else the last."""
    kind, cols = _same_kind(results)
    out = F.when(tests[0], cols[0])
    for test, col in zip(tests[1:], cols[1:], strict=False):
        out = out.when(test, col)
    return Val(out.otherwise(cols[-1]), kind, results[0].layout)


# the machine; read on the driver


@function("hostname")
def _hostname() -> Val:
    return constant(socket.gethostname())


@function("myips")
def _myips(start: Val | None = None, stop: Val | None = None, mark: Val | None = None) -> Val:
    try:
        found = sorted({x[4][0] for x in socket.getaddrinfo(socket.gethostname(), None)})
    except OSError:
        found = []
    a = int(const(start, "the number")) if start else 1
    b = int(const(stop, "the number")) if stop else len(found)
    return constant((str(const(mark, "the delimiter")) if mark else "|").join(found[a - 1 : b]))


def _path_function(name: str, kind: str, test) -> None:
    @F.pandas_udf(StringType())
    def ask(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else str(test(p)))

    def build(p: Val) -> Val:
        out = ask(text(p))
        return L(out.try_cast("long")) if kind == LONG else S(out)

    FUNCTIONS[name] = build


def _attributes(path: str) -> str:
    import os
    import stat

    mode = os.lstat(path).st_mode if os.path.lexists(path) else 0
    kinds = (("IFSOCK", stat.S_ISSOCK), ("IFLNK", stat.S_ISLNK), ("IFREG", stat.S_ISREG), ("IFBLK", stat.S_ISBLK), ("IFDIR", stat.S_ISDIR), ("IFCHR", stat.S_ISCHR), ("IFIFO", stat.S_ISFIFO))
    bits = ("IRUSR", "IWUSR", "IXUSR", "IRGRP", "IWGRP", "IXGRP", "IROTH", "IWOTH", "IXOTH")
    return ";".join([n for n, test in kinds if test(mode)] + [b for i, b in enumerate(bits) if mode >> (8 - i) & 1])


def _install_path_functions() -> None:
    import os

    _path_function("isfile", LONG, lambda p: int(os.path.isfile(p)))
    _path_function("isfolder", LONG, lambda p: int(os.path.isdir(p)))
    _path_function("fileexist", LONG, lambda p: int(os.path.exists(p)))
    _path_function("filesize", LONG, lambda p: os.path.getsize(p) if os.path.exists(p) else -1)
    _path_function("isexecutable", LONG, lambda p: int(os.access(p, os.X_OK)))
    _path_function("issymblink", LONG, lambda p: int(os.path.islink(p)))
    _path_function("getsymblink", STRING, lambda p: os.readlink(p) if os.path.islink(p) else "")
    _path_function("fileattrs", STRING, _attributes)


_install_path_functions()
#: Not offered: they would run commands or change files once per row.
REFUSED = ("exec", "rmfile", "renamefile", "appendfile")


def call(name: str, args: list[Val]) -> Val:
    if name in REFUSED:
        raise QueryError(f"{name} is not offered: it would act on the machine once per row")
    build = FUNCTIONS.get(name)
    if build is None:
        raise QueryError(f"no such function: {name}")
    try:
        return build(*args)
    except TypeError as e:
        if "positional argument" in str(e):
            raise QueryError(f"{name} takes other arguments") from e
        raise


__all__ = ["BOOLEAN", "FUNCTIONS", "TYPES", "call", "choose", "compared", "glob_regex", "java_regex"]
