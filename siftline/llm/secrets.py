"""Secret scans with corpus-wide ownership frequency, in SQL expressions.

Candidates are found by pattern in the whole text. Each candidate's value is hashed, and over the
corpus the distinct owners and repositories that hold it are counted: a value that several owners
share, or very many repositories of one, is a widely copied example, one that belongs to few is a
live-looking credential.

Defined results: a null text counts as an empty one, without spans; a null owner or repository counts
as no owner or repository; repeated rows are scanned each and count once per repository; a very
long text is scanned whole; of spans that begin together the kind listed first comes first; an
empty table gives an empty table; the input's own columns are returned unchanged beside `secrets`,
which replaces an input column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import let, numbered, written


@dataclass(frozen=True)
class Kind:
    """name, whether base, pattern, group that holds the value, its least length; hint: a literal all matches hold."""

    name: str
    base: bool
    pattern: str
    group: int
    least: int
    hint: str | None = None


#: The three base kinds and public token formats.
KINDS = (
    Kind(
        "assign", True,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
    ),
    Kind("access", True, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Kind("hex", True, r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
    Kind("github", False, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Kind("slack", False, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Kind("jwt", False, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, "eyJ"),
    Kind("pem", False, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60, "PRIVATE KEY"),
)
#: A value in more spans is joined to its verdict in so many parts.
OFTEN, SALTS = 100_000, 64
SPAN = "array<struct<start:int,k:int,stop:int,hash:string>>"


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """Matches of one kind, with code point places: the text between matches tells where each begins."""

    def placed(found: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(F.get(found["gaps"], i))
            end = begin + F.length(F.get(found["hits"], i))
            span = F.struct(begin.alias("start"), F.lit(number).alias("k"), end.alias("stop"), i.alias("i"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        start = F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,k:int,stop:int,i:int>>").alias("out"),
        )
        places = F.aggregate(F.sequence(F.lit(0), F.size(found["hits"]) - 1), start, add)["out"]

        def value(p: Column) -> Column:
            hit = F.get(found["hits"], p["i"])
            return F.regexp_extract(hit, kind.pattern, kind.group) if kind.group else hit

        long_enough = F.filter(places, lambda p: F.length(value(p)) >= kind.least)
        return F.transform(
            long_enough,
            lambda p: F.struct(p["start"], p["k"], p["stop"], F.sha2(value(p), 256).alias("hash")),
        )

    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
        F.split(text, kind.pattern, -1).alias("gaps"),
    )
    present = text.rlike(kind.pattern)
    if kind.hint:
        present = F.contains(text, F.lit(kind.hint)) & present
    return F.when(present, let(found, lambda x: placed(x))).otherwise(F.array().cast(SPAN)).cast(SPAN)


def candidates(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans by start, then kind: array of start, k (index of the kind), stop (exclusive), hash of the value."""

    def every(t: Column) -> Column:
        return F.sort_array(F.concat(*[_spans(t, n, kind) for n, kind in enumerate(kinds)]))

    return let(F.coalesce(text, F.lit("")), lambda t: every(t))


def listed(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["stop"])), ","
    )


def scanned(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    kinds: tuple[Kind, ...] = KINDS,
    example_owners: int = 3,
    example_repositories: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of docs (all, unless given) and `secrets`: array of start, k, stop, owners, repositories, live.

    A value that example_owners owners or more hold, or example_repositories repositories of any owners, is an
    example: live is false for it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    # the input's columns travel in a struct, so that no name of theirs can clash
    shown = [F.col("row")[c].alias(c) for c in names]
    found = candidates(F.col(f"`{text}`"), kinds)
    # rows without a candidate, nearly all as a rule, stay where they are; their texts need not meet any verdict
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{owner}`").alias("_secret_owner"), F.col(f"`{repository}`").alias("_secret_repo"), found.alias("_secret_spans"))
    held = written(numbered(rows.where(F.size("_secret_spans") > 0), "_secret_row"))
    spans = held.select("_secret_row", "_secret_owner", "_secret_repo", F.inline("_secret_spans"))
    # of a value its distinct owners and repositories, each counted after a distinct, so that a frequent value makes no large group
    owners = spans.select("hash", "_secret_owner").distinct().groupBy("hash").agg(F.count("_secret_owner").alias("owners"))
    repos = spans.select("hash", "_secret_repo").distinct().groupBy("hash").agg(F.count("_secret_repo").alias("repositories"))
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = written(owners.join(repos, "hash").select("hash", "owners", "repositories", live.alias("live")))
    # values that many rows hold are few: they are joined apart, so that none makes a large task
    often = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN).select("hash")
    placed = spans.select("_secret_row", "start", "k", "stop", "hash").join(often.withColumn("_often", F.lit(True)), "hash", "left")
    placed = placed.withColumn("_salt", F.when(F.col("_often"), F.pmod("_secret_row", F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    dealt = judged.join(often.withColumn("_often", F.lit(True)), "hash", "left").withColumn(
        "_salt", F.explode(F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    verdict = F.struct("start", "k", "stop", "owners", "repositories", "live")
    verdicts = (
        placed.drop("_often")
        .join(dealt.drop("_often"), ["hash", "_salt"])
        .groupBy("_secret_row")
        .agg(F.sort_array(F.collect_list(verdict)).alias("secrets"))
    )
    empty = F.array().cast(verdicts.schema["secrets"].dataType)
    with_spans = held.join(verdicts, "_secret_row").select(*shown, "secrets")
    return rows.where(F.size("_secret_spans") == 0).select(*shown, empty.alias("secrets")).unionByName(with_spans)


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """text with every live span replaced by mark; spans that overlap are replaced together."""

    def build(live: Column) -> Column:
        def add(state: Column, s: Column) -> Column:
            inside = s["start"] < state["at"]
            return F.struct(
                F.greatest(state["at"], s["stop"]).alias("at"),
                F.when(inside, state["out"])
                .otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
                .alias("out"),
            )

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        tail = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
        return F.aggregate(live, start, add, tail)

    live = F.filter(secrets, lambda s: s["live"])
    return F.when(F.size(live) > 0, let(live, lambda x: build(x))).otherwise(text)
