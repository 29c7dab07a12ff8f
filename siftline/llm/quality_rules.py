"""Quality rules as a short-circuit cascade of SQL expressions.

Each rule is a predicate over a document's words and counts. On a bounded sample every rule is timed
and its rejections are counted; the cascade then runs the rules by rejections per second, and a
CASE expression stops at the first that fires. The order changes the cost only: a document is kept
if no rule rejects it.

Defined results: a null text counts as an empty one; an empty text has no words and fails the base
rule; repeated rows are judged one by one; a very long text is judged whole; of rules that gain alike
the one listed first runs first; an empty table gives an empty table; `quality` replaces an input
column of that name in judged(), and kept() returns the input's columns unchanged, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, dropped, let, words, written


@dataclass(frozen=True)
class Rule:
    """rejects: builds the predicate from a struct with text, words, lines and the base counts."""

    name: str
    rejects: Callable[[Column], Column]


def _share_of(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test)) / F.greatest(F.size(items), F.lit(1))


RULES = (
    Rule("word_length", lambda d: ~(d["word_chars"] / F.greatest(d["n_words"], F.lit(1))).between(2.5, 12.0)),
    Rule("symbols", lambda d: d["n_symbols"] * 10 > d["n_words"]),
    Rule("repeated_lines", lambda d: d["n_dup_lines"] * 10 > F.size(d["lines"]) * 4),
    Rule("letters", lambda d: _share_of(d["words"], lambda w: w.rlike(r"\p{L}")) < 0.7),
    Rule(
        "capitals",
        lambda d: F.length(F.regexp_replace(d["text"], r"[^\p{Lu}]+", "")) * 10 > F.length(d["text"]) * 4,
    ),
    Rule("few_distinct", lambda d: F.size(F.array_distinct(d["words"])) * 50 < d["n_words"]),
    Rule("bullets", lambda d: _share_of(d["lines"], lambda x: x.rlike(r"^\s*[-*•●]")) > 0.9),
    Rule("ellipsis", lambda d: _share_of(d["lines"], lambda x: x.rlike(r"(\.\.\.|…)\s*$")) > 0.5),
)


def _repeated_words(w: Column, span: int = 3) -> Column:
    """Words that lie in a window of `span` words which the text holds twice or more."""

    def covered(starts: Column) -> Column:
        # starts ascend; each window adds what the next one does not cover
        return F.aggregate(
            F.transform(
                starts,
                lambda p, i: F.least(
                    F.lit(span), F.coalesce(F.get(starts, i + 1), p + span) - p
                ).cast("long"),
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def from_pairs(pairs: Column) -> Column:
        def twice(p: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])
            return before | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))

        return let(
            F.sort_array(F.transform(F.filter(pairs, twice), lambda p: p["i"])), lambda p: covered(p)
        )

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        in_order = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))

        def from_repeated(r: Column) -> Column:
            # few repeated windows: look each hash up; many: sort hashes with their places
            looked_up = F.filter(
                F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, F.get(h, i))
            )
            return F.when(F.size(r) <= 24, let(looked_up, lambda p: covered(p))).otherwise(
                let(pairs, lambda p: from_pairs(p))
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(F.sort_array(h), lambda s: in_order(s)), lambda r: from_repeated(r))
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - span),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(span)]),
    )
    return F.when(F.size(w) < span, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: from_hashes(h)))


def measures(text: Column) -> Column:
    """Struct of text, words, lines that have a word, and the base counts."""
    text = F.coalesce(text, F.lit(""))

    def fill(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
        return let(
            F.struct(words(t).alias("w"), lines.alias("l")),
            lambda s: F.struct(
                t.alias("text"),
                s["w"].alias("words"),
                s["l"].alias("lines"),
                F.size(s["w"]).cast("long").alias("n_words"),
                F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                _repeated_words(s["w"]).alias("n_repeat_words"),
            ),
        )

    return let(text, lambda t: fill(t))


def base_failed(d: Column) -> Column:
    return (d["n_words"] < 50) | (d["n_repeat_words"] * 100 > d["n_words"] * 50)


#: Characters of the longest text that the sample takes, and how often a rule is evaluated on the sample.
SAMPLE_CHARS, REPEATS = 100_000, 40


def ordered(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> list[dict]:
    """Rules with cost (seconds a document) and rejections on at most sample_rows documents, best rejection per cost first.

    The sample is taken from as few parts of the input as hold it, and each rule is timed over REPEATS
    evaluations of it within one task, so that a job's start does not count as cost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text}`").alias("t")).where(F.coalesce(F.length("t"), F.lit(0)) <= SAMPLE_CHARS)
    taken = rows.sample(0.05, 7).take(sample_rows)
    if len(taken) * 2 < sample_rows:
        taken = rows.take(sample_rows)
    if not taken:
        return [{"rule": r, "cost": 0.0, "rejected": 0, "of": 0, "gain": 0.0} for r in rules]
    sample = written(spark.createDataFrame([(r["t"],) for r in taken], "t string").coalesce(1).select(measures(F.col("t")).alias("d")))
    repeated = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(value: Column) -> tuple[float, int]:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            hits = repeated.agg(F.count_if(value)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits // REPEATS

    floor, _ = timed(F.col("d.n_words") < 0)
    found = []
    for rule in rules:
        took, hits = timed(rule.rejects(F.col("d")))
        cost = max(took - floor, 1e-3) / (REPEATS * len(taken))
        found.append({"rule": rule, "cost": cost, "rejected": hits, "of": len(taken), "gain": (hits + 0.5) / (len(taken) + 1) / cost})
    dropped(sample)
    return sorted(found, key=lambda r: -r["gain"])


def order_table(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """The order as data: place, rule, cost (seconds a document), rejected, of."""
    found = ordered(docs, text, rules, sample_rows)
    rows = [(n, r["rule"].name, float(r["cost"]), r["rejected"], r["of"]) for n, r in enumerate(found, 1)]
    return docs.sparkSession.createDataFrame(rows, "place int, rule string, cost double, rejected long, of long")


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """docs with a struct column `quality`: base counts, base_failed, kept and the rule that rejected (null if kept)."""
    order = [r["rule"] for r in ordered(docs, text, rules, sample_rows)]

    def verdict(d: Column) -> Column:
        cascade = F.when(base_failed(d), F.lit("base"))
        for rule in order:
            cascade = cascade.when(rule.rejects(d), F.lit(rule.name))
        return let(
            cascade.otherwise(F.lit(None).cast("string")),
            lambda why: F.struct(
                *[d[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                base_failed(d).alias("base_failed"),
                why.isNull().alias("kept"),
                why.alias("rejected_by"),
            ),
        )

    return docs.withColumn("quality", let(measures(F.col(text)), lambda d: verdict(d)))


def kept(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of docs that the cascade keeps, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))  # no name of the input's can clash
    return judged(rows, "text", **options).where(F.col("quality.kept")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
