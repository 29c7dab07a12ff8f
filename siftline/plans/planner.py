"""From clauses and sources to a DataFrame.

Stages: scan, parse, number lines, variables, filter, side joins, duplicate, group and having,
windows and their filter, projection, column to row, extra filter, unique, tree, sort, limit, report.
Everything is declared on DataFrames; only type detection looks at data (a bounded number of rows).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import dates, scalar
from siftline.functions.values import (
    BOOLEAN, DATE, DOUBLE, LONG, NUMBERS, STRING, TYPES, Val, common, constant, kind_of, number, stamp, text, typed,
)
from siftline.operators import numbering, ordered, parsing, tree
from siftline.plans import syntax
from siftline.plans.clauses import QueryError, split_outside
from siftline.plans.syntax import And, Bin, Call, Cmp, Each, Field, In, Last, Lit, Neg, Or, Param, Side, Sorted, Var
from siftline.sources.text import Lines, Table, Text, numbered_files, raw_of

AGGREGATES = frozenset("count sum average max min uniquecount grouplist".split())
ANALYTIC = frozenset("rank denserank nearby counta uniquecounta suma averagea maxa mina".split())
#: What orders the rows of all sources.
ORDER = ("_fileid", "_pos")
HIERARCHY = frozenset("root parent path".split())
MACROS = frozenset("foreach coltorow anycol allcol".split())
SIDE = frozenset("rcount rmember rmembers rmemberid".split())
RESERVED = frozenset("RAW ROW FILE LINE FILEID FILELINE N % LEVEL NODEID ISLEAF ROOT PATH DUPID".split())


@dataclass
class Options:
    nameline: bool = False
    textonly: bool = False
    detect_rows: int = 1
    skip: int = 0
    variables: str = ""
    macros: str = ""


@dataclass
class Result:
    """frame: the result; names: its headings; report: footer frame or None; sink: (mode, path column) or None."""

    frame: DataFrame
    names: list[str]
    report: DataFrame | None = None
    sink: tuple[str, str] | None = None
    matched: DataFrame | None = None


@dataclass
class Running:
    """A recurrence over blocks of rows.

    own: what a block's rows up to a row give, over a window (None: the row alone); of_block: what a block gives, as an
    aggregate; over_blocks: what blocks give together, over a window; value: the variable's, from the row's own part and the
    blocks before (None: there are none).
    """

    own: Callable | None
    of_block: Column
    over_blocks: Callable
    value: Callable


@dataclass
class Scope:
    """What a name means at a stage. known: nodes that are columns already."""

    plan: "Plan"
    known: dict = field(default_factory=dict)

    def value(self, node) -> Val:
        if node in self.known:
            return self.known[node]
        plan = self.plan
        if isinstance(node, Lit):
            return constant(node.value)
        if isinstance(node, Field):
            return plan.field_value(node)
        if isinstance(node, Last):
            return plan.last_value(node)
        if isinstance(node, Var):
            return plan.variable_value(node.name)
        if isinstance(node, Each):
            if node.mark == "%":
                return plan.width_value()
            raise QueryError(f"'{node.mark}' stands outside foreach")
        if isinstance(node, Neg):
            v = self.value(node.of)
            if v.literal is not None and not isinstance(v.literal, str):
                return constant(-v.literal)
            return Val(-v.col, v.kind) if v.kind in (LONG, "INTEGER") else Val(-number(v), DOUBLE)
        if isinstance(node, Bin):
            return arithmetic(node.op, self.value(node.left), self.value(node.right))
        if isinstance(node, Call):
            return self.call(node)
        if isinstance(node, (And, Or, Cmp, In)):
            return Val(self.test(node), BOOLEAN)
        raise QueryError(f"no value: {node}")

    def call(self, node: Call) -> Val:
        name, args = node.name, node.args
        if name in AGGREGATES or name in ANALYTIC or name in HIERARCHY or name in MACROS or name in SIDE:
            raise QueryError(f"{name} cannot stand here")
        if name == "when":
            tests, results = args[:-1:2], [*args[1:-1:2], args[-1]]
            if len(args) % 2 == 0:
                raise QueryError("when needs a last value")
            return scalar.choose([self.test(t) for t in tests], [self.value(r) for r in results])
        if name == "eval":
            inner = args[0]
            if not isinstance(inner, Lit):
                raise QueryError("eval takes a constant text")
            return self.value(self.plan.normal(syntax.expression(str(inner.value))))
        if name == "fieldname":
            return constant(self.plan.heading(self.plan.constant(args[0])))
        return scalar.call(name, [self.value(a) for a in args])

    def test(self, node) -> Column:
        """A condition; what does not convert counts as false."""
        if isinstance(node, And):
            return self.test(node.left) & self.test(node.right)
        if isinstance(node, Or):
            return self.test(node.left) | self.test(node.right)
        if isinstance(node, Call) and node.name in ("anycol", "allcol"):
            raise QueryError(f"{node.name} needs a comparison")
        if isinstance(node, Cmp):
            found = _spread(node.left)
            if found is not None:
                items = self.plan.each(found)
                tests = [F.coalesce(self.compare(node.op, x, node.right), F.lit(False)) for x in items]
                if found.name == "allcol":
                    tests = [t | self.value(x).col.isNull() for t, x in zip(tests, items, strict=True)]
                out = tests[0]
                for t in tests[1:]:
                    out = out | t if found.name == "anycol" else out & t
                return out
            return F.coalesce(self.compare(node.op, node.left, node.right), F.lit(False))
        if isinstance(node, In):
            left = self.value(node.of)
            hits = [F.coalesce(scalar.compared("=", left, self.value(x)), F.lit(False)) for x in node.items]
            out = hits[0]
            for h in hits[1:]:
                out = out | h
            return ~out if node.negated else out
        raise QueryError(f"no condition: {node}")

    def kept(self, node) -> Column:
        """A condition for a filter, where null drops the row as false does: comparisons stay bare, to be pushed down."""
        if isinstance(node, And):
            return self.kept(node.left) & self.kept(node.right)
        if isinstance(node, Or):
            return self.kept(node.left) | self.kept(node.right)
        if isinstance(node, Cmp) and _spread(node.left) is None:
            return self.compare(node.op, node.left, node.right)
        return self.test(node)

    def compare(self, op: str, left, right) -> Column:
        a, b = self.value(left), self.value(right)
        if op in ("like", "nolike"):
            if b.literal is not None:
                hit = text(a).rlike(scalar.glob_regex(str(b.literal)))
            else:
                pattern = F.regexp_replace(text(b), r"([.^$+(){}\[\]|])", r"\\$1")
                pattern = F.replace(F.replace(pattern, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
                hit = F.call_function("rlike", text(a), F.concat(F.lit("(?s)^"), pattern, F.lit("$")))
            return hit if op == "like" else ~hit
        if op in ("reglike", "noreglike"):
            if b.literal is not None:
                hit = text(a).rlike(scalar.java_regex(str(b.literal)))
            else:
                hit = F.call_function("rlike", text(a), text(b))
            return hit if op == "reglike" else ~hit
        return scalar.compared(op, a, b)


def _spread(node) -> Call | None:
    return node if isinstance(node, Call) and node.name in ("anycol", "allcol") else None


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if DATE in (a.kind, b.kind) and op in "+-":
        if a.kind == DATE and b.kind in NUMBERS:
            seconds = number(b).cast("decimal(18,6)")
            return Val(a.col + F.make_interval(secs=seconds if op == "+" else -seconds), DATE, a.layout)
        if a.kind == b.kind == DATE and op == "-":
            return Val(number(a) - number(b), DOUBLE)
    if op == "+" and (a.kind not in NUMBERS or b.kind not in NUMBERS):
        return Val(F.concat(text(a), text(b)), STRING)
    exact = {a.kind, b.kind} <= {LONG, "INTEGER"} and op in "+-*"
    x, y = (a.col.cast("long"), b.col.cast("long")) if exact else (number(a), number(b))
    out = {
        "+": lambda: x + y,
        "-": lambda: x - y,
        "*": lambda: x * y,
        "/": lambda: x / F.when(y != 0, y),
        "^": lambda: F.pow(x, y),
    }[op]()
    return Val(out, LONG if exact else DOUBLE)


class Plan:
    def __init__(self, spark: SparkSession, found: dict[str, str], sources: list, options: Options):
        self.spark, self.clauses, self.sources, self.options = spark, found, sources, options
        self.names: dict[str, int] = {}
        self.headings: list[str] = []
        self.fields: list[Val] = []
        self.ragged = False
        self.vars: dict[str, Val] = {}
        self.macros = self._macros(options.macros)
        self.group_nodes: list = []
        self.uses_line = bool(re.search(r"@(line|fileline)\b", self._all_text(), re.I))

    def _all_text(self) -> str:
        return " ".join([*self.clauses.values(), self.options.variables, self.options.macros])

    # names

    def _macros(self, spec: str) -> dict:
        out = {}
        for part in split_outside(spec, ";") if spec else []:
            name, _, body = part.partition(":")
            name = name.strip().lower()
            if name in scalar.FUNCTIONS or name in AGGREGATES | ANALYTIC | HIERARCHY | MACROS | SIDE:
                raise QueryError(f"{name} is a function already")
            out[name] = syntax.expression(body)
        return out

    def normal(self, node):
        """Names become field numbers, macros their bodies, static variables their values."""

        def change(x):
            if isinstance(x, Field) and isinstance(x.ref, str) and x.ref in self.names:
                return Field(self.names[x.ref])
            if isinstance(x, Var) and x.name in self.names and x.name not in RESERVED:
                return Field(self.names[x.name])
            if isinstance(x, Call) and x.name in self.macros:
                return self._inlined(x)
            return None

        return syntax.rebuilt(node, change)

    def _inlined(self, call: Call):
        body = self.macros[call.name]
        params = list(dict.fromkeys(x.name for x in syntax.walk(body) if isinstance(x, Param)))
        defaults = {x.name: x.default for x in syntax.walk(body) if isinstance(x, Param) and x.default is not None}
        given = dict(zip(params, call.args, strict=False))

        def change(x):
            if isinstance(x, Param):
                if x.name in given:
                    return self.normal(given[x.name])
                if x.name in defaults:
                    return self.normal(syntax.expression(defaults[x.name]))
                raise QueryError(f"{call.name} needs {x.name}")
            return None

        return self.normal(syntax.rebuilt(body, change))

    def constant(self, node) -> int:
        if isinstance(node, Lit) and not isinstance(node.value, str):
            return int(node.value)
        if isinstance(node, Each) and node.mark == "%":
            return len(self.group_nodes) or len(self.fields)
        if isinstance(node, Neg):
            return -self.constant(node.of)
        if isinstance(node, Bin):
            a, b = self.constant(node.left), self.constant(node.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": int(a / b) if b else 0, "^": a**b}[node.op]
        raise QueryError(f"expected a whole number: {node}")

    def heading(self, place: int) -> str:
        return self.headings[place - 1] if 0 < place <= len(self.headings) else ""

    # fields and variables

    def field_value(self, node: Field) -> Val:
        if isinstance(node.ref, str):
            raise QueryError(f"no such field: {node.ref}")
        if node.ref == 0:
            return Val(F.col("_raw"), STRING)
        if node.ref <= len(self.fields):
            return self.fields[node.ref - 1]
        return Val(F.get("_f", F.lit(node.ref - 1)), STRING) if self.ragged else Val(F.lit(None).cast("string"), STRING)

    def last_value(self, node: Last) -> Val:
        if self.ragged:
            return Val(F.get("_f", F.size("_f") - 1 - node.back), STRING)
        place = len(self.fields) - node.back
        return self.fields[place - 1] if place >= 1 else Val(F.lit(None).cast("string"), STRING)

    def width_value(self) -> Val:
        return Val(F.size("_f").cast("long"), LONG) if self.ragged else constant(len(self.fields))

    def variable_value(self, name: str) -> Val:
        if name in self.vars:
            return self.vars[name]
        if name == "RAW":
            return Val(F.col("_raw"), STRING)
        if name == "FILE":
            return Val(F.regexp_extract(F.col("_file"), r"([^/]*)$", 1), STRING)
        if name == "FILEID":
            return Val(F.col("_fileid").cast("long"), LONG)
        if name in ("LINE", "FILELINE", "ROW", "DUPID", "LEVEL", "NODEID", "ISLEAF"):
            return Val(F.col(f"_{name.lower()}"), LONG)
        raise QueryError(f"no such variable: @{name}")

    # scan and parse

    def scan(self) -> DataFrame:
        mode = parsing.mode(self.clauses.get("parse"))
        self.mode = mode
        if all(isinstance(s, Table) for s in self.sources):
            return self._tables(mode)
        parts, before = [], 0
        many = len(self.sources) > 1
        for n, source in enumerate(self.sources, 1):
            if isinstance(source, Table):
                raise QueryError("tables and texts cannot be mixed in one query")
            rows = source.rows(self.spark)
            single = isinstance(source, Lines) or (isinstance(source, Text) and many)
            if single:
                rows = rows.withColumn("_fileid", F.lit(n))
            elif "@fileid" in self._all_text().lower() or self.uses_line or self.options.nameline:
                rows = numbered_files(rows)
            else:
                rows = rows.withColumn("_fileid", F.lit(n))
            if isinstance(source, Text) and source.whole and mode.kind == "regex":
                # a pattern may cross lines: each match is a record
                hits = F.regexp_extract_all(F.col("_raw"), F.lit(mode.pattern), F.lit(0))
                rows = rows.select(F.posexplode(hits).alias("_hit", "_raw"), "_file", "_pos", "_fileid").withColumn(
                    "_pos", F.col("_pos").withField("at", F.col("_pos.at") * (1 << 20) + F.col("_hit"))
                ).drop("_hit")
            parts.append(rows.select("_raw", "_file", "_fileid", "_pos"))
        del before
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        head = None
        if self.options.nameline or self.options.skip:
            first = self.options.skip + bool(self.options.nameline)
            rows = numbering.heads(rows, first)
            if self.options.nameline:
                head = rows.where(F.col("_head") == first).orderBy("_fileid").select("_raw").first()
            rows = rows.where(F.col("_head").isNull()).drop("_head")
        return self._parsed(rows, mode, head[0] if head else None)

    def _tables(self, mode) -> DataFrame:
        parts = []
        for n, s in enumerate(self.sources, 1):
            order = [s.order] if isinstance(s.order, str) else list(s.order or [])
            frame = s.frame
            arrival = F.lit(0).cast("long") if frame.isStreaming else F.monotonically_increasing_id()
            columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(frame.columns, 1)]
            place = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.struct(arrival.alias("at"))
            raw = raw_of(frame)
            parts.append(frame.select(*columns, raw.alias("_raw"), F.lit(s.name).alias("_file"), F.lit(n).alias("_fileid"), place.alias("_pos")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        frame = self.sources[0].frame
        if "parse" in self.clauses and len(frame.columns) == 1:
            return self._parsed(rows.drop("_c1"), mode, None)
        if "parse" in self.clauses:
            raise QueryError("a table with several columns needs no parse clause")
        self.mode = parsing.Mode("table")
        self.headings = list(frame.columns)
        self.names = {c.upper(): i for i, c in enumerate(frame.columns, 1)}
        kinds = [kind_of(f.dataType) for f in frame.schema.fields]
        self.fields = [Val(F.col(f"_c{i}"), k) for i, k in enumerate(kinds, 1)]
        self._assign_types()
        return rows

    def _parsed(self, rows: DataFrame, mode, head: str | None) -> DataFrame:
        raw = F.col("_raw")
        if mode.kind == "quick":
            self.fields = [Val(raw, STRING)]
            return rows.where(parsing.quick(raw, mode))
        if mode.kind in ("regex", "wildcard"):
            if mode.kind == "regex":
                pattern, names = mode.pattern, mode.names
                width = len(names)
            else:
                pattern, width = parsing.wildcard_regex(mode)
                names = ("",) * width
            rows = rows.where(raw.rlike(pattern))
            columns = [F.regexp_extract(raw, pattern, i) for i in range(1, width + 1)] or [F.regexp_extract(raw, pattern, 0)]
            if head is not None and mode.kind == "wildcard":
                found = re.search(pattern.replace("(?s)", ""), head, re.S)
                names = tuple(g.strip().upper() for g in found.groups()) if found else names
            rows = rows.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(columns, 1)])
            self.fields = [Val(F.col(f"_c{i}"), STRING) for i in range(1, len(columns) + 1)]
        else:
            split = parsing.delimited(raw, mode) if mode.kind == "delimiter" else F.array(raw)
            rows = rows.withColumn("_f", split)
            names = ()
            if head is not None:
                got = self.spark.createDataFrame([(head,)], "_raw string").select(
                    parsing.delimited(F.col("_raw"), mode) if mode.kind == "delimiter" else F.array("_raw")
                ).first()[0]
                names = tuple(x.strip().upper() for x in got)
            if rows.isStreaming:  # nothing can be looked at: the fields that the query names, as texts
                sizes = [int(x) for x in re.findall(r"@(?:field)?(\d+)", self._all_text(), re.I)]
            else:
                sizes = [r[0] for r in rows.select(F.size("_f")).limit(max(1, self.options.detect_rows)).collect()]
            width = len(names) or max(sizes, default=1)
            self.ragged = not names and mode.kind == "delimiter"
            if rows.isStreaming and self.ragged and "%" in self._all_text():
                raise QueryError("the number of fields of a stream is not known")
            if self.ragged and "%" in self._all_text():
                # the widest of all rows, as items up to the last field are asked for
                width = max(width, rows.agg(F.max(F.size("_f"))).first()[0] or 0)
            self.fields = [Val(F.get("_f", F.lit(i)), STRING) for i in range(width)]
        self.names = {n: i for i, n in enumerate(names, 1) if n}
        self.headings = [n or f"@FIELD{i}" for i, n in enumerate(names or [""] * len(self.fields), 1)]
        if not self.options.textonly and not rows.isStreaming:
            self._detect(rows)
        self._assign_types()
        return rows

    def _detect(self, rows: DataFrame) -> None:
        sample = rows.select(*[v.col.alias(f"s{i}") for i, v in enumerate(self.fields)]).limit(max(1, self.options.detect_rows)).collect()
        for i, v in enumerate(self.fields):
            kind, layout = None, None
            for row in sample:
                value = row[i]
                if value is None:
                    continue
                k, form = detected(value)
                kind = k if kind is None else common(kind, k)
                layout = layout or form
            if kind not in (None, STRING):
                self.fields[i] = self._as(v, kind, layout)

    def _as(self, v: Val, kind: str, layout: str | None) -> Val:
        """v in another type; of a parsed field its text is kept, which is what it prints as."""
        raw = v.col if v.kind == STRING and self.mode.kind != "table" else None
        if kind == DATE:
            when = dates.parsed(text(v), layout) if layout else stamp(v)
            return Val(when, DATE, layout, raw=text(v) if v.kind == STRING else None)
        return Val(typed(v, kind), kind, raw=raw)

    def _assign_types(self) -> None:
        for part in split_outside(self.clauses.get("set", ""), ","):
            if not part.strip():
                continue
            m = re.fullmatch(r"\s*@?(\w+)\s+(\w+)(?:\s+'((?:\\.|[^'])*)')?\s*", part)
            if not m or m[2].upper() not in TYPES:
                raise QueryError(f"cannot read the type: {part}")
            ref = m[1].upper().removeprefix("FIELD")
            place = int(ref) if ref.isdigit() else self.names.get(m[1].upper())
            if not place or place > len(self.fields):
                raise QueryError(f"no such field: {m[1]}")
            v = self.fields[place - 1]
            plain = Val(v.raw, STRING) if v.raw is not None else v
            self.fields[place - 1] = self._as(plain, m[2].upper(), m[3])

    # stages before the group

    def number_lines(self, rows: DataFrame) -> DataFrame:
        """Numbers are made only where a query shows them, or for hierarchies; order alone is that of ORDER."""
        if not self.uses_line and "tree" not in self.clauses:
            return rows
        if rows.isStreaming:
            raise QueryError("rows of a stream have no line numbers")
        return numbering.numbered(rows, "_line", "_fileline")

    def needs_order(self) -> bool:
        """Whether the result depends on the order of rows."""
        return self.uses_line or self._order_shows()

    def _order_shows(self) -> bool:
        whole = self._all_text().lower()
        return bool(
            "tree" in self.clauses or "@r[" in whole or "unique" in self.clauses
            or ":" in self.options.variables.replace("::", "") and self.options.variables.count(":") > 1
            or re.search(r"\br(count|members?|memberid)\s*\(", whole) or "grouplist" in whole or self.options.variables.startswith("r:")
        )

    def add_variables(self, rows: DataFrame) -> DataFrame:
        self.side_vars: list = []
        spec = [p for p in split_outside(self.options.variables, ";") if p.strip()] if self.options.variables else []
        parsed = []
        for part in spec:
            pieces = split_outside(part, ":")
            name = pieces[0].strip().upper()
            if name == "R":
                self.side_vars.append((pieces[1], pieces[2] if len(pieces) > 2 else None, len(parsed)))
                parsed.append(("R", None, None, False))
                continue
            if name in RESERVED:
                raise QueryError(f"@{name} is reserved")
            init = pieces[1] if len(pieces) > 1 else ""
            body = syntax.expression(pieces[2]) if len(pieces) > 2 and pieces[2].strip() else None
            parsed.append((name, init, body, len(pieces) > 3 and pieces[3].strip().lower() == "g"))
        order = {n: i for i, (n, *_) in enumerate(parsed)}
        # those that use none that runs go through the rows together
        together: list[tuple] = []
        for i, (name, init, body, everywhere) in enumerate(parsed):
            if name == "R":
                continue
            first = constant(_number_or_text(init))
            if body is None:
                self.vars[name] = first
                continue
            body = self.normal(body)
            uses = {x.name for x in syntax.walk(body) if isinstance(x, Var)}
            later = {n for n in uses if order.get(n, -1) > i}
            if later:
                raise QueryError(f"@{name} uses @{later.pop()} before it is declared; only 'r:' may")
            if uses & {n for n, *_ in together}:
                rows, together = self._run(rows, together), []
            asked = any(place < i for *_, place in self.side_vars)
            together.append((name, body, first, everywhere, asked))
        rows = self._run(rows, together).drop("_block")
        # an 'r:' expression may use a variable that is declared after it: then its previous value
        for n, (body, test, place) in enumerate(self.side_vars):
            node = self.normal(syntax.expression(body))
            known = {
                Var(v): Val(F.col(f"_v_{v.lower()}_before"), self.vars[v].kind)
                for v, i in order.items() if v != "R" and i > place and f"_v_{v.lower()}_before" in rows.columns
            }
            value = text(Scope(self, known).value(node))
            if test:
                value = F.when(Scope(self, known).test(self.normal(syntax.condition(test))), value)
            rows = rows.withColumn(f"_r{n + 1}", value)
        return rows

    def _run(self, rows: DataFrame, variables: list[tuple]) -> DataFrame:
        """rows with the columns of variables (name, body, first value, over all files or each, whether the value before is asked for)."""
        if not variables:
            return rows
        steps = [self._running(name, body, first) for name, body, first, *_ in variables]
        runs = any(s.own for s in steps) or any(asked for *_, asked in variables)
        if runs and "_block" not in rows.columns:
            rows, self.blocks = ordered.blocked(rows, [(F.col(c), False) for c in ORDER])
        blocks = self.blocks if runs else 1
        if blocks > 1:
            sums = rows.groupBy("_fileid", "_block").agg(*[s.of_block.alias(f"_b{i}") for i, s in enumerate(steps)])
            carried = []
            for i, (step, (_, _, _, everywhere, _)) in enumerate(zip(steps, variables, strict=True)):
                before = Window.partitionBy(*([] if everywhere else ["_fileid"])).orderBy("_fileid", "_block")
                carried.append(step.over_blocks(F.col(f"_b{i}"), before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_e{i}"))
            sums = sums.select(F.col("_fileid").alias("_sf"), F.col("_block").alias("_sb"), *carried)
            hit = (F.col("_fileid") == F.col("_sf")) & (F.col("_block") == F.col("_sb"))
            rows = rows.join(F.broadcast(sums), hit, "left").drop("_sf", "_sb")
        for i, (step, (name, _, first, everywhere, asked)) in enumerate(zip(steps, variables, strict=True)):
            keys = ["_fileid", "_block"] if blocks > 1 else [] if everywhere else ["_fileid"]
            window = Window.partitionBy(*keys).orderBy(*ORDER)
            earlier = F.col(f"_e{i}") if blocks > 1 else None
            column = f"_v_{name.lower()}"
            own = step.own(window.rowsBetween(Window.unboundedPreceding, 0)) if step.own else None
            rows = rows.withColumn(column, step.value(own, earlier))
            kind = kind_of(rows.schema[column].dataType)
            self.vars[name] = Val(F.col(column), kind)
            if not asked:
                continue
            previous = F.lag(column, 1).over(window)
            if blocks > 1:
                end = step.value(F.lit(None), earlier) if step.own else earlier
                previous = F.when(F.lag(F.lit(1), 1).over(window).isNull(), end).otherwise(previous)
            start = typed(first, kind) if kind in NUMBERS else text(first)
            rows = rows.withColumn(f"{column}_before", F.coalesce(previous, start))
        return rows.drop(*[f"_e{i}" for i in range(len(steps))])

    def _running(self, name: str, body, first: Val) -> Running:
        me, place = Var(name), F.struct(*ORDER)
        if not any(x == me for x in syntax.walk(body)):
            v = Scope(self).value(body)
            col = v.col if v.kind != DATE else text(v)
            return Running(None, F.max_by(col, place), lambda b, w: F.last(b).over(w), lambda own, earlier: col)
        some = lambda *cols: [c for c in cols if c is not None]
        bare = lambda x: x.args[0] if isinstance(x, Call) and x.name in ("tolong", "toint", "tofloat") else x
        if isinstance(body, Bin) and body.op in "+-" and bare(body.left) == me and not any(x == me for x in syntax.walk(body.right)):
            v = Scope(self).value(body.right)
            if v.kind == STRING and first.kind == STRING and body.op == "+" and bare(body.left) is body.left:
                listed = F.sort_array(F.collect_list(F.struct(*ORDER, text(v).alias("x"))))
                return Running(
                    lambda w: F.array_join(F.collect_list(text(v)).over(w), ""),
                    F.array_join(F.transform(listed, lambda s: s["x"]), ""),
                    lambda b, w: F.array_join(F.collect_list(b).over(w), ""),
                    lambda own, earlier: F.concat(text(first), *[F.coalesce(c, F.lit("")) for c in some(earlier, own)]),
                )
            exact = v.kind in (LONG, "INTEGER") and first.kind == LONG
            added = F.coalesce(v.col if exact else number(v), F.lit(0))
            start = first.col if exact else number(first)

            def total(own: Column, earlier: Column | None) -> Column:
                sums = [F.coalesce(c, F.lit(0)) for c in some(earlier, own)]
                held = sums[0] if len(sums) == 1 else sums[0] + sums[1]
                return start + held if body.op == "+" else start - held

            return Running(lambda w: F.sum(added).over(w), F.sum(added), lambda b, w: F.sum(b).over(w), total)
        if isinstance(body, Call) and body.name in ("greatest", "least") and len(body.args) == 2 and me in body.args:
            other = number(Scope(self).value(body.args[0] if body.args[1] == me else body.args[1]))
            over, of = (F.max, F.greatest) if body.name == "greatest" else (F.min, F.least)
            return Running(
                lambda w: over(other).over(w), over(other), lambda b, w: over(b).over(w),
                lambda own, earlier: of(number(first), *some(earlier, own)),
            )
        if isinstance(body, Call) and body.name == "when" and len(body.args) == 3 and body.args[2] == me:
            v = Scope(self).value(body.args[1])
            kept = F.when(Scope(self).test(body.args[0]), text(v))
            return Running(
                lambda w: F.last(kept, ignorenulls=True).over(w), F.max_by(kept, F.when(kept.isNotNull(), place)),
                lambda b, w: F.last(b, ignorenulls=True).over(w), lambda own, earlier: F.coalesce(*some(own, earlier), text(first)),
            )
        raise QueryError(f"@{name}: this recurrence has no declarative form")

    # side works

    def side_sets(self, rows: DataFrame) -> list[dict]:
        """Per side set: frame with _s<k> columns, names, and whether a row may see it (None: always)."""
        sets = []
        if self.side_vars:
            cols = [f"_r{n + 1}" for n in range(len(self.side_vars))]
            frame = rows.select(F.struct(*ORDER).alias("_sline"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(cols, 1)])
            sets.append({"frame": frame, "names": {}, "kinds": [STRING] * len(cols), "sees": "<=", "file": None, "plain": True})
        for part in split_outside(self.clauses.get("meanwhile", ""), ";"):
            if not part.strip():
                continue
            selection, _, condition = _where(part)
            items = [_aliased(x) for x in split_outside(selection, ",")]
            frame = rows
            guard = None
            if condition:
                node = self.normal(syntax.condition(condition))
                guard = _file_guard(node)
                for leaf in _conjuncts(node):
                    if _sides(leaf):
                        frame = self._semi(frame, leaf, sets)
                    else:
                        frame = frame.where(Scope(self).kept(leaf))
            values = [Scope(self).value(self.normal(syntax.expression(e))) for e, _ in items]
            names = {}
            for i, (e, alias) in enumerate(items, 1):
                for n in {x for x in (alias.upper(), e.strip().upper().removeprefix("@")) if x and not x.isdigit()}:
                    names[n] = i
            cols = [v.col.alias(f"_s{i}") for i, v in enumerate(values, 1)]
            sets.append({"frame": frame.select(F.struct(*ORDER).alias("_sline"), *cols), "names": names, "kinds": [v.kind for v in values], "sees": "<", "file": guard, "plain": condition is None or not condition.strip()})
        return sets

    def _side_column(self, s: Side, sets: list[dict]) -> tuple[str, str]:
        if not 0 < s.set_id <= len(sets):
            raise QueryError(f"no side set {s.set_id}")
        found = sets[s.set_id - 1]
        place = s.field if isinstance(s.field, int) else found["names"].get(s.field)
        if not place or place > len(found["kinds"]):
            raise QueryError(f"no field {s.field} in side set {s.set_id}")
        return f"_s{place}", found["kinds"][place - 1]

    def _visible(self, found: dict, main_file: int | None) -> bool:
        """Whether rows of main_file see the whole side set, as it was read before."""
        return found["file"] is not None and main_file is not None and found["file"] < main_file

    def _semi(self, rows: DataFrame, leaf, sets: list[dict], main_file: int | None = None) -> DataFrame:
        """IN and NOIN on a side set."""
        if not isinstance(leaf, In) or not isinstance(leaf.items, Side):
            raise QueryError("a side set's filter may use IN and NOIN only")
        column, kind = self._side_column(leaf.items, sets)
        found = sets[leaf.items.set_id - 1]
        left = Scope(self).value(leaf.of)
        whole = self._visible(found, main_file)
        if leaf.negated and not whole and found["plain"]:
            side_text = found["frame"].select(F.col("_sline"), F.col(column).cast("string").alias("_st"))
            first = side_text.groupBy("_st").agg(F.min("_sline").alias("_first"))
            joined = rows.join(first, text(left) == F.col("_st"), "left")
            seen = F.col("_first") <= F.struct(*ORDER) if found["sees"] == "<=" else F.col("_first") < F.struct(*ORDER)
            return joined.where(F.col("_st").isNull() | ~seen).select(*rows.columns)
        side = found["frame"]
        hit = scalar.compared("=", left, Val(F.col(column), kind))
        if whole:
            side = side.select(column).distinct()
        else:
            # of equal values the first is seen first
            side = side.groupBy(column).agg(F.min("_sline").alias("_sline"))
            hit = hit & (F.col("_sline") <= F.struct(*ORDER) if found["sees"] == "<=" else F.col("_sline") < F.struct(*ORDER))
        return rows.join(side, hit, "left_anti" if leaf.negated else "left_semi")

    def join_sides(self, rows: DataFrame, leaves: list, sets: list[dict], main_file: int | None, keep: bool) -> tuple[DataFrame, dict]:
        """Joins of all conditions that name side sets; known: the side columns that later stages may use."""
        known: dict = {}
        pending: list = []
        for leaf in leaves:
            if isinstance(leaf, In) and isinstance(leaf.items, Side):
                rows = self._semi(rows, leaf, sets, main_file)
            else:
                pending.append((leaf, {s.set_id for s in _sides(leaf)}))
        joined: set[int] = set()
        while pending:
            # the next set that a condition ties to the row and to sets joined before
            n = next((k for _, ids in pending for k in sorted(ids) if ids <= joined | {k}), None)
            if n is None:
                raise QueryError("a side set is tied to another side set only, not to the row")
            joined.add(n)
            tests = [leaf for leaf, ids in pending if ids <= joined]
            pending = [(leaf, ids) for leaf, ids in pending if not ids <= joined]
            found = sets[n - 1]
            side = found["frame"]
            renamed = side.select(*[F.col(c).alias(f"_j{n}{c}") for c in side.columns if c != "_sline" or not self._visible(found, main_file)])
            mine = {}
            for i, kind in enumerate(found["kinds"], 1):
                v = Val(F.col(f"_j{n}_s{i}"), kind)
                mine[Side(n, i)] = v
                for name, place in found["names"].items():
                    if place == i:
                        mine[Side(n, name)] = v
            condition = None
            for t in tests:
                both = Scope(self, known | mine)
                c = _bare(both.test(t), both, t)
                condition = c if condition is None else condition & c
            if not self._visible(found, main_file):
                line, own = F.col(f"_j{n}_sline"), F.struct(*ORDER)
                condition = condition & (line <= own if found["sees"] == "<=" else line < own)
            rows = rows.join(renamed, condition, "inner" if keep or pending else "left_semi")
            if keep or pending:
                known.update(mine)
        return rows, known

    # items

    def each(self, call: Call) -> list:
        """The expressions that foreach and its kin stand for."""
        args = call.args
        begin, end, body = args[0], args[1], args[2]
        step = abs(self.constant(args[3])) or 1 if len(args) > 3 and not isinstance(args[3], Field) else 1
        if self.group_nodes:
            a, b, step = self.constant(begin), self.constant(end), 1
            pick = lambda i: self.group_nodes[i - 1]
        else:
            ta, tb = _tail(begin), _tail(end)
            if self.ragged and ta is not None and tb is not None:
                places = range(ta, tb - 1, -step) if ta >= tb else range(ta, tb + 1, step)
                return [self._placed(body, Last(k), k) for k in places]
            a, b = self.constant(begin), self.constant(end)
            pick = Field
        places = range(max(a, 1), b + 1, step) if a <= b else range(a, max(b, 1) - 1, -step)
        return [self._placed(body, pick(i), i) for i in places]

    def _placed(self, body, item, place: int):
        def change(x):
            if isinstance(x, Each) and x.mark == "$":
                return item
            if isinstance(x, Each) and x.mark == "#":
                return Lit(place)
            return None

        return syntax.rebuilt(body, change)

    def spread(self, node) -> list:
        """A selection item as one or more items; foreach inside calls becomes arguments."""
        node = self.normal(node)
        if isinstance(node, Call) and node.name == "foreach":
            return self.each(node)

        def change(x):
            if isinstance(x, Call) and x.name in ("calcol", "concatcol"):
                return self._horizontal(x)
            if isinstance(x, Call) and any(isinstance(a, Call) and a.name == "foreach" for a in x.args):
                flat = tuple(y for a in x.args for y in (self.each(a) if isinstance(a, Call) and a.name == "foreach" else [syntax.rebuilt(a, change)]))
                return Call(x.name, (flat,))
            return None

        return [syntax.rebuilt(node, change)]

    def _horizontal(self, call: Call):
        items = self.each(call)
        rest = call.args[3:]
        if call.name == "concatcol" and self.ragged:
            # a row's own fields only
            return Call("_concatcol", ((rest[1] if len(rest) > 1 else Lit(""), *items),))
        if call.name == "concatcol":
            mark = rest[1] if len(rest) > 1 else Lit("")
            out = []
            for x in items:
                out += [x, mark]
            return Call("concat", (tuple(out[:-1]) or (Lit(""),),)) if len(items) > 1 else items[0]
        operation = str(rest[1].value) if len(rest) > 1 and isinstance(rest[1], Lit) else "SUM"
        return Call(f"_calcol_{operation.lower()}", (tuple(items),))


for _op in ("sum", "average", "max", "min", "count", "uniquecount"):

    def _build(*items: Val, op: str = _op) -> Val:
        return scalar._reduced(F.array(*[text(x) for x in items]), op)

    scalar.FUNCTIONS[f"_calcol_{_op}"] = _build


def _joined(mark: Val, *items: Val) -> Val:
    return Val(F.array_join(F.array(*[text(x) for x in items]), str(mark.literal)), STRING)


scalar.FUNCTIONS["_concatcol"] = _joined


def detected(value: str) -> tuple[str, str | None]:
    """Type and date layout of a value: date, whole number, number, else text."""
    layout = dates.detect(value)
    if layout:
        return DATE, layout
    if re.fullmatch(r"[+-]?\d{1,18}", value):
        return LONG, None
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
        return DOUBLE, None
    return STRING, None


def _number_or_text(value: str):
    value = value.strip()
    if re.fullmatch(r"[+-]?\d+", value):
        return int(value)
    if re.fullmatch(r"[+-]?\d*\.\d+", value):
        return float(value)
    return syntax.unquoted(value) if len(value) > 1 and value[0] == value[-1] == "'" else value


def _where(part: str) -> tuple[str, str, str]:
    m = re.search(r"\swhere\s", part, re.I)
    return (part[: m.start()], "where", part[m.end() :]) if m else (part, "", "")


def _aliased(item: str) -> tuple[str, str]:
    m = re.search(r"\s+as\s+(\w+)\s*$", item, re.I)
    return (item[: m.start()].strip(), m[1]) if m else (item.strip(), "")


def _conjuncts(node) -> list:
    return [*_conjuncts(node.left), *_conjuncts(node.right)] if isinstance(node, And) else [node]


def _sides(node) -> list:
    return [x for x in syntax.walk(node) if isinstance(x, Side)]


def _file_guard(node) -> int | None:
    """k if the condition demands @fileid = k."""
    for leaf in _conjuncts(node):
        if isinstance(leaf, Cmp) and leaf.op == "=" and leaf.left == Var("FILEID") and isinstance(leaf.right, Lit):
            return int(leaf.right.value)
    return None


def _bare(condition: Column, scope: Scope, node) -> Column:
    """An equality without its null guard, so that the join is planned on keys."""
    if isinstance(node, Cmp) and node.op == "=" and _spread(node.left) is None:
        return scope.compare("=", node.left, node.right)
    return condition


def _tail(node) -> int | None:
    """k for '% - k'."""
    if isinstance(node, Each) and node.mark == "%":
        return 0
    if isinstance(node, Bin) and node.op == "-" and isinstance(node.right, Lit):
        inner = _tail(node.left)
        return None if inner is None else inner + int(node.right.value)
    return None


def has(node, names: frozenset) -> bool:
    return any(isinstance(x, Call) and x.name in names for x in syntax.walk(node))


__all__ = ["Options", "Plan", "Result", "Scope", "Sorted", "tree"]
