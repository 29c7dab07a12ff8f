"""Assembles the stages of a query after the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import dates
from siftline.functions.values import DATE, DOUBLE, LONG, STRING, Val, number, text, typed, whole
from siftline.operators import numbering, ordered, tree
from siftline.plans import syntax
from siftline.plans.clauses import QueryError, clauses, split_outside
from siftline.plans.planner import (
    AGGREGATES, ANALYTIC, HIERARCHY, ORDER, SIDE, Options, Plan, Result, Scope, _aliased, _conjuncts, _file_guard, _sides, _where, has,
)
from siftline.plans.syntax import Bin, Call, Each, Field, In, Last, Lit, Neg, Side, Sorted, Var

#: Rows at the edges of blocks that are sent to all tasks at most.
BROADCAST_EDGES = 2_000


def build(spark: SparkSession, query: str | dict[str, str], sources: list, options: Options | None = None) -> Result:
    found = clauses(query) if isinstance(query, str) else dict(query)
    return Builder(Plan(spark, found, sources, options or Options())).result()


class Builder:
    def __init__(self, plan: Plan):
        self.plan, self.clauses = plan, plan.clauses
        self.known: dict = {}

    @property
    def scope(self) -> Scope:
        return Scope(self.plan, self.known)

    def result(self) -> Result:
        plan = self.plan
        rows = plan.scan()
        if plan.mode.kind == "quick" and "parse" in self.clauses:
            return Result(rows.select(F.col("_raw").alias("@RAW")), ["@RAW"])
        rows = plan.add_variables(plan.number_lines(rows))
        sets = plan.side_sets(rows) if plan.side_vars or "meanwhile" in self.clauses else []
        plan.group_nodes = [plan.normal(syntax.expression(x)) for x in split_outside(self.clauses.get("group", ""), ",") if x.strip()]
        items = self.items(self.clauses.get("select") or "@raw")
        keys = self.sort_keys(len(items))
        having, qualify, rows = self.filtered(rows, sets, items)
        rows = self.side_accessors(rows, sets, [n for n, _ in items])
        if re.search(r"@row\b", plan._all_text(), re.I):
            rows = numbering.numbered(rows, "_row")
        nodes = [n for n, _ in items] + [k for k, _ in keys if not isinstance(k, int)] + having + qualify
        grouped = bool(plan.group_nodes) or any(has(n, AGGREGATES) for n in nodes)
        rows = rows.withColumn("_dupid", F.lit(1).cast("long")) if "@dupid" in plan._all_text().lower() and "duplicate" not in self.clauses else rows
        if not grouped:
            rows = self.duplicated(rows)
        if "tree" in self.clauses:
            if grouped or "unique" in self.clauses or any(has(n, ANALYTIC) for n in nodes):
                raise QueryError("tree cannot be combined with group, unique or analytic functions")
            rows = self.treed(rows, nodes)
        if grouped:
            rows = self.grouped(rows, nodes)
            for h in having:
                rows = rows.where(self.scope.kept(h))
            rows = self.duplicated(rows)
        rows = self.windowed(rows, nodes)
        for q in qualify:
            rows = rows.where(self.scope.kept(q))
        return self.projected(rows, items, keys)

    # clauses

    def items(self, clause: str) -> list[tuple]:
        out = []
        for part in split_outside(clause, ","):
            if not part.strip():
                continue
            e, alias = _aliased(part)
            nodes = self.plan.spread(syntax.expression(e))
            for n, node in enumerate(nodes, 1):
                name = (alias if len(nodes) == 1 else f"{alias}{n}") if alias else self.heading(node, e if len(nodes) == 1 else None)
                out.append((node, name))
        return out

    def heading(self, node, source: str | None) -> str:
        if isinstance(node, Field) and isinstance(node.ref, int) and self.plan.heading(node.ref):
            return self.plan.heading(node.ref)
        return source.strip().upper() if source else written_out(node)

    def sort_keys(self, width: int) -> list[tuple]:
        out = []
        for part in split_outside(self.clauses.get("sort", ""), ","):
            if not part.strip():
                continue
            m = re.fullmatch(r"(.*?)(?:\s+(asc|desc))?\s*", part, re.I | re.S)
            descending = (m[2] or "").lower() == "desc"
            if m[1].strip().isdigit():
                place = int(m[1])
                if not 0 < place <= width:
                    raise QueryError(f"no selection {place} to sort by")
                out.append((place, descending))
                continue
            out += [(n, descending) for n in self.plan.spread(syntax.expression(m[1]))]
        return out

    def filtered(self, rows: DataFrame, sets: list, items: list) -> tuple[list, list, DataFrame]:
        plan, having, qualify, sides, plain = self.plan, [], [], [], []
        clause = self.clauses.get("filter")
        for leaf in _conjuncts(plan.normal(syntax.condition(clause))) if clause else []:
            if has(leaf, ANALYTIC):
                qualify.append(leaf)
            elif has(leaf, AGGREGATES):
                if isinstance(leaf, syntax.Or) and _mixed(leaf):
                    raise QueryError("OR between aggregates and rows has no meaning: a row cannot be judged by its group")
                having.append(leaf)
            elif _sides(leaf):
                sides.append(leaf)
            else:
                plain.append(leaf)
        for leaf in plain:
            rows = rows.where(Scope(plan).kept(leaf))
        if sides:
            guards = [g for g in map(_file_guard, plain) if g is not None]
            nodes = [n for n, _ in items] + plan.group_nodes
            keep = not plan.group_nodes or any(_sides(n) for n in nodes)
            rows, self.known = plan.join_sides(rows, sides, sets, guards[0] if guards else None, keep)
        return having, qualify, rows

    def side_accessors(self, rows: DataFrame, sets: list, nodes: list) -> DataFrame:
        """rcount, rmember, rmembers and rmemberid over the rows that a side set holds so far."""
        calls = dict.fromkeys(x for n in nodes for x in syntax.walk(n) if isinstance(x, Call) and x.name in SIDE)
        for k, call in enumerate(calls):
            args = list(call.args)
            if not args:
                self.known[call] = Val(F.lit(len(sets)).cast("long"), LONG)
                continue
            n = self.plan.constant(args[0])
            ref = args[1] if len(args) > 1 else None
            place = Side(n, ref.ref if isinstance(ref, Field) else self.plan.constant(ref) if ref is not None else 1)
            column, _ = self.plan._side_column(place, sets)
            side = sets[n - 1]["frame"].select(F.col("_sline").alias("_at"), F.col(column).cast("string").alias("_sv"))
            own = self.scope.value(args[2]) if len(args) > 2 else None
            name, sees_own = f"_q{k}", sets[n - 1]["sees"] == "<="
            if call.name == "rcount":
                rows = self._seen(rows, side, sees_own, name, text(own) if own is not None else None)
                self.known[call] = Val(F.col(name), LONG)
                continue
            # members by their number in the side set, which is in order of rows
            numbers = side.withColumn("_id", F.row_number().over(Window.orderBy("_at")).cast("long"))
            if call.name == "rmemberid":
                firsts = numbers.groupBy("_sv").agg(F.min("_id").alias(name), F.min("_at").alias("_at"))
                before = F.col("_at") <= F.struct(*ORDER) if sees_own else F.col("_at") < F.struct(*ORDER)
                rows = rows.join(firsts, (text(own) == F.col("_sv")) & before, "left").drop("_sv", "_at")
                self.known[call] = Val(F.coalesce(name, F.lit(-1).cast("long")), LONG)
                continue
            rows = self._seen(rows, side, sees_own, f"{name}_n", None)
            seen = F.col(f"{name}_n")
            counted = lambda at: F.when(at > 0, at).when(at < 0, seen + 1 + at)  # noqa: B023, E731
            member = numbers.select("_id", F.col("_sv").alias(name))
            if call.name == "rmember":
                at = counted(whole(own))
                rows = rows.withColumn("_want", F.when((at >= 1) & (at <= seen), at))
                rows = rows.join(member, F.col("_want") == F.col("_id"), "left").drop("_id", "_want")
                self.known[call] = Val(F.when(F.col(f"{name}_n") > 0, F.coalesce(name, F.lit(None).cast("string"))), STRING)
                continue
            last = self.scope.value(args[3]) if len(args) > 3 else None
            mark = str(self.scope.value(args[4]).literal) if len(args) > 4 else "|"
            a, b = counted(whole(own)), counted(whole(last)) if last is not None else seen
            inside = lambda x: F.greatest(F.lit(1).cast("long"), F.least(x, seen))  # noqa: B023, E731
            ids = F.when((seen > 0) & (F.greatest(a, b) >= 1) & (F.least(a, b) <= seen), F.sequence(inside(a), inside(b)))
            ids = F.transform(ids, lambda x, i: F.struct(i.alias("i"), x.alias("_id")))
            wanted = rows.select(F.struct(*ORDER).alias("_at"), ids.alias("_ids")).where(F.col("_ids").isNotNull()).dropDuplicates(["_at", "_ids"])
            wanted = wanted.select("_at", "_ids", F.inline("_ids")).join(member, "_id")
            lists = wanted.groupBy("_at", "_ids").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce(name, F.lit("")).alias("x")))).alias(name))
            lists = lists.select("_at", F.col("_ids").alias("_mine"), F.array_join(F.transform(name, lambda s: s["x"]), mark).alias(name))
            rows = rows.join(lists, (F.struct(*ORDER) == F.col("_at")) & ids.eqNullSafe(F.col("_mine")), "left").drop("_at", "_mine")
            self.known[call] = Val(F.coalesce(name, F.lit("")), STRING)
        return rows

    def _seen(self, rows: DataFrame, side: DataFrame, sees_own: bool, name: str, value: Column | None) -> DataFrame:
        """rows with the number of side rows (of a value) before them: a running count over both kinds of rows."""
        wanted = F.coalesce(value, F.lit("\0")) if value is not None else F.lit("")
        asked = rows.select(F.struct(*ORDER).alias("_at"), wanted.alias("_sv")).distinct()
        held = side if value is not None else side.withColumn("_sv", F.lit(""))
        both = asked.withColumn("_one", F.lit(0)).unionByName(held.where(F.col("_sv").isNotNull()).withColumn("_one", F.lit(1)))
        # at the same row, the side row comes first where a row sees itself
        place = F.col("_one").desc() if sees_own else F.col("_one").asc()
        running = F.sum("_one").over(Window.partitionBy("_sv").orderBy("_at", place).rowsBetween(Window.unboundedPreceding, 0))
        counts = both.withColumn(name, running).where("_one = 0").select(F.col("_at").alias("_cat"), F.col("_sv").alias("_csv"), F.col(name).cast("long").alias(name))
        hit = (F.struct(*ORDER) == F.col("_cat")) & (wanted == F.col("_csv"))
        return rows.join(counts, hit, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop("_cat", "_csv")

    def duplicated(self, rows: DataFrame) -> DataFrame:
        clause = self.clauses.get("duplicate")
        if not clause:
            return rows
        times, _, condition = _where(clause)
        n = whole(self.scope.value(self.plan.normal(syntax.expression(times)))).cast("int")
        if condition:
            n = F.when(self.scope.test(self.plan.normal(syntax.condition(condition))), n).otherwise(1)
        copies = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn("_dupid", F.explode(copies)).withColumn("_dupid", F.col("_dupid").cast("long"))
        self.known[Var("DUPID")] = Val(F.col("_dupid"), LONG)
        return rows

    # hierarchy

    def treed(self, rows: DataFrame, nodes: list) -> DataFrame:
        keys: dict[str, list] = {}
        for part in split_outside(self.clauses["tree"], ";"):
            name, _, body = part.partition(":")
            keys[name.strip().lower()] = [self.plan.normal(syntax.expression(x)) for x in split_outside(body, ",")]
        if set(keys) != {"k", "p"} or len(keys["k"]) != len(keys["p"]):
            raise QueryError("tree takes k: and p: with as many expressions each")
        joined = lambda part: F.concat_ws("\x01", *[F.coalesce(text(self.scope.value(n)), F.lit("")) for n in keys[part]])
        rows = rows.withColumn("_key", joined("k")).withColumn("_parent", joined("p"))
        calls = list(dict.fromkeys(x for n in nodes for x in syntax.walk(n) if isinstance(x, Call) and x.name in HIERARCHY))
        carried = []
        for i, call in enumerate(calls):
            rows = rows.withColumn(f"_t{i}", F.coalesce(text(self.scope.value(call.args[0])), F.lit("")))
            carried.append(f"_t{i}")
        rows = tree.expanded(rows, carried, number_nodes="@nodeid" in self.plan._all_text().lower())
        for i, call in enumerate(calls):
            if call.name == "path":
                mark = str(call.args[1].value) if len(call.args) > 1 and isinstance(call.args[1], Lit) else "/"
                col = F.array_join(f"_path__t{i}", mark)
            else:
                col = F.col(f"_root__t{i}" if call.name == "root" else f"_up__t{i}")
            self.known[call] = Val(col, STRING)
        return rows

    # group

    def aggregate(self, call: Call, rows: DataFrame) -> tuple[Column, str]:
        name, args = call.name, list(call.args)
        distinct = bool(args) and args[0] == Field("DISTINCT")
        args = args[1:] if distinct else args
        v = self.scope.value(args[0]) if args else Val(F.lit(1), LONG)
        lined = "_pos" in rows.columns
        if name == "count":
            return F.count(F.lit(1)), LONG
        if name in ("sum", "average"):
            exact = v.kind in (LONG, "INTEGER") and name == "sum"
            total = F.sum(v.col if exact else number(v))
            if name == "average":
                return F.coalesce(total, F.lit(0.0)) / F.count(F.lit(1)), DOUBLE
            return F.coalesce(total, F.lit(0)), LONG if exact else DOUBLE
        if name in ("max", "min"):
            return (F.max if name == "max" else F.min)(v.col), v.kind
        if name == "uniquecount":
            return F.count_distinct(F.coalesce(text(v), F.lit(""))), LONG
        marks = [a for a in args[1:] if isinstance(a, Lit)]
        order = next((a.ref for a in args[1:] if isinstance(a, Field) and a.ref in ("ASC", "DESC")), None)
        mark = str(marks[0].value) if marks else " "
        shown = lambda x: text(Val(x, v.kind, v.layout))
        if order:
            listed = F.sort_array((F.collect_set if distinct else F.collect_list)(v.col), order == "ASC")
            return F.array_join(F.transform(listed, shown), mark), STRING
        if lined:
            listed = F.sort_array(F.collect_list(F.struct(*ORDER, v.col.alias("x"))))
            listed = F.transform(listed, lambda s: s["x"])
        else:
            listed = F.collect_list(v.col)
        listed = F.array_distinct(listed) if distinct else listed
        return F.array_join(F.transform(listed, shown), mark), STRING

    def grouped(self, rows: DataFrame, nodes: list) -> DataFrame:
        plan, keys, after = self.plan, [], {}
        for i, node in enumerate(plan.group_nodes, 1):
            v = self.scope.value(node)
            as_text = v.raw is not None and v.kind == DATE
            keys.append((v.raw if as_text else v.col).alias(f"_g{i}"))
            after[node] = Val(F.col(f"_g{i}"), STRING if as_text else v.kind, None if as_text else v.layout)
        aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
        for i, call in enumerate(dict.fromkeys(x for n in nodes for x in _outermost(n, AGGREGATES, after)), 1):
            col, kind = self.aggregate(call, rows)
            aggs.append(col.alias(f"_a{i}"))
            layout = self.scope.value(call.args[0]).layout if kind == DATE else None
            after[call] = Val(F.col(f"_a{i}"), kind, layout)
        loose = dict.fromkeys(x for n in nodes for x in _loose(n, after))
        for i, node in enumerate(loose, 1):
            v = self.scope.value(node)
            if v.literal is not None:
                after[node] = v
                continue
            as_text = v.raw is not None and v.kind == DATE
            col = v.raw if as_text else v.col
            aggs.append((F.min_by(col, F.struct(*ORDER)) if "_pos" in rows.columns else F.first(col)).alias(f"_n{i}"))
            after[node] = Val(F.col(f"_n{i}"), STRING if as_text else v.kind, v.layout)
        out = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs).where("_rows > 0")
        self.known = after
        return out

    # windows

    def windowed(self, rows: DataFrame, nodes: list) -> DataFrame:
        calls = dict.fromkeys(x for n in nodes for x in syntax.walk(n) if isinstance(x, Call) and x.name in ANALYTIC)
        orders: dict[tuple, list] = {}
        for i, call in enumerate(calls, 1):
            if call.name == "nearby":
                # those of one order go through the rows together
                orders.setdefault(call.parts[1] if len(call.parts) > 1 else (), []).append((f"_w{i}", call))
        for nodes_of, near in orders.items():
            rows = self.nearby(rows, nodes_of, near)
        for i, call in enumerate(calls, 1):
            if call.name == "nearby":
                continue
            if call.name == "uniquecounta":
                # the greatest dense rank of a value is the number of values
                v = F.coalesce(text(self.scope.value(call.parts[1][0])), F.lit(""))
                groups = [self.scope.value(n).col for n in call.parts[0]]
                rows = rows.withColumn(f"_d{i}", F.dense_rank().over(Window.partitionBy(*groups).orderBy(v)))
                rows = rows.withColumn(f"_w{i}", F.max(f"_d{i}").over(Window.partitionBy(*groups)).cast("long"))
                self.known[call] = Val(F.col(f"_w{i}"), LONG)
                continue
            col, kind = self.analytic(call, rows)
            rows = rows.withColumn(f"_w{i}", col)
            self.known[call] = Val(F.col(f"_w{i}"), kind)
        return rows

    def ordering(self, nodes: tuple) -> list[tuple[Column, bool]]:
        """What nodes sort by, and whether descending."""
        return [(self.scope.value(n.of if isinstance(n, Sorted) else n).col, isinstance(n, Sorted) and n.descending) for n in nodes]

    def nearby(self, rows: DataFrame, nodes: tuple, calls: list[tuple[str, Call]]) -> DataFrame:
        """rows with a column for each call of one order over all rows: within blocks by windows, at their edges from other blocks' edges."""
        keys = self.ordering(nodes) + [(F.col(c), False) for c in ORDER if c in rows.columns]
        order = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys] or [F.lit(1)]
        back = [c.asc_nulls_first() if down else c.desc_nulls_last() for c, down in keys] or [F.lit(1)]
        base, blocks = ordered.blocked(rows, keys) if keys else (rows.withColumn("_block", F.lit(0)), 1)
        # rows of each block and of all before it
        before = F.sum("_held").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        held = base.groupBy("_block").agg(F.count(F.lit(1)).alias("_held")).withColumn("_start", F.coalesce(before, F.lit(0)))
        base = base.join(F.broadcast(held), "_block") if blocks > 1 else base
        w = Window.partitionBy("_block").orderBy(*order) if blocks > 1 else Window.orderBy(*order)
        rows = base
        if blocks > 1:
            rows = rows.withColumn("_own", F.row_number().over(w))
        found = []
        for column, call in calls:
            parts = call.parts
            v = self.scope.value(parts[0][0])
            distance = self.plan.constant(parts[2][0]) if len(parts) > 2 and parts[2] else 1
            default = self.scope.value(parts[3][0]) if len(parts) > 3 and parts[3] else None
            if default is not None and default.kind != v.kind and not (default.kind in (LONG, "INTEGER") and v.kind in (LONG, "INTEGER", DOUBLE)):
                v = Val(text(v), STRING)
            moved, fixed = F.lead if distance >= 0 else F.lag, None
            if default is not None and default.literal is not None and v.kind in (STRING, DOUBLE):
                fixed = str(default.literal) if v.kind == STRING else float(default.literal)
            filling = None if default is None else F.lit(fixed) if fixed is not None else typed(default, v.kind)
            far = abs(distance)
            if blocks > 1:
                rows = rows.withColumn(column, moved(v.col, far).over(w))
                found.append((column, v, distance, far, filling))
            elif default is None or fixed is not None:
                rows = rows.withColumn(column, moved(v.col, far, fixed).over(w))
            else:
                place = F.row_number().over(w) + distance
                outside = (place < 1) | (place > F.count(F.lit(1)).over(Window.partitionBy()))
                rows = rows.withColumn(column, F.when(outside, filling).otherwise(moved(v.col, far).over(w)))
            self.known[call] = Val(F.col(column), v.kind)
        for column, v, distance, far, filling in found:
            if not far:
                continue
            # a block's rows that rows of other blocks ask for: its first, or its last
            edge = F.row_number().over(Window.partitionBy("_block").orderBy(*(order if distance > 0 else back)))
            edges = base.withColumn("_edge", edge).where(F.col("_edge") <= far)
            place = F.col("_start") + (F.col("_edge") if distance > 0 else F.col("_held") - F.col("_edge") + 1)
            edges = edges.select((place - distance).alias("_asker"), v.col.alias("_there"), F.lit(True).alias("_is"))
            edges = F.broadcast(edges) if far * blocks <= BROADCAST_EDGES else edges
            rows = rows.join(edges, F.col("_start") + F.col("_own") == F.col("_asker"), "left")
            inside = F.col("_own") <= F.col("_held") - far if distance > 0 else F.col("_own") > far
            there = F.col("_there") if filling is None else F.when(F.col("_is"), F.col("_there")).otherwise(filling.cast(rows.schema[column].dataType))
            rows = rows.withColumn(column, F.when(inside, F.col(column)).otherwise(there)).drop("_asker", "_there", "_is")
        return rows.drop("_block", "_held", "_start", "_own")

    def analytic(self, call: Call, rows: DataFrame) -> tuple[Column, str]:
        parts, name = call.parts, call.name
        tie = [F.col(c) for c in ORDER if c in rows.columns]
        order = lambda nodes: [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in self.ordering(nodes)]
        groups = [self.scope.value(n).col for n in parts[0]]
        if name in ("rank", "denserank"):
            sort = order(parts[1]) if len(parts) > 1 else []
            if name == "rank":
                return F.row_number().over(Window.partitionBy(*groups).orderBy(*(sort + tie or [F.lit(1)]))).cast("long"), LONG
            return F.rank().over(Window.partitionBy(*groups).orderBy(*(sort or [F.lit(1)]))).cast("long"), LONG
        w = Window.partitionBy(*groups)
        v = self.scope.value(parts[1][0]) if len(parts) > 1 and parts[1] else Val(F.lit(1), LONG)
        if name == "counta":
            return F.count(F.lit(1)).over(w), LONG
        if name in ("suma", "averagea"):
            return (F.sum if name == "suma" else F.avg)(number(v)).over(w), DOUBLE
        return (F.max if name == "maxa" else F.min)(v.col).over(w), v.kind

    # output

    def output(self, v: Val) -> Column:
        if v.raw is not None:
            return v.raw
        if v.kind == DATE:
            return dates.shown(v.col, v.layout) if v.layout else v.col
        return v.col

    def projected(self, rows: DataFrame, items: list, keys: list) -> Result:
        lists = [i for i, (n, _) in enumerate(items) if isinstance(n, Call) and n.name == "coltorow"]
        sort = [(k, self.scope.value(k).col if not isinstance(k, int) else None, down) for k, down in keys]
        order = [c.alias(f"_k{i}") for i, (_, c, _) in enumerate(sort) if c is not None]
        trailing = [F.col("_order")] if "_order" in rows.columns else []
        if "_pos" in rows.columns and self.plan.needs_order():
            trailing.append(F.struct(*ORDER).alias("_ord"))
        if lists:
            width = max(len(items[i][0].args) for i in lists)
            rows = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
            trailing.append(F.col("_p"))
        columns, kinds = [], []
        for i, (node, _) in enumerate(items):
            if i in lists:
                parts = [self.scope.value(a) for a in node.args]
                same = len({p.kind for p in parts}) == 1 and parts[0].kind != DATE
                cells = F.array(*[p.col if same else text(p) for p in parts])
                kind = parts[0].kind if same else STRING
                col = F.get(cells, F.col("_p"))
                col = F.when(F.col("_p") >= len(parts), F.lit("")).otherwise(col) if kind == STRING else col
            else:
                v = self.scope.value(node)
                col, kind = self.output(v), STRING if v.raw is not None or v.kind == DATE and v.layout else v.kind
                if lists:
                    blank = F.lit("") if kind == STRING else F.lit(None)
                    col = F.when(F.col("_p") == 0, col).otherwise(blank)
            columns.append(col.alias(f"c{i + 1}"))
            kinds.append(kind)
        sink = None
        for mark in (">", ">>"):
            if mark in self.clauses:
                target = text(self.scope.value(self.plan.normal(syntax.expression(self.clauses[mark]))))
                columns.append(target.alias("_target"))
                sink = ("overwrite" if mark == ">" else "append", "_target")
        out = rows.select(*columns, *order, *trailing)
        names = [n for _, n in items]
        out, names, kinds = self.extra(out, names, kinds)
        width = len(names)
        shown = [f"c{i + 1}" for i in range(width)]
        unique = self.clauses.get("unique")
        if unique is not None:
            flags = unique.lower() or "r"
            if "f" in flags:
                cells = F.array_sort(F.array_distinct(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown])))
                out = out.select(cells.alias("c1"), *[c for c in out.columns if c not in shown])
                names, shown, kinds = ["FIELDS"], ["c1"], ["ARRAY"]
            if "r" in flags or "f" not in flags:
                held = [F.min(c).alias(c) for c in ("_ord",) if c in out.columns]
                held += [F.first(c).alias(c) for c in out.columns if c not in shown and c != "_ord"]
                out = out.groupBy(*shown).agg(*held) if held else out.select(*shown).distinct()
        by = []
        for i, (k, c, down) in enumerate(sort):
            col = F.col(f"c{k}") if c is None else F.col(f"_k{i}")
            by.append(col.desc_nulls_last() if down else col.asc_nulls_first())
        if "_order" in out.columns:
            by.append(F.col("_order"))
        elif "_ord" in out.columns:
            by.append(F.col("_ord"))
        if lists and by and "_p" in out.columns:
            by.append(F.col("_p"))
        if by:
            out = out.orderBy(*by)
        out = self.limited(out)
        report = self.report(out, shown, names)
        final = _distinct_names(names)
        frame = out.select(*[F.col(c).alias(n) for c, n in zip(shown, final, strict=True)], *([F.col("_target")] if sink else []))
        return Result(frame, final, report, sink, rows)

    def extra(self, out: DataFrame, names: list, kinds: list) -> tuple[DataFrame, list, list]:
        clause = self.clauses.get("extrafilter")
        if not clause:
            return out, names, kinds
        m = re.search(r"\s+trim\s+", clause, re.I)
        condition, trim = (clause[: m.start()], clause[m.end() :]) if m else (clause, None)
        inner = Plan(self.plan.spark, {}, [], Options())
        inner.names = {n.upper(): i for i, n in enumerate(names, 1)}
        inner.headings = names
        inner.fields = [Val(F.col(f"c{i + 1}"), k) for i, k in enumerate(kinds)]
        node = inner.normal(syntax.condition(condition))
        if has(node, AGGREGATES) or has(node, ANALYTIC):
            raise QueryError("extrafilter takes no aggregates or analytic functions")
        out = out.where(Scope(inner).kept(node))
        if not trim:
            return out, names, kinds
        kept = []
        for part in split_outside(trim, ","):
            e, alias = _aliased(part)
            kept += [(n, alias or (names[n.ref - 1] if isinstance(n, Field) and isinstance(n.ref, int) else e.upper())) for n in inner.spread(syntax.expression(e))]
        values = [Scope(inner).value(n) for n, _ in kept]
        rest = [c for c in out.columns if not re.fullmatch(r"c\d+", c)]
        out = out.select(*[v.col.alias(f"c{i}") for i, v in enumerate(values, 1)], *rest)
        return out, [n for _, n in kept], [v.kind for v in values]

    def limited(self, out: DataFrame) -> DataFrame:
        clause = self.clauses.get("limit")
        if not clause:
            return out
        bounds = [int(x) for x in clause.split(",")]
        if len(bounds) == 1:
            return out.limit(bounds[0])
        return out.limit(bounds[1]).offset(bounds[0] - 1) if bounds[0] > 1 else out.limit(bounds[1])

    def report(self, out: DataFrame, shown: list, names: list) -> DataFrame | None:
        clause = self.clauses.get("report")
        if not clause:
            return None
        wanted: dict[int, str] = {}
        for pair in split_outside(clause, ","):
            place, _, operation = pair.partition(":")
            wanted[int(place)] = operation.strip().upper()
        columns = []
        for i, (c, n) in enumerate(zip(shown, _distinct_names(names), strict=True), 1):
            if i not in wanted:
                columns.append(F.lit("").alias(n))
                continue
            v = F.col(c).try_cast("double") if dict(out.dtypes)[c] == "string" else F.col(c).cast("double")
            total = F.coalesce(F.sum(v), F.lit(0.0))
            value = {
                "COUNT": F.count(v).cast("double"), "AVERAGE": total / F.count(F.lit(1)), "MAX": F.max(v), "MIN": F.min(v),
            }.get(wanted[i], total)
            columns.append(F.format_string("%.2f", value).alias(n))
        return out.agg(*columns)


def _mixed(node) -> bool:
    """An OR with a side that has no aggregate."""
    if isinstance(node, syntax.Or):
        return _mixed(node.left) or _mixed(node.right)
    return not has(node, AGGREGATES)


def _outermost(node, names: frozenset, known: dict):
    if node in known:
        return
    if isinstance(node, Call) and node.name in names:
        yield node
        return
    for x in syntax.below(node):
        yield from _outermost(x, names, known)


def _loose(node, known: dict):
    """Row values that stand outside of group keys and aggregates."""
    if node in known:
        return
    if isinstance(node, (Field, Last, Var, Side)) or isinstance(node, Each) and node.mark == "%":
        yield node
        return
    for x in syntax.below(node):
        yield from _loose(x, known)


def written_out(node) -> str:
    if isinstance(node, Lit):
        return str(node.value)
    if isinstance(node, Field):
        return f"@FIELD{node.ref}" if isinstance(node.ref, int) else node.ref
    if isinstance(node, Last):
        return f"@(N-{node.back})" if node.back else "@N"
    if isinstance(node, Var):
        return f"@{node.name}"
    if isinstance(node, Side):
        return f"@R[{node.set_id}][{node.field}]"
    if isinstance(node, Neg):
        return "-" + written_out(node.of)
    if isinstance(node, Bin):
        return written_out(node.left) + node.op + written_out(node.right)
    if isinstance(node, Call):
        return f"{node.name}({';'.join(','.join(map(written_out, p)) for p in node.parts)})".upper()
    if isinstance(node, Each):
        return node.mark
    return type(node).__name__ if not isinstance(node, In) else "IN"


def _distinct_names(names: list[str]) -> list[str]:
    out, seen = [], {}
    for n in names:
        key = n.lower()
        seen[key] = seen.get(key, 0) + 1
        out.append(n if seen[key] == 1 else f"{n}_{seen[key]}")
    return out
