"""Choosing under byte budgets, on the driver over small aggregated rows, and the windows that feed it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markdown_blocks


def spread_order(values: list) -> Iterator:
    """Middle, first, last, then the middles of what lies between, level by level; a longer prefix keeps a shorter one."""
    if not values:
        return
    taken = []
    for k in ((len(values) - 1) // 2, 0, len(values) - 1):
        if k not in taken:
            taken.append(k)
            yield values[k]
    mid = (len(values) - 1) // 2
    level = [(0, mid), (mid + 1, len(values))]
    while level:
        deeper = []
        for a, z in level:
            if a < z:
                m = a + (z - a - 1) // 2
                if m not in taken:
                    yield values[m]
                deeper += [(a, m), (m + 1, z)]
        level = deeper


def direction_of(row: str) -> str:
    import re

    m = re.search(r"/ (support|against|mixed):|^- (支持|反证)[：:]", row)
    if m:
        return m[1] or m[2]
    if row.startswith("|"):
        return "table"
    if re.match(r"\d+[.)] ", row):
        return "numbered"
    return "neutral" if row.startswith("- ") else "paragraph"


def balanced_order(rows: list[str]) -> list[int]:
    """Indices by round-robin over directions, each in spread order."""
    by: dict[str, list[int]] = {}
    for k, row in enumerate(rows):
        by.setdefault(direction_of(row), []).append(k)
    queues, out = [list(spread_order(v)) for v in by.values()], []
    for depth in range(max(map(len, queues), default=0)):
        out += [q[depth] for q in queues if depth < len(q)]
    return out


def pack_sections(sections: dict[str, list[str]], budget: int, first: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Whole rows, round-robin over sections in balanced order, while headings and rows fit in UTF-8 bytes.

    Costs add up (a row and its line end), so nothing is rendered again for each trial.
    """
    size = lambda s: len(s.encode()) + 1
    queues = {}
    for name, rows in sections.items():
        order = balanced_order(rows)
        urgent = [k for k in order if any(i in rows[k] for i in first)]
        queues[name] = urgent + [k for k in order if k not in set(urgent)]
    chosen: dict[str, list[int]] = {n: [] for n in sections}
    left = budget - sum(map(size, sections))
    while any(queues.values()):
        for name, q in queues.items():
            if q:
                k = q.pop(0)
                if size(sections[name][k]) <= left:
                    left -= size(sections[name][k])
                    chosen[name].append(k)
    return {n: [sections[n][k] for k in sorted(ks)] for n, ks in chosen.items()}


@dataclass(frozen=True)
class Choice:
    """Sessions chosen together, their bytes, and the share of each question's weight that they answer."""

    sessions: frozenset
    cost: int
    shares: tuple

    def worth(self) -> tuple:
        """The worst answered question counts first, then the next; of equals the smaller choice is worth more."""
        return tuple(sorted(self.shares)), -self.cost


def best_sessions(costs: dict, groups: list[tuple[str, frozenset, float]], budget: int, rendered=None, width: int = 8) -> frozenset:
    """The sessions (bytes by name) that answer the questions most evenly within a budget.

    ``groups``: question, the sessions that a query hits, weight; a query counts once all of its sessions are in. Choices
    that answer the same questions compete: the ``width`` best and the ``width`` cheapest of them go on. ``rendered`` gives
    the bytes that a choice really takes, and the best choice that fits is returned; none if nothing does.
    """
    questions = sorted({g[0] for g in groups}, key=str)
    total = {q: sum(w for of, _, w in groups if of == q) for q in questions}

    def choice(sessions: frozenset) -> Choice:
        got = [sum(w for of, need, w in groups if of == q and need <= sessions) / total[q] for q in questions]
        return Choice(sessions, sum(costs[x] for x in sessions), tuple(got))

    kept = [choice(frozenset())]
    for need in dict.fromkeys(g[1] for g in groups):
        rivals: dict[tuple, set[Choice]] = {}
        for c in {*kept, *(choice(k.sessions | need) for k in kept)}:
            if c.cost <= budget:
                rivals.setdefault(tuple(x > 0 for x in c.shares), set()).add(c)
        name = lambda c: sorted(map(str, c.sessions))  # noqa: E731  ties don't depend on the order of a set
        kept = []
        for of in rivals.values():
            steady = sorted(of, key=name)
            best = sorted(steady, key=Choice.worth, reverse=True)[:width]
            cheap = sorted(steady, key=lambda c: (c.cost, [-x for x in sorted(c.shares)]))[:width]
            kept += dict.fromkeys(best + cheap)
    for c in sorted(kept, key=Choice.worth, reverse=True):
        if rendered is None or rendered(c.sessions) <= budget:
            return c.sessions
    return frozenset()


def first_occurrences(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values per conversation in the order they first occur: ``conv_id, value, rank``."""
    first = rows.groupBy("conv_id", value).agg(F.min(order).alias("_f"))
    return first.select("conv_id", value, F.row_number().over(Window.partitionBy("conv_id").orderBy("_f", value)).alias("rank"))


def pruned(ids: str, visible: str) -> tuple[Column, Column]:
    """What of an array of ids is kept, and what goes, when only some are visible."""
    return F.array_intersect(ids, visible), F.array_except(ids, visible)


def phase_budget(summaries: list[str], budget: int, most: int = 6) -> str:
    """Summaries of phases within a budget of bytes: all if they fit, else evenly spaced ones, by whole blocks.

    A summary is a first line and sections under ``###``; each block goes in whole or not at all.
    """
    whole = "\n\n".join(summaries)
    if len(whole.encode()) <= budget or not summaries:
        return whole
    n = len(summaries)
    take = range(n) if n <= most else [round(k * (n - 1) / (most - 1)) for k in range(most)]
    head = f"[阶段材料共 {n} 份，预算选取 {len(take)} 份；按完整 Markdown 单元选择，存在省略。阶段解释均待原文复核。]"
    sections: dict[str, list[str]] = {}
    for k in take:
        top, _, rest = summaries[k].partition("\n")
        title = top
        for block in markdown_blocks(rest):
            if block.startswith("### "):
                title = f"{top}\n{block}"
            else:
                sections.setdefault(title, []).append(block)
    size = sum(len(t.encode()) + 2 for t in sections) + len(head.encode()) + 2
    packed = pack_sections({t: [b.replace("\n", "\0") + "\0" for b in blocks] for t, blocks in sections.items()}, budget - size + sum(len(t.encode()) + 1 for t in sections))
    return "\n\n".join([head, *(x for t, blocks in packed.items() for x in (t, *(b[:-1].replace("\0", "\n") for b in blocks)))])


@dataclass
class Selected:
    """The positions that are shown, the units shown whole, and the anchors shown of the others."""

    positions: set
    whole: list
    narrowed: dict


def select_units(units: list[dict], size, budget: int) -> Selected:
    """Units whose context fits a budget of bytes, evenly over time.

    A unit has unit, quarter, priority and windows (anchor, left, right); ``size`` gives the bytes of a set of positions as
    shown. Units of one anchor wait by quarter in spread order, the others by priority; a round offers one of each quarter,
    first of the short ones, so that a long unit does not take all. A unit of several anchors that does not fit whole gets
    the windows of single anchors, in spread order, as far as they fit.
    """
    single, several = ([[], [], [], []] for _ in range(2))
    for u in sorted(units, key=lambda u: u["windows"][0]):
        (several if len(u["windows"]) > 1 else single)[u["quarter"]].append(u)
    queues = [deque(spread_order(q)) for q in single] + [deque(sorted(q, key=lambda u: u["priority"])) for q in several]
    out = Selected(set(), [], {})
    reach = lambda w: set(range(w[1], w[2] + 1))
    if size(set()) > budget:
        return out
    while any(queues):
        for queue in queues:
            if not queue:
                continue
            u = queue.popleft()
            tries = [set().union(*map(reach, u["windows"]))]
            if len(u["windows"]) > 1 and size(out.positions | tries[0]) > budget:
                tries = [reach(w) for w in spread_order(u["windows"])]
            for more in tries:
                if size(out.positions | more) <= budget:
                    out.positions |= more
            shown = [w[0] for w in u["windows"] if reach(w) <= out.positions]
            if len(shown) == len(u["windows"]):
                out.whole.append(u["unit"])
            elif shown:
                out.narrowed[u["unit"]] = shown
    return out


def unit_priority(units: DataFrame, n: str = "n_rows_of_conversation") -> DataFrame:
    """Rank of units (most anchors, most turn changes, shortest span) and their quarter of the conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("n_anchors"), F.desc("turn_changes"), F.col("right") - F.col("left"), "unit")
    return units.withColumn("priority", F.row_number().over(order)).withColumn("quarter", F.least(F.lit(3), F.expr(f"cast(first_anchor * 4 div {n} as int)")))


def complete_units(units: DataFrame, visible: DataFrame) -> DataFrame:
    """Units all of whose rows are visible; only their evidence may be cited."""
    seen = units.join(visible.select("conv_id", "position").distinct(), "conv_id").where("position between left and right").groupBy("conv_id", "unit").agg(F.count("*").alias("seen"))
    return units.join(seen, ["conv_id", "unit"], "left").withColumn("complete", F.coalesce(F.col("seen") == F.col("right") - F.col("left") + 1, F.lit(False)))


def repetition_notes(rows: DataFrame, budget: int = 4000) -> DataFrame:
    """Repeated texts, longest first, up to the byte budget (a prefix): ``conv_id, note_rank, content, same_text``."""
    once = rows.where("same_text > 1").groupBy("conv_id", "content").agg(F.min("position").alias("position"), F.max("same_text").alias("same_text"))
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.char_length("content")), "position")
    kept = once.withColumn("note_rank", F.row_number().over(w)).withColumn("bytes", F.sum(F.octet_length("content") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where(F.col("bytes") <= budget).select("conv_id", "note_rank", "content", "same_text")


def quarter_coverage(rows: DataFrame) -> DataFrame:
    """Four slices of a conversation by row number (bounds i * n // 4): rows in each and how many were chosen."""
    w = Window.partitionBy("conv_id")
    each = rows.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("position")) - 1)
    slice_ = F.expr("size(filter(array(1, 2, 3), i -> r >= i * n div 4))")
    return each.groupBy("conv_id", slice_.alias("quarter")).agg(F.count("*").alias("total"), F.count_if("chosen").alias("chosen"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def repetition_windows(messages: DataFrame, quotes: DataFrame, budget: int = 24_000) -> DataFrame:
    """``conv_id, position, covered``: where a quoted text occurs more than once, and which of these windows fit a budget.

    ``quotes``: conv_id, content. In order of position, a window's rows that are not in yet are added if their bytes still
    fit; one that does not fit is passed over, and later ones are tried.
    """
    from .sessions import anchor_windows

    hits = messages.join(quotes.select("conv_id", "content").distinct(), ["conv_id", "content"], "left_semi")
    many = hits.withColumn("n", F.count("*").over(Window.partitionBy("conv_id", "content"))).where("n > 1").select("conv_id", "position")
    windows = anchor_windows(messages, many).select("conv_id", "position", "left", "right")
    upto = Window.partitionBy("conv_id").orderBy("position")
    cost = F.sum(F.octet_length(F.coalesce("content", F.lit(""))) + 1).over(upto)  # bytes of all rows up to one
    held = messages.select("conv_id", F.col("position").alias("p"), cost.alias("upto"))
    ends = windows.join(held.select("conv_id", F.col("p").alias("right"), F.col("upto").alias("z")), ["conv_id", "right"]).join(held.select("conv_id", (F.col("p") + 1).alias("left"), F.col("upto").alias("a")), ["conv_id", "left"], "left").fillna(0, ["a"])
    rows = ends.select("conv_id", "position", "left", "right", "a", "z").repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def run(batches):
        conv, left_over, reach, reach_bytes = object(), 0, 0, 0
        for b in batches:
            out = []
            for c, left, right, a, z in zip(*(b.column(x).to_pylist() for x in ("conv_id", "left", "right", "a", "z")), strict=True):
                if c != conv:
                    conv, left_over, reach, reach_bytes = c, budget, 0, 0
                # Windows come in order of their anchors, so both of their ends only grow: what is in is all up to ``reach``.
                new = 0 if right <= reach else z - (reach_bytes if left <= reach else a)
                fits = new <= left_over
                if fits and right > reach:
                    left_over, reach, reach_bytes = left_over - new, right, z
                out.append(fits)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("position"), pa.array(out, pa.bool_())], ["conv_id", "position", "covered"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, position {kinds['position']}, covered boolean")
