"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern: the flow network has one node
a pattern, not a document. An arc from the start carries a pattern's first pass at no cost and each further pass at a
cost that grows (convex), arcs lead from a pattern to its sources, and a source takes up to its quota. The cheapest
maximal flow thus uses fresh words everywhere before it repeats any. Whole documents are then selected in the order of
a seeded hash until a pattern's flow is met; the last word counts come from one more document, the one whose size is
nearest to what is missing.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, the last; a
document without a source (empty list) is not taken; rows that share an id, or have none, are told apart by size and text,
and of equal rows as many are taken as fit, whichever; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import word_count, written

WEIGHTS = (5, 2, 1)  #: of the sources in order of code points, repeating
SHARE = (3, 2)  #: the mix takes 3/2 of all words
PASSES = 2  #: passes over a document at most
SEED = 17
BUCKETS = 4096  #: steps of a level of the seeded order
LEVELS = 2  #: levels that are walked by sums before single documents are
PATTERNS = 1 << 16  #: patterns of sources at most; more are an error, never a sample


def quotas(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES) -> list[float]:
    """Targets of the sources: the share by weight, none above passes * its size, the excess dealt anew by weight."""
    total = sum(sizes) * share[0] / share[1]
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    capped: set[int] = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(passes * sizes[k] for k in capped)
        unit = rest / sum(weight[k] for k in free) if free else 0.0
        over = {k for k in free if unit * weight[k] > passes * sizes[k]}
        if not over:
            return [float(passes * sizes[k]) if k in capped else unit * weight[k] for k in range(len(sizes))]
        capped |= over


def min_cost_flow(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], passes: int = PASSES) -> list[dict[int, int]]:
    """Words each pattern sends to each of its sources: a cheapest maximal flow, where pass p over a word costs p.

    Successive shortest paths with potentials over patterns and sources; the networks are small (patterns, not documents).
    """
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, left, cost = [], [], []

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)

    for i in range(n):
        for p in range(passes):
            arc(start, i, capacity[i], p)
        for j in sorted(set(member[i])):
            arc(i, n + j, passes * capacity[i], 0)
    for j in range(m):
        arc(n + j, end, quota[j], 0)
    potential = [0] * (n + m + 2)
    while True:
        far, by = {start: 0}, {}
        queue, done = [(0, start)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            for e in head[x]:
                if left[e] > 0 and (y := to[e]) not in done and (z := d + cost[e] + potential[x] - potential[y]) < far.get(y, 1 << 62):
                    far[y], by[y] = z, e
                    heapq.heappush(queue, (z, y))
        if end not in far:
            break
        most = max(far.values())
        potential = [p + far.get(x, most) for x, p in enumerate(potential)]
        path, x = [], end
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
    return [{to[e] - n: left[e ^ 1] for e in head[i] if n <= to[e] < n + m and left[e ^ 1] > 0} for i in range(n)]


def seeded(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A place in the seeded order, 0 to 2**60 - 1: the same in any engine that has md5. Rows without an id go by their text."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def _cut(rows: DataFrame, goals: DataFrame, place: str, ties: Sequence[str], buckets: int, levels: int) -> DataFrame:
    """rows (pattern, place, ties, size) and goals (pattern, goal) -> (pattern, low, last, next, n, missing): rows are taken below the
    place `low`, and from there up to the struct `last` of (place, ties); `next` is the struct of the n rows after it, missing what is left of the goal.

    The order is walked by sums of buckets, level by level; only what lies in the last bucket (one part in buckets ** levels
    of a pattern) is ordered group by group of rows alike in it. No task sees an unbounded group, whatever the pattern's share.
    """
    width = 1 << 60
    state = goals.select("pattern", F.col("goal").alias("missing"), F.lit(0).cast("long").alias("low"))
    for _ in range(levels):
        width //= buckets
        inside = rows.join(F.broadcast(state), "pattern").filter((F.col(place) >= F.col("low")) & (F.col(place) < F.col("low") + width * buckets))
        sums = inside.groupBy("pattern", "low", "missing", ((F.col(place) - F.col("low")) / width).cast("long").alias("step")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("step"))  # `buckets` rows a pattern at most
        sums = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("missing"))
        first = sums.groupBy("pattern").agg(F.min_by(F.struct("step", "low", F.col("upto"), "size", "missing"), "step").alias("x"))
        found = written(first.select("pattern", (F.col("x.missing") - F.col("x.upto") + F.col("x.size")).alias("missing"), (F.col("x.low") + F.col("x.step") * width).alias("low")), "mix-found")
        # A pattern of which everything is wanted never goes beyond its goal: its cut lies at the end.
        rest = goals.select("pattern").join(found, "pattern", "left_anti").select("pattern", F.lit(0).cast("long").alias("missing"), F.lit(1 << 60).cast("long").alias("low"))
        state = found.unionByName(rest)
    at = F.struct(place, *ties)
    cell = rows.join(F.broadcast(state), "pattern").filter((F.col(place) >= F.col("low")) & (F.col(place) < F.col("low") + width))
    alike = cell.groupBy("pattern", "missing", at.alias("at"), "size").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    alike = alike.withColumn("upto", upto)
    fits = F.col("upto") <= F.col("missing")
    over = F.struct("at", "n", "size")
    ends = alike.groupBy("pattern").agg(F.max(F.when(fits, F.col("at"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("got"), F.min(F.when(~fits, over)).alias("over"))
    cut = state.join(ends, "pattern", "left").select("pattern", "low", "last", F.col("over.at").alias("next"), F.col("over.n").alias("n"), F.col("over.size").alias("each"), (F.col("missing") - F.coalesce("got", F.lit(0))).alias("missing"))
    return written(cut, "mix-cut")


def select_documents(rows: DataFrame, goals: DataFrame, buckets: int = BUCKETS, levels: int = LEVELS) -> DataFrame:
    """rows (pattern, place, key, size, tie, row: a number of its own) and goals (pattern, goal): the rows with `picked`, whole rows in
    order of (place, key, size, tie) with sums near goal.

    Tables of one row a pattern are broadcast: the caller holds the patterns on the driver, so their number bounds them.
    Rows alike in all four are taken in an order of their own, so that the cut may lie between them.
    """
    ties = ("key", "size", "tie")
    cut = _cut(rows, goals, "place", ties, buckets, levels)
    at = F.struct("place", *ties)
    marked = rows.join(F.broadcast(cut), "pattern", "left")
    picked = (F.col("place") < F.col("low")) | F.coalesce(at <= F.col("last"), F.lit(False))
    if not cut.filter("n > 1 and each <= missing").isEmpty():
        here = F.broadcast(cut.filter("n > 1 and each <= missing").select("pattern", "next", F.col("missing").alias("goal")))
        among = rows.join(here, "pattern").filter(at.eqNullSafe(F.col("next"))).select("pattern", "size", "row", spread_of("row").alias("spread"))
        inner = _cut(among, here.select("pattern", "goal"), "spread", ("row",), buckets, levels)
        inner = inner.select("pattern", F.col("low").alias("in_low"), F.col("last").alias("in_last"), F.col("missing").alias("in_missing"))
        marked = marked.join(F.broadcast(inner), "pattern", "left")
        own = F.struct(spread_of("row").alias("spread"), "row")
        of_next = at.eqNullSafe(F.col("next")) & ((own["spread"] < F.col("in_low")) | F.coalesce(own <= F.col("in_last"), F.lit(False)))
        picked = picked | F.coalesce(of_next, F.lit(False))
        marked = marked.withColumn("missing", F.coalesce("in_missing", "missing"))
    marked = marked.select(*rows.columns, "missing", F.coalesce(picked, F.lit(False)).alias("picked"))
    # One more document a pattern: the one whose size is nearest to what is missing, if it brings the sum nearer.
    gap = F.abs(F.col("size") - F.col("missing"))
    spare = marked.filter(~F.col("picked") & (F.col("size") > 0) & (gap < F.col("missing")))
    extra = spare.groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "place", *ties, "row")).alias("x")).select("pattern", F.col("x.row").alias("extra"))
    out = marked.join(F.broadcast(extra), "pattern", "left")
    return out.select(*rows.columns, (F.col("picked") | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))).alias("picked"))


def spread_of(row: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(row), 4)


def pattern_of(sources: Column) -> Column:
    """The set of sources as text."""
    pattern = F.array_sort(F.array_distinct(sources))
    return F.to_json(F.struct(F.coalesce(pattern, F.array().cast("array<string>")).alias("s")), {"ignoreNullFields": "false"})


def mix(docs: DataFrame, sources: Column, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """docs with a column `sources` (array of strings, a null entry is a source): doc_id, pattern, size, source_size, target, taken, copies, tie (a hash of the text).

    source_size and target are sums over the document's sources. The driver holds one row a pattern, PATTERNS at most.
    """
    spark = docs.sparkSession
    place = seeded(F.col("doc_id"), F.col("text"), seed)
    rows = docs.select("doc_id", pattern_of(sources).alias("pattern"), F.col("doc_id").alias("key"), word_count(F.col("text")).alias("size"), place.alias("place"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "mix-sizes")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of sources: mix coarser sources, as the flow is found on the driver")
    shape = T.StructType([T.StructField("s", T.ArrayType(T.StringType()))])
    parsed = {r["pattern"]: r["s"] for r in spark.createDataFrame([(r["pattern"],) for r in sums], "pattern string").select("pattern", F.from_json("pattern", shape)["s"].alias("s")).collect()}
    patterns = sorted(parsed)
    names = sorted({s for p in patterns for s in parsed[p]}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    number = {s: k for k, s in enumerate(names)}
    words = {r["pattern"]: int(r["size"]) for r in sums}
    source_size = [sum(words[p] for p in patterns if s in parsed[p]) for s in names]
    target = quotas(source_size, weights, share, passes)
    member = [[number[s] for s in parsed[p]] for p in patterns]
    flow = min_cost_flow([words[p] for p in patterns], member, [round(t) for t in target], passes)
    plan = []
    for p, into, own in zip(patterns, flow, member, strict=True):
        whole, rest = divmod(sum(into.values()), words[p]) if words[p] else (0, 0)
        plan.append((p, sum(source_size[j] for j in own), float(sum(target[j] for j in own)), min(whole, passes), rest if whole < passes else 0))
    plan = spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long, goal long")
    chosen = select_documents(rows, plan.select("pattern", "goal"))
    out = chosen.join(F.broadcast(plan.drop("goal")), "pattern")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("picked").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "pattern", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "tie")
