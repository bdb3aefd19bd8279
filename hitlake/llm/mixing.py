"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, and the flow
graph has one node a pattern and one a source: its size depends on the patterns, not on documents.
Every pattern can supply its tokens up to `most` times; each further repetition costs more than the
one before (convex costs), so a quota is met with as little repetition as the overlaps allow.

Which documents a pattern takes once more than the others is seeded: documents stand in the order
of a hash of their id, and those whose middle lies within the remaining tokens are taken. Their
running sums need no global sort: sizes are summed by pattern and hash bucket, the one bucket on a
pattern's border is cut again until it is small, and only what is left of it is put in order.

Fewer than PATTERNS patterns are a condition: more are an error, not a cut.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PATTERNS = 20_000
#: Bits of a place that a bucket has more than the one around it; rows of a border that one task puts in order.
BITS, HELD = 10, 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"


def size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, most: int = 3) -> dict[object, float]:
    """Tokens wanted of each source. They share the sum of all sizes by weight; none exceeds `most` times its size, and what is over is reshared."""
    left, weight, found = sum(sizes.values()), sum(weights.values()), {}
    for k in sorted(sizes, key=lambda k: most * sizes[k] / weights[k]):
        if left * weights[k] <= most * sizes[k] * weight:
            break
        found[k] = float(most * sizes[k])
        left, weight = left - most * sizes[k], weight - weights[k]
    return {k: found[k] if k in found else left * weights[k] / weight for k in sizes}


def flow(supplies: list[int], members: list[list[int]], quotas: list[int], most: int = 3) -> list[dict[int, int]]:
    """For each pattern, tokens routed to each of its sources: a flow of the largest amount and, among those, of the least cost.

    Shortest paths with potentials, and along all of one length at once a blocking flow, so rounds are as few
    as the costs of paths. Repetition number r of a pattern's tokens costs (r - 1) ** 2.
    """
    source, sink = 0, 1
    first, second = 2, 2 + len(supplies)
    graph: list[list[list[int]]] = [[] for _ in range(second + len(quotas))]  # each edge: to, capacity, cost, its reverse's place

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, n in enumerate(supplies):
        for r in range(most):
            edge(source, first + i, n, r * r)
        for k in members[i]:
            edge(first + i, second + k, most * n, 0)
    for k, n in enumerate(quotas):
        edge(second + k, sink, n, 0)
    potential = [0] * len(graph)
    while True:
        far, heap = {source: 0}, [(0, source)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for b, room, cost, _ in graph[a]:
                step = d + cost + potential[a] - potential[b]
                if room and step < far.get(b, step + 1):
                    far[b] = step
                    heappush(heap, (step, b))
        if sink not in far:
            break
        top = max(far.values())
        potential = [p + far.get(v, top) for v, p in enumerate(potential)]
        while _blocked(graph, potential, source, sink):
            pass
    return [{b - second: most * n - room for b, room, _, _ in graph[first + i] if b >= second and room < most * n} for i, n in enumerate(supplies)]


def _blocked(graph: list, potential: list[int], source: int, sink: int) -> bool:
    """A blocking flow over the edges without reduced cost; False where none is left."""
    level, line = {source: 0}, [source]
    for a in line:
        for b, room, cost, _ in graph[a]:
            if room and b not in level and not cost + potential[a] - potential[b]:
                level[b] = level[a] + 1
                line.append(b)
    if sink not in level:
        return False
    at, path = [0] * len(graph), []
    while True:
        a = graph[path[-1][0]][path[-1][1]][0] if path else source
        if a == sink:
            amount = min(graph[v][i][1] for v, i in path)
            for v, i in path:
                graph[v][i][1] -= amount
                graph[graph[v][i][0]][graph[v][i][3]][1] += amount
            while graph[path[-1][0]][path[-1][1]][1] or any(not graph[v][i][1] for v, i in path[:-1]):
                path.pop()  # back to before the first edge that is full
            path.pop()
            continue
        while at[a] < len(graph[a]):
            b, room, cost, _ = graph[a][at[a]]
            if room and level.get(b) == level[a] + 1 and not cost + potential[a] - potential[b]:
                path.append((a, at[a]))
                break
            at[a] += 1
        else:
            if not path:
                return True
            v, _ = path.pop()
            at[v] += 1


def place(doc_id: Column, seed: int) -> Column:
    """A 60-bit integer from the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def plan(sized: DataFrame, weigh, most: int = 3) -> tuple[list, dict, dict]:
    """sized: (members, size). Each pattern with its tokens and flow; the sources' sizes; their targets.

    weigh gets the sources in order (code points, null last) and returns their weights.
    """
    rows = sized.groupBy("members").agg(F.sum("size").alias("tokens")).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    rows = sorted(rows, key=lambda r: [(s is None, s or "") for s in r.members])
    sources = sorted({s for r in rows for s in r.members}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r.tokens for r in rows if s in r.members) for s in sources}
    wanted = targets(sizes, dict(zip(sources, weigh(sources), strict=True)), most)
    at = {s: k for k, s in enumerate(sources)}
    found = flow([r.tokens for r in rows], [[at[s] for s in r.members] for r in rows], [int(wanted[s] + 0.5) for s in sources], most)
    return [(r.members, r.tokens, sum(f.values())) for r, f in zip(rows, found, strict=True)], sizes, wanted


def take(docs: DataFrame, thin: DataFrame, patterns: list, seed: int, most: int = 3) -> DataFrame:
    """docs: (doc_id, members, size, tie); thin: the same rows' first three columns. Adds copies: how often each is taken.

    The border of a pattern is found bucket by bucket: the one in which the rest ends is cut again,
    until it holds HELD rows at most or equal places alone.
    """
    spark = docs.sparkSession
    placed = thin.withColumn("place", place(F.col("doc_id"), seed))
    # One row a pattern: its first BITS bits of places (edge) lie on the border, base tokens before it.
    border = [(m, f // t if t else 0, f % t if t else 0, 0, 0) for m, t, f in patterns]
    shape = "members array<string>, whole long, rest long, edge long, base long"
    bits, order = 0, Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)

    def on(rows: DataFrame, border: list) -> DataFrame:
        edges = spark.createDataFrame(border, shape)  # PATTERNS rows at most
        return rows.join(F.broadcast(edges), rows["members"].eqNullSafe(edges["members"])).drop(edges["members"])

    while bits < 60:
        inside = on(placed, border).where(F.shiftrightunsigned("place", 60 - bits) == F.col("edge")) if bits else on(placed, border)
        bits += BITS
        sums = inside.withColumn("bucket", F.shiftrightunsigned("place", 60 - bits)).groupBy("members", "whole", "rest", "base", "bucket").agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        sums = sums.withColumn("start", F.col("base") + F.coalesce(F.sum("sum").over(order), F.lit(0)))
        # The border: the last bucket that begins within the rest. All before it are taken, none behind it.
        found = sums.where("start <= rest").groupBy("members").agg(F.max(F.struct("bucket", "start", "whole", "rest", "rows")).alias("b")).collect()
        border = [(r.members, r.b.whole, r.b.rest, r.b.bucket, r.b.start) for r in found]
        if max((r.b.rows for r in found), default=0) <= HELD:
            break
    joined = on(docs.withColumn("place", place(F.col("doc_id"), seed)).withColumn("bucket", F.shiftrightunsigned("place", 60 - bits)), border)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("members").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = joined.where("bucket = edge").withColumn("more", (2 * (F.col("base") + before) + F.col("size") <= 2 * F.col("rest")).cast("int"))
    rest = joined.where("bucket != edge").withColumn("more", (F.col("bucket") < F.col("edge")).cast("int"))
    return inside.union(rest).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(most)).cast("int"))


def mix(docs: DataFrame, members: Column, weigh, most: int = 3, seed: int = 11, keep: list[str] = (), text: str = "text") -> tuple[DataFrame, dict, dict]:
    """Rows (doc_id, members, size, copies, and the columns in keep), and the sizes and targets of sources.

    members: an array of the document's distinct sources in order. A null text has size 0. A
    document is taken `most` times at most. Documents of size 0 follow their pattern and cost
    nothing. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), members.alias("members"), size(F.col(text)).alias("size"), *([text, *keep] if keep else []))
    thin = scratch.save(sized.select("doc_id", "members", "size"), "sized")
    patterns, sizes, wanted = plan(thin, weigh, most)
    docs = sized.withColumn("tie", F.xxhash64(text)) if keep else thin.withColumn("tie", F.lit(0))
    return take(docs, thin, patterns, seed, most), sizes, wanted


def cycle(weights: tuple[int, ...] = (5, 2, 1)):
    """Weights that repeat along the sources."""
    return lambda sources: [weights[k % len(weights)] for k in range(len(sources))]
