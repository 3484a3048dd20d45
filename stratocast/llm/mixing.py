"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded whole documents."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.llm.common import WORD_PATTERN, materialize


def capped_shares(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """total shared by weight; a share stops at most times its size and the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], most: int) -> list[dict[int, list[int]]]:
    """Words of each pattern sent to each source by repetition: flow[pattern][source][r] for the r-th use.

    A pattern may serve any of its sources; its r-th use (r from 0) offers its capacity again at cost 1, 3, 5, ...
    a word, so the total cost is convex in repetition and documents repeat only where no fresh one is left. Successive
    shortest augmenting paths with potentials; arcs: start - pattern (one for each use) - source - end.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end, n = n_p + n_s, n_p + n_s + 1, n_p + n_s + 2
    arcs: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(a, b, room, cost):
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    uses = [[0] * most for _ in range(n_p)]
    links: list[dict[int, int]] = [{} for _ in range(n_p)]
    for p in range(n_p):
        for r in range(most):
            uses[p][r] = len(arcs)
            arc(start, p, capacity[p], 2 * r + 1)
        for s in members[p]:
            links[p][s] = len(arcs)
            arc(p, n_p + s, most * capacity[p], 0)
    for s in range(n_s):
        arc(n_p + s, end, quota[s], 0)
    height = [0] * n
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, room, cost = arcs[e]
                if room > 0 and d + cost + height[a] - height[b] < dist[b]:
                    dist[b], via[b] = d + cost + height[a] - height[b], e
                    heapq.heappush(heap, (dist[b], b))
        if via[end] < 0:
            break
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, dist, strict=True)]
        room, a = 1 << 62, end
        while a != start:
            room = min(room, arcs[via[a]][1])
            a = arcs[via[a] ^ 1][0]
        a = end
        while a != start:
            arcs[via[a]][1] -= room
            arcs[via[a] ^ 1][1] += room
            a = arcs[via[a] ^ 1][0]
    flows = []
    for p in range(n_p):
        by_use = [arcs[uses[p][r] ^ 1][1] for r in range(most)]
        flow: dict[int, list[int]] = {}
        for s, e in links[p].items():
            sent, flow[s] = arcs[e ^ 1][1], [0] * most
            for r in range(most):
                taken = min(sent, by_use[r])
                flow[s][r] += taken
                by_use[r] -= taken
                sent -= taken
        flows.append(flow)
    return flows


def sized(docs: DataFrame, source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pattern (its distinct sources in code-point order, null last), size (words of the whole text)."""
    kind = dict(docs.dtypes)[source_col]
    if kind.startswith("array"):
        pattern = F.coalesce(F.array_sort(F.array_distinct(source_col)), F.array(F.lit(None).cast("string")))
        pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    else:
        pattern = F.array(F.col(source_col).cast("string"))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), pattern.cast("array<string>").alias("pattern"), size.alias("size"))


def _hashed(docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """sized() rows with key (the pattern as text), hash and bucket (the hash's top 10 bits, in its order)."""
    rows = sized(docs, keep=keep).withColumn("hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    return rows.withColumn("key", F.to_json(F.struct("pattern"))).withColumn("bucket", F.shiftright("hash", 54).cast("int"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int, max_patterns: int) -> tuple[DataFrame, DataFrame]:
    """(sizes of all rows, plan): a plan row for each pattern has key, source_size, target, full, cut and fills.

    full uses take every document. One more use takes documents up to the hash `cut`, and those that a round of `fills`
    takes. Which documents are taken thus follows from a row's own columns and its plan row.
    """
    spark = docs.sparkSession
    rows = materialize(_hashed(docs, seed), "sizes")
    found = rows.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    order = lambda s: (s is None, (s or "").encode("utf-8"))  # noqa: E731  UTF-8 keeps code-point order
    sources = sorted({s for r in found for s in r.pattern}, key=order)
    patterns = sorted(found, key=lambda r: [order(s) for s in r.pattern])
    place = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for r in patterns:
        for s in r.pattern:
            sizes[place[s]] += r.size
    every = [float(weights[i % len(weights)]) for i in range(len(sources))]
    targets = capped_shares(sizes, every, share * sum(r.size for r in patterns), most)
    flows = min_cost_flow([r.size for r in patterns], [[place[s] for s in r.pattern] for r in patterns], [round(t) for t in targets], most)
    plan = []
    for r, flow in zip(patterns, flows, strict=True):
        first = place[r.pattern[0]]
        words = [sum(by_use[k] for by_use in flow.values()) for k in range(most)]
        plan.append((r.key, sizes[first], targets[first], sum(w == r.size for w in words), next((w for w in words if 0 < w < r.size), 0)))
    planned = spark.createDataFrame(plan, "key string, source_size long, target double, full int, part long")
    sums = rows.where("size > 0").groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).join(F.broadcast(planned.select("key", "part")), "key").where("part > before and part <= before + words")
    ends = F.broadcast(materialize(ends.select("key", F.col("bucket").alias("last"), (F.col("part") - F.col("before")).alias("rest")), "ends"))  # a row a pattern
    # in the bucket where the use ends, documents by hash while they fit; equal hashes (repeated rows) go together
    ranked = rows.where("size > 0").join(ends, "key").where("bucket = last")
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = ranked.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy("key").agg(F.max("hash").alias("inner"), F.max("upto").alias("spent"))
    cuts = ends.join(inside, "key", "left").select("key", F.coalesce("inner", _before_bucket("last")).alias("cut"), (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("gap"))
    cuts = F.broadcast(materialize(cuts, "cuts"))
    out = planned.join(cuts.drop("gap"), "key", "left").join(_fills(rows, cuts), "key", "left")
    return rows, F.broadcast(materialize(out.drop("part"), "plan"))


def _before_bucket(bucket: str) -> F.Column:
    """The last hash before a bucket; for the first bucket the least long, which stands for none."""
    return F.when(F.col(bucket) > -512, F.shiftleft(F.col(bucket).cast("long"), 54) - 1).otherwise(F.lit(-(2**63)))


def _fills(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """key, fills: rounds (after, gap, upto, without) that fill the gap beyond the cut until no document fits.

    A round takes the documents with after < hash <= upto and size <= gap, but for the hashes `without`: repeated rows
    that fit one by one, not together. It ends before the first that does not fit; the next goes on from there with the
    smaller gap, so that each document beyond the cut is taken if it fits in what those before it leave.
    """
    beyond = rows.where("size > 0").join(cuts, "key").where("hash > cut and size <= gap")
    groups = materialize(beyond.groupBy("key", "bucket", "hash").agg(F.first("size").alias("size"), F.sum("size").alias("words")), "beyond")
    state = cuts.select("key", F.col("cut").alias("after"), "gap")
    rounds = None
    while True:
        fitting = groups.join(F.broadcast(state), "key").where("hash > after and words <= gap")
        sums = fitting.groupBy("key", "bucket").agg(F.sum("words").alias("words"), F.first("after").alias("after"), F.first("gap").alias("gap"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = sums.withColumn("before", before).where("before <= gap").groupBy("key", "after", "gap").agg(F.max(F.struct("bucket", "before")).alias("end"))
        ends = F.broadcast(reached.select("key", "after", "gap", F.col("end.bucket").alias("last"), (F.col("gap") - F.col("end.before")).alias("rest")))
        ranked = groups.join(ends, "key").where("bucket = last and hash > after and words <= gap")
        spent = F.sum("words").over(Window.partitionBy("key").orderBy("hash"))
        last = ranked.withColumn("spent", spent).groupBy("key", "after", "gap", "last", "rest").agg(*[F.max(F.when(F.col("spent") <= F.col("rest"), F.col(c))).alias(c) for c in ("hash", "spent")])
        done = last.select("key", "after", "gap", F.coalesce("hash", _before_bucket("last")).alias("upto"), (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("left"))
        done = materialize(done, "round")
        rounds = done if rounds is None else rounds.union(done)
        state = done.where("left > 0").select("key", F.col("upto").alias("after"), F.col("left").alias("gap"))
        if state.isEmpty():
            break
    apart = groups.join(F.broadcast(rounds), "key").where("hash > after and hash <= upto and size <= gap and words > gap")
    apart = apart.groupBy("key", "after").agg(F.collect_list("hash").alias("without"))
    each = rounds.join(apart, ["key", "after"], "left").withColumn("without", F.coalesce("without", F.array().cast("array<bigint>")))
    return each.groupBy("key").agg(F.collect_list(F.struct("after", "gap", "upto", "without")).alias("fills"))


def _uses() -> F.Column:
    """How often the mix takes a row that is joined to its plan row."""
    inside = lambda r: (F.col("hash") > r["after"]) & (F.col("hash") <= r["upto"]) & (F.col("size") <= r["gap"]) & ~F.array_contains(r["without"], F.col("hash"))
    more = (F.col("hash") <= F.col("cut")) | F.coalesce(F.exists("fills", inside), F.lit(False))
    return F.col("full") + F.coalesce(more.cast("int"), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1, max_patterns: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken is a whole multiple of size, at most `most` times.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all words; a target stops
    at `most` times its source's size. Documents aggregate by membership pattern (one source, or an array of
    overlapping ones, of which the first gives source_size and target); the flow sets how many words of each pattern
    each use supplies. Each use then takes documents in the order of a seeded hash until its words are reached; one
    that does not fit in the words still open is passed over, and the search goes on until no document fits.

    Null texts have size 0 and are taken 0. Rows with null ids or repeated rows count and are taken like others. An
    empty table gives no rows. Other columns are not read.

    The driver holds one row for each pattern (an error beyond max_patterns). No window sees a whole source: sums by
    hash bucket find the bucket in which a use or a round of filling ends, and only that, 1/1024 of a source, is ranked.
    """
    rows, plan = plan_mix(docs, weights, share, most, seed, max_patterns)
    return rows.join(plan, "key").select("doc_id", "size", "source_size", "target", (_uses() * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1, max_patterns: int = 100_000) -> DataFrame:
    """The rows of docs as often as the mix takes them (taken / size), with all their columns.

    Documents without words (null texts too) add nothing to the mix and go. Null ids are taken like others, and equal
    rows are taken alike, each as often. An empty table gives an empty one. The plan is broadcast and each row decides by
    its own columns, so texts are not shuffled.
    """
    _, plan = plan_mix(docs, weights, share, most, seed, max_patterns)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    decided = _hashed(packed, seed, keep=("row",)).where("size > 0").join(plan, "key").select("row", _uses().alias("uses")).where("uses > 0")
    return decided.select("row", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).select("row.*")
