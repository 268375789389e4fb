"""Texts put into containers of fixed capacity, by linear grouping.

Sizes are whole numbers of tokens up to the capacity, so a table of counts by size describes any number of texts and the
plan is made on it alone:

1. A text above the capacity fills whole containers; its remainder goes on as one part.
2. Large parts (above ``SMALL`` of the capacity) are grouped into ``GROUPS`` groups of equal cardinality, in the order of size, and
   rounded up to the largest of their group. The few sizes left are a cutting-stock problem whose fractional optimum comes
   from column generation (patterns priced by a knapsack over the capacity); whole multiples are used, the rest is packed
   by best fit in falling size.
3. Parts take the slots of their group, so real loads are below the planned ones; the room left is counted by container.
4. Small parts go by best fit, in falling size, into the tightest room; new containers take what is left.

The tables on the driver have at most ``capacity`` rows each, however many texts there are. Parts find their slots by
their rank among parts of one size, counted in slices and offset, so a size that a third of all texts have is not ranked
in one task.

Defined results: texts without tokens are not packed; a text is split only if it alone exceeds the capacity; repeated
keys are the caller's to remove.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut, ship_package, small_rows

#: Share of the capacity up to which a part is small, and groups of large parts.
SMALL, GROUPS = 0.1, 60
#: Parts of one size that one task ranks.
SLICE = 100_000


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i in np.argsort(-values / sizes, kind="stable"):
        s, v = int(sizes[i]), values[i]
        if v <= 1e-9:
            continue
        for a in range(s, capacity + 1, s):  # a block reads the one before it, so it takes the size any number of times
            b = min(a + s, capacity + 1)
            offer = best[a - s : b - s] + v
            better = offer > best[a:b] + 1e-12
            best[a:b][better] = offer[better]
            last[a:b][better] = i
    counts = np.zeros(len(sizes), np.int64)
    room = int(np.argmax(best))
    while room > 0 and last[room] >= 0:
        i = int(last[room])
        if best[room] - values[i] > best[room - int(sizes[i])] + 1e-9:
            break
        counts[i] += 1
        room -= int(sizes[i])
    return float(values @ counts), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, stalled: int = 200) -> list[tuple[np.ndarray, int]]:
    """(counts by size, containers): a packing of demand by column generation, whole multiples first, then best fit.

    Columns are generated until none improves the plan. Degenerate steps leave it as it is: after ``stalled`` of them in a
    row the plan stands, as it is feasible at every step.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    best, idle = np.inf, 0
    while idle < stalled:
        inverse = np.linalg.inv(basis)
        duals = np.ones(k) @ inverse
        value, column = _knapsack(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        use, step = inverse @ demand, inverse @ column
        idle = 0 if use.sum() < best - 1e-9 * max(1.0, abs(best) if np.isfinite(best) else 1.0) else idle + 1
        best = min(best, use.sum())
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        trial = basis.copy()
        trial[:, out] = column
        if abs(np.linalg.det(trial / np.maximum(1, np.abs(trial).max(axis=0)))) < 1e-200 and np.linalg.matrix_rank(trial) < k:
            break
        basis = trial
    use = np.maximum(0, np.linalg.solve(basis, demand.astype(float)))
    left, out_patterns = demand.astype(np.int64).copy(), []
    for j in np.argsort(-use):
        column = np.rint(basis[:, j]).astype(np.int64)
        times = int(np.floor(use[j] + 1e-9))
        if column.any():
            times = min(times, int(np.min(left[column > 0] // column[column > 0])))
        if times > 0 and column.any():
            out_patterns.append((column, times))
            left -= column * times
    # what whole multiples left over: a container at a time, the best filling of what there is
    order = np.argsort(-sizes)
    while left.any():
        room, counts = capacity, np.zeros(k, np.int64)
        for i in order:
            n = min(int(left[i]), room // int(sizes[i]))
            counts[i] = n
            room -= n * int(sizes[i])
        times = int(np.min(left[counts > 0] // counts[counts > 0]))
        out_patterns.append((counts, times))
        left -= counts * times
    return out_patterns


def plan_large(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """(slots, containers): slots (size, rank_from, rank_to, container_from, repeat): parts of a size with ranks in
    [rank_from, rank_to) go to container_from + (rank - rank_from) // repeat."""
    if not histogram:
        return [], 0
    sizes = sorted(histogram, reverse=True)
    total = sum(histogram.values())
    share = max(1, -(-total // groups))
    # groups of equal cardinality in falling size; a size may be cut between two groups
    members: list[list[tuple[int, int]]] = []
    room = 0
    for s in sizes:
        n = histogram[s]
        while n:
            if not room:
                members.append([])
                room = share
            take = min(n, room)
            members[-1].append((s, take))
            n -= take
            room -= take
    rounded = np.array([g[0][0] for g in members], np.int64)
    demand = np.array([sum(n for _, n in g) for g in members], np.int64)
    distinct, index = np.unique(rounded, return_inverse=True)
    merged = np.bincount(index, demand).astype(np.int64)
    queue: dict[int, list[list[int]]] = defaultdict(list)  # by distinct size: parts of the group, the largest first
    taken: dict[int, int] = defaultdict(int)
    for g, i in zip(members, index, strict=True):
        for s, n in g:
            queue[int(i)].append([s, taken[s], n])
            taken[s] += n
    slots, container = [], 0
    for counts, times in patterns(distinct, merged, capacity):
        for i in np.flatnonzero(counts):
            per = int(counts[i])
            filled, need = 0, per * times
            while need:
                s, rank, n = queue[int(i)][0]
                # whole containers from one size where possible, then single slots
                offset = filled % per
                take = min(n, need) if not offset and min(n, need) < per or offset else min(n, need) // per * per
                if offset:
                    take = min(take, per - offset)
                elif take > per:
                    take = take // per * per
                slots.append((s, rank, rank + take, container + filled // per, per))
                queue[int(i)][0][1] += take
                queue[int(i)][0][2] -= take
                if not queue[int(i)][0][2]:
                    queue[int(i)].pop(0)
                filled += take
                need -= take
        container += times
    return slots, container


def plan_small(histogram: dict[int, int], rooms: dict[int, int], capacity: int, first_new: int) -> tuple[list[tuple], int]:
    """(slots, new containers): slots (size, rank_from, rank_to, room, index_from, repeat): parts with ranks in the range go
    to the containers of that room from index_from on, repeat parts each; room 0 means new containers by number."""
    # a segment is a run of containers with equal room now: [origin room, first index, count]
    segments: dict[int, list[list[int]]] = defaultdict(list)
    for r, n in rooms.items():
        if r > 0 and n > 0:
            segments[r].append([r, 0, n])
    slots, new = [], 0

    def fill(s: int, rank: int, count: int, room: int) -> int:
        """Parts of size s into the containers with this much room; the rank reached."""
        per = room // s
        while count and segments[room]:
            origin, index, n = segments[room].pop()
            full = min(n, count // per)
            if full:
                slots.append((s, rank, rank + full * per, origin, index, per))
                rank += full * per
                count -= full * per
                if room - per * s:
                    segments[room - per * s].append([origin, index, full])
            rest = n - full
            if rest and 0 < count < per:
                slots.append((s, rank, rank + count, origin, index + full, count))
                segments[room - count * s].append([origin, index + full, 1])
                rank, count, rest, full = rank + count, 0, rest - 1, full + 1
            if rest:
                segments[room].append([origin, index + full, rest])
                if full == 0 and not count:
                    break
        return rank

    for s in sorted(histogram, reverse=True):
        rank, total = 0, histogram[s]
        for room in sorted(r for r in segments if r >= s and segments[r]):
            if rank == total:
                break
            rank = fill(s, rank, total - rank, room)
        if rank < total:
            need = -(-(total - rank) // (capacity // s))
            segments[capacity].append([0, first_new + new, need])
            new += need
            rank = fill(s, rank, total - rank, capacity)
    return slots, new


def ranked(parts: DataFrame, *by: str) -> DataFrame:
    """The parts with their ``rank`` (from 0) among those equal in ``by``, counted in slices and then offset.

    The slices are as many as the most frequent key needs.
    """
    most = parts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    sliced = parts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "part"), F.lit(max(1, -(-most // SLICE)))).cast("int"))
    keys = [*by, "slice"]
    counts = sliced.groupBy(*keys).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = sliced.withColumn("inner", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "part")) - 1)
    return inner.join(before, keys).withColumn("rank", F.col("inner") + F.col("before")).drop("inner", "before", "slice")


def _located(parts: DataFrame, plans: dict[str, dict[int, tuple]]) -> DataFrame:
    """The parts with (room, index) of their slot, looked up in plans as long as the capacities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, ranks = (batch.column(batch.schema.get_field_index(c)) for c in ("pack_name", "tokens", "rank"))
            rooms, places = [], []
            for name, size, rank in zip(names.to_pylist(), sizes.to_pylist(), ranks.to_pylist(), strict=True):
                starts, rows = plans[name][size]
                begin, _, room, first, repeat = rows[int(np.searchsorted(starts, rank, side="right")) - 1]
                rooms.append(room)
                places.append(first + (rank - begin) // repeat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rooms, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "room", "index"])

    fields = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return parts.mapInArrow(run, f"{fields}, room bigint, index bigint")


def _lookup(slots: list[tuple]) -> dict[int, tuple]:
    by: dict[int, list[tuple]] = defaultdict(list)
    for size, begin, end, room, first, repeat in slots:
        by[size].append((begin, end, room, first, repeat))
    return {s: (np.array([r[0] for r in sorted(rows)]), sorted(rows)) for s, rows in by.items()}


def _histogram(rows: DataFrame, column: str) -> dict[str, dict[int, int]]:
    out: dict[str, dict[int, int]] = defaultdict(dict)
    for r in rows.groupBy("pack_name", column).agg(F.count("*").alias("n")).collect():  # at most the capacities' sum of rows
        out[r["pack_name"]][r[column]] = r["n"]
    return out


def pack(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, container, doc_id, part, token_from, tokens) of every part of every text in containers of each capacity.

    ``sized`` has doc_id, tokens; ``capacities`` has pack_name, capacity_tokens, a few rows read on the driver.
    """
    spark: SparkSession = sized.sparkSession
    ship_package(spark)
    limits = {r["pack_name"]: int(r["capacity_tokens"]) for r in small_rows(capacities.select("pack_name", "capacity_tokens"), "pack_capacities") if r["pack_name"] is not None and r["capacity_tokens"] and r["capacity_tokens"] > 0}
    if not limits:
        return spark.createDataFrame([], "pack_name string, container bigint, doc_id bigint, part int, token_from bigint, tokens bigint")
    pairs = F.explode(F.create_map(*[x for n, c in limits.items() for x in (F.lit(n), F.lit(c))])).alias("pack_name", "capacity")
    items = sized.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").cast("bigint").alias("size"), pairs).withColumn("whole", F.floor(F.col("size") / F.col("capacity")))
    rest = items.select("pack_name", "capacity", "doc_id", F.col("whole").cast("int").alias("part"), (F.col("whole") * F.col("capacity")).alias("token_from"), (F.col("size") % F.col("capacity")).alias("tokens")).where(F.col("tokens") > 0)
    full = items.where(F.col("whole") > 0).select("pack_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("part")).withColumn("token_from", F.col("part") * F.col("capacity").cast("bigint")).withColumn("tokens", F.col("capacity").cast("bigint"))
    parts = cut(ranked(rest.withColumn("small", F.col("tokens") <= SMALL * F.col("capacity")), "pack_name", "tokens"))
    large, small = parts.where(~F.col("small")), parts.where("small")
    plans, containers = {}, {}
    for name, histogram in _histogram(large, "tokens").items():
        slots, containers[name] = plan_large(histogram, limits[name])
        plans[name] = _lookup([(s, a, b, 0, first, repeat) for s, a, b, first, repeat in slots])
    placed = cut(_located(large, plans).withColumnRenamed("index", "container").drop("room", "rank", "small"))
    rooms = placed.groupBy("pack_name", "container").agg((F.max("capacity") - F.sum("tokens")).alias("tokens")).withColumn("doc_id", F.col("container")).withColumn("part", F.lit(0))
    rooms = cut(ranked(rooms, "pack_name", "tokens"))
    free = _histogram(rooms, "tokens")
    small_plans, last = {}, dict(containers)
    for name, histogram in _histogram(small, "tokens").items():
        slots, new = plan_small(histogram, free.get(name, {}), limits[name], containers.get(name, 0))
        small_plans[name] = _lookup(slots)
        last[name] = containers.get(name, 0) + new
    lent = _located(small, small_plans).drop("rank", "small")
    fresh = lent.where("room = 0").withColumnRenamed("index", "container").drop("room")
    filled = lent.where("room > 0").join(rooms.select("pack_name", F.col("tokens").alias("room"), F.col("rank").alias("index"), "container"), ["pack_name", "room", "index"]).drop("room", "index")
    offset = F.create_map(*[x for n in limits for x in (F.lit(n), F.lit(last.get(n, 0)))])[F.col("pack_name")]
    whole = ranked(full, "pack_name").withColumn("container", F.col("rank") + offset).drop("rank")
    out = [d.select("pack_name", F.col("container").cast("bigint"), "doc_id", F.col("part").cast("int"), F.col("token_from").cast("bigint"), F.col("tokens").cast("bigint")) for d in (placed, fresh, filled, whole)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill, least): how full the containers of each capacity are;
    ``least`` is the number that the tokens alone would need."""
    sums = packed.groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return capacities.select("pack_name", "capacity_tokens").join(sums, "pack_name").select(
        "pack_name", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least")
    )
