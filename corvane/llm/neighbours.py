"""The most similar vectors for every vector, by a permutation index.

A vector is represented by the order of its ``ORDER`` nearest pivots and posted in the inverted files of the first
``posted`` of them. In a file, vectors are ranked by the footrule distance of their orders (pivots missing from one count
as standing behind its last): all within ``footrule`` are candidates, however many, and are reranked by exact cosine. A
vector's lists from its files are merged.

The footrule distance belongs to a pair, not to a file, so all files that two vectors share judge the pair alike: the pair
is given by the first of them only, and none is lost.

Pivots are rows of the collection, drawn by the hash of their content, ``4 sqrt(N)`` of them rounded to a power of two, at
least ``LEAST_PIVOTS`` and at most ``MOST_PIVOTS`` (the bounded sample that the index is fitted on and the only broadcast;
64 floats each, 16 MB at most). They follow the density of the collection, so a file holds about ``posted sqrt(N) / 4``
vectors. A sample ``SAMPLE`` times as large tells which files will hold more than ``SPLIT`` times the mean: those are split
into slices and every two slices meet in a task of their own, which gives the same pairs. Every usable vector is indexed.

Accuracy is set by ``posted``, ``footrule`` and ``pivots``; ``footrule=None`` takes all vectors of a file as candidates, and
``posted`` equal to the number of pivots makes every pair meet. For the exact neighbours of a stated set of vectors there
is ``corvane.operators.retrieval.vector_topk_batch``.

Rows with the same vector form one class and are posted once. All of a class's rows share its list: of equal similarity,
only the first ids of a class can be neighbours, so the index carries just ``k + 1`` ids of each class, however many rows
it has.

Defined results: a vector that is NULL, of another width, with NULL, NaN or infinite parts, or all zero takes no part;
fewer than k others give a shorter list; a redelivered row counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, ship_package

LEAST_PIVOTS, MOST_PIVOTS = 64, 65_536  # an order holds pivots in 16 bits
#: Pivots in an order, inverted files that a vector is posted in, and the footrule distance of candidates (72 at most).
ORDER, POSTED, FOOTRULE = 8, 5, 60
#: Vectors sampled for each pivot to foretell the sizes of files, and the multiple of the mean size from which one is split.
SAMPLE, SPLIT = 4, 4


def _usable(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
            keep = np.flatnonzero((lengths == width) & ~column.is_null().to_numpy(zero_copy_only=False) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False))
            taken = column.take(pa.array(keep))
            flat = taken.flatten()
            x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, width)  # NULL parts become NaN
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            x, keep = x[good], keep[good]
            raw = [row.tobytes() for row in x]
            keys = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(keys), pa.array(raw, pa.binary())], names=["id", "class", "vector"])

    return run


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, width).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, the nearest first."""
    near = x @ pivots.T
    best = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)


def _post(pivots_bytes: bytes, slices_bytes: bytes, width: int, posted: int):
    """Vectors to (file, pivot, class, vector, order, ids), one row for each file and each meeting of its slice there.

    A file is the number of its pivot and of two slices: pairs of one slice meet in (s, s), those of two slices in (s, t).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.frombuffer(pivots_bytes, np.float32).reshape(-1, width)
        slices = np.frombuffer(slices_bytes, np.int64)
        length = min(max(ORDER, posted), len(pivots))
        first = min(posted, length)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ranked = _orders(_unit(part.column(1).to_pylist(), width).astype(np.float32), pivots, length)
                rows = np.repeat(np.arange(len(ranked)), first)
                pivot = ranked[:, :first].ravel()
                own = part.column(0).to_numpy().astype(np.int64)[rows] % slices[pivot]
                again = np.repeat(np.arange(len(rows)), slices[pivot])
                other = np.arange(len(again)) - np.repeat(np.cumsum(slices[pivot]) - slices[pivot], slices[pivot])
                low, high = np.minimum(own[again], other), np.maximum(own[again], other)
                file = (pivot[again].astype(np.int64) << 32) | (low << 16) | high
                taken = part.take(pa.array(rows[again]))
                orders = [r.tobytes() for r in ranked.astype(np.uint16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file), taken.column(0), taken.column(1), pa.array([orders[i] for i in rows[again]], pa.binary()), taken.column(2)],
                    names=["file", "class", "vector", "order", "ids"],
                )

    return run


def _near(orders: np.ndarray, a: int, b: int, footrule: int) -> np.ndarray:
    """Whether the orders of rows a to b are within a footrule distance of all rows of a file.

    With L pivots in an order, the distance is L (L + 1) less twice the sum, over common pivots, of L less the later place.
    """
    length = orders.shape[1]
    _, local = np.unique(orders, return_inverse=True)
    local = local.reshape(orders.shape)
    weight = np.zeros((b - a, int(local.max()) + 1), np.uint8)
    np.put_along_axis(weight, local[a:b], (length - np.arange(length)).astype(np.uint8)[None], 1)
    shared = np.zeros((b - a, len(orders)), np.uint16)
    for j in range(length):
        shared += np.minimum(weight[:, local[:, j]], np.uint8(length - j))
    return length * (length + 1) - 2 * shared.astype(np.int32) <= footrule


def _rank(slices_bytes: bytes, width: int, k: int, posted: int, footrule: int | None):
    """The files of the index, one after another: (class, sims, ids), the best k + 1 rows for each vector of a file."""

    slices = np.frombuffer(slices_bytes, np.int64)

    def file(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        number = table.column(0)[0].as_py()
        pivot, low, high = number >> 32, number >> 16 & 0xFFFF, number & 0xFFFF
        classes = table.column(1).to_numpy()
        x = _unit(table.column(2).to_pylist(), width)
        orders = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint16).reshape(len(x), -1)
        files = orders[:, :posted]
        ids = table.column(4).to_pylist()
        names = np.array([i for own in ids for i in own], dtype=object)
        holder = np.repeat(np.arange(len(x)), [len(own) for own in ids])
        place = np.empty(len(names), np.int64)
        place[np.argsort(names.astype(str), kind="stable")] = np.arange(len(names))
        rank_of = (files == pivot).argmax(axis=1)
        side = classes % slices[pivot] if low != high else None
        step = max(1, min(1024, 40_000_000 // max(1, len(x))))
        for a in range(0, len(x), step):
            b = min(len(x), a + step)
            similar = np.rint(np.clip(x[a:b] @ x.T, -1, 1) * 1e6).astype(np.int64)
            out = np.zeros(similar.shape, bool)
            if footrule is not None:
                out |= ~_near(orders, a, b, footrule)
            if side is not None:
                out |= side[a:b, None] == side[None]  # they meet in the slice's own file
            similar[out] = -2_000_000
            key = similar[:, holder] * np.int64(len(names)) + (len(names) - 1 - place)
            wanted = min(k + 1, len(names))
            best = np.argpartition(-key, wanted - 1, axis=1)[:, :wanted]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, 1), axis=1), 1)
            sims = np.take_along_axis(similar, holder[best], 1)
            # a pair that an earlier file of the vector holds too is left to that file: it stands there unless k + 1 better rows do
            mine = rank_of[a:b]
            other = files[holder[best]]
            earlier = np.zeros(best.shape, bool)
            for at in range(files.shape[1]):
                earlier |= (at < mine)[:, None] & (other == files[a:b, at, None, None]).any(axis=2)
            sims[earlier] = -2_000_000
            found = [[(int(s), n) for s, n in zip(row, names[cols], strict=True) if s > -2_000_000] for row, cols in zip(sims, best, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[a:b]), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.string()))],
                names=["class", "sims", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    if held:
                        yield from file(held)
                    now, held = numbers[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from file(held)

    return run


def _slices(sample: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The slices of each file, from the sizes that a sample foretells."""
    counts = np.zeros(len(pivots), np.int64)
    first = min(posted, len(pivots))
    for a in range(0, len(sample), 4096):
        counts += np.bincount(_orders(sample[a : a + 4096], pivots, first).ravel(), minlength=len(pivots))
    mean = first * len(sample) / len(pivots)
    return np.clip(np.ceil(counts / (SPLIT * mean)), 1, 0xFFFF).astype(np.int64)


def nearest(vectors: DataFrame, k: int = 5, width: int = 64, posted: int = POSTED, footrule: int | None = FOOTRULE, pivots: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank) of the k most similar other rows of every usable row; ``vectors`` has id, embedding.

    Similarity is the cosine in double precision rounded to 6 decimals; larger first, ties by smaller id. ``pivots`` is their
    number, by default from the number of rows; the footrule distance is that of orders of ``max(ORDER, posted)`` pivots and
    is scaled to it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    usable = cut(vectors.select(F.col("id").cast("string"), F.col("embedding").cast("array<float>")).mapInArrow(_usable(width), "id string, class bigint, vector binary"))
    members = usable.select("class", "id").distinct()
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("n") <= k + 1)
    held = first.groupBy("class").agg(F.collect_list("id").alias("ids"))  # k + 1 ids at most
    classes = usable.groupBy("class").agg(F.first("vector").alias("vector")).join(held, "class")
    rows = usable.count()
    wanted = min(MOST_PIVOTS, pivots or max(LEAST_PIVOTS, 1 << math.ceil(math.log2(4 * math.sqrt(max(1, rows))) - 0.5)))
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 52))
    share = min(1 << 52, math.ceil((wanted * SAMPLE / max(1, rows)) * (1 << 52)))
    picked = usable.select("vector", place.alias("place")).where(F.col("place") < share).distinct()  # copies fold in each task
    drawn = [bytes(r["vector"]) for r in sorted(picked.collect(), key=lambda r: (r["place"], bytes(r["vector"])))]
    schema = "id string, neighbour string, similarity double, rank int"
    if not drawn:
        return spark.createDataFrame([], schema)
    sample = _unit(drawn, width).astype(np.float32)
    chosen = sample[: max(1, min(wanted, len(drawn)))]
    length = min(max(ORDER, posted), len(chosen))
    bound = None if footrule is None else math.floor(footrule * length * (length + 1) / (ORDER * (ORDER + 1)) + 1e-9)
    if len(chosen) <= posted:
        bound = None  # every vector stands in every file
    slices = _slices(sample, chosen, posted).tobytes()
    posting = classes.select("class", "vector", "ids").mapInArrow(_post(chosen.tobytes(), slices, width, posted), "file bigint, class bigint, vector binary, order binary, ids array<string>")
    files = posting.repartition(max(12, len(chosen) // 32), "file").sortWithinPartitions("file")
    ranked = files.mapInArrow(_rank(slices, width, k, posted, bound), "class bigint, sims array<int>, ids array<string>")
    pair = F.transform(F.arrays_zip("sims", "ids"), lambda p: F.struct((-p["sims"]).alias("s"), p["ids"].alias("i")))
    merged = ranked.groupBy("class").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pair)))), 1, k + 1).alias("best"))
    own = merged.join(members, "class").select("id", F.slice(F.filter("best", lambda p: p["i"] != F.col("id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("rank", "p")).select("id", F.col("p.i").alias("neighbour"), (-F.col("p.s") / 1e6).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))
