"""Near-duplicate records: a blocked sparse matrix product of documents by n-grams, with bounds derived from sizes.

A document is the set of its distinct word n-grams; documents with equal sets are one class. The product of the incidence
matrix with its transpose is taken in blocks of n-grams, and bounds from the sizes keep it sparse:

1. Each task turns its texts into n-gram hashes and posts them, packed, to blocks of the hash range.
2. A block counts in how many classes each n-gram occurs (over all documents) and drops those of a single class, which
   can't add to any overlap. The rest goes back to the classes.
3. A class of size n needs ``ceil(t n)`` n-grams in common with any partner, so one with fewer shared ones is dropped. In
   the order of rising frequency, two classes at threshold t share at least ``shared_least(t)`` among the first
   ``n - ceil(t n) + shared_least(t)``; only these are posted again.
4. The blocks multiply: pairs of classes in one column, within the size bound ``t max(n) <= min(n)`` and the bound on what
   can still follow their positions, accumulate their counts; pairs below ``shared_least(t)`` are discarded.
5. The overlap of each pair left is counted exactly, on the texts of one record of either class.

Nothing is capped: no limit on partners, candidates or frequencies. Hot keys are split at every step:

* copies within one task post once, so a class that holds a third of all rows costs one row for each task, and its records
  are spread by their own ids, never gathered by class;
* an n-gram that ``HOT`` classes of one task share goes straight to its classes, with a note to its block, so a block gets
  fewer than ``HOT`` postings of one n-gram from any task;
* a column of more than ``COLUMN`` classes is multiplied in tiles by other tasks.

A block is a partition of its own, of about ``BLOCK`` postings. In the product n-grams are told apart by their block and 24
bits, which takes less to move; a class knows how many of its own n-grams that makes equal, and its bounds are lowered by as many, so chance can add
candidates but lose none. Classes are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cores, cut, ship_package

#: Postings aimed at in a block, and postings after which a task hands over what it has.
BLOCK, FLUSH = 2_500_000, 6_000_000
#: Classes of one task that make an n-gram hot (frequencies are told apart up to this number), and classes of a column that
#: one task multiplies.
HOT, COLUMN = 255, 20_000
#: Records of a class that one task pairs with a row.
SLICE = 1024
#: Bits that tell n-grams of one block apart.
LOW = 24

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_U64 = np.uint64


def shared_least(threshold: float) -> int:
    """n-grams that two records of different sets at the threshold share at least: two above 0.5, as 1 of 2 makes 0.5."""
    return 2 if threshold > 0.5 else 1


class _Hashes(dict):
    """Word to 64-bit hash, emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def gram_sets(texts: list[str | None], width: int, least_words: int, salt: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram) of the distinct n-grams of each text, sorted; texts of fewer words give none."""
    words, owners, at = [], [], 0
    for i, text in enumerate(texts):
        found = _WORD.findall((text or "").lower())
        if len(found) >= max(least_words, width):
            words.extend(map(known.__getitem__, found))
            owners.append((i, at, at + len(found)))
            at += len(found)
    if not owners:
        return np.empty(0, np.int64), np.empty(0, _U64)
    w = np.array(words, _U64)
    doc = np.repeat(np.array([o[0] for o in owners], np.int64), [o[2] - o[1] for o in owners])
    n = len(w) - width + 1
    h = np.full(n, salt, _U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = _mix(h * _U64(0x9E3779B97F4A7C15) + w[k : n + k])
    inside = doc[:n] == doc[width - 1 :]
    doc, h = doc[:n][inside], h[inside]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _pack(*arrays: np.ndarray) -> bytes:
    return np.uint32(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


#: Three bytes a number, read as 32 bits.
_U24 = np.dtype((np.uint8, (3,)))


def _three(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]


def _read(p: bytes, kind, n: int, at: int) -> np.ndarray:  # noqa: ANN001
    if kind is not _U24:
        return np.frombuffer(p, kind, n, at)
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = np.frombuffer(p, np.uint8, 3 * n, at).reshape(-1, 3)
    return out.view("<u4").ravel()


def _unpack(payloads: list[bytes], *types) -> list[np.ndarray]:  # noqa: ANN002
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for p in payloads:
        n, at = int(np.frombuffer(p, np.uint32, 1)[0]), 4
        for out, t in zip(parts, types, strict=True):
            out.append(_read(p, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.empty(0, np.uint32 if t is _U24 else t) for p, t in zip(parts, types, strict=True)]


_ROW = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("tbl", pa.string()), ("id", pa.string()), ("class", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
_ROW_DDL = "block int, kind byte, tbl string, id string, class bigint, n int, payload binary"


def _rows(items: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*items, strict=True) if items else [[]] * 7, _ROW, strict=True)], schema=_ROW)


def _split(block: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by block."""
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _by_block(step: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], passed: tuple[int, ...]) -> Callable:
    """Runs a step on the rows of each block, which come one block after another; kinds in ``passed`` go through unheld."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            through = np.isin(batch.column(1).to_numpy(zero_copy_only=False), passed)
            if through.any():
                yield batch.filter(pa.array(through))
                batch = batch.filter(pa.array(~through))
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    if held:
                        yield from step(int(now), held)
                    now, held = numbers[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from step(int(now), held)

    return run


def _payloads(held: list[pa.RecordBatch], kind: int) -> list[bytes]:
    out = []
    for batch in held:
        for k, p in zip(batch.column(1).to_pylist(), batch.column(6), strict=True):
            if k == kind:
                out.append(p.as_py())
    return out


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _poster(width: int, least_words: int, bits: int) -> Callable:
    """Step 1: texts to packed postings, sizes of classes, and one row for the class of each document (kinds 1 to 5)."""
    blocks, shift, mask = 1 << bits, _U64(64 - LOW - bits), _U64((1 << LOW) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), set()
        held_class: list[np.ndarray] = []
        held_gram: list[np.ndarray] = []
        held = 0

        def hand_over() -> pa.RecordBatch:
            grams, classes = np.concatenate(held_gram) >> shift, np.concatenate(held_class)  # block and LOW bits more
            held_gram.clear()
            held_class.clear()
            items = []
            values, counts = np.unique(grams, return_counts=True)
            hot = values[counts >= HOT]
            if len(hot):
                at = np.searchsorted(hot, grams)
                at[at == len(hot)] = 0
                direct = hot[at] == grams
                for b, where in _split((classes[direct] % _U64(blocks)).astype(np.int64), blocks):
                    docs, index = np.unique(classes[direct][where], return_inverse=True)
                    order = np.argsort(index, kind="stable")
                    items.append((b, 3, None, None, None, None, _pack(docs, np.bincount(index).astype(np.uint32)) + _pack(grams[direct][where][order])))
                for b, where in _split((hot >> _U64(LOW)).astype(np.int64), blocks):
                    items.append((b, 4, None, None, None, None, _pack(_three(hot[where] & mask))))
                grams, classes = grams[~direct], classes[~direct]
            for b, where in _split((grams >> _U64(LOW)).astype(np.int64), blocks):
                docs, index = np.unique(classes[where], return_inverse=True)
                for a in range(0, len(docs), 65536):
                    inside = (index >= a) & (index < a + 65536)
                    part, local = where[inside], (index[inside] - a).astype(np.uint16)
                    items.append((b, 1, None, None, None, None, _pack(docs[a : a + 65536]) + _pack(_three(grams[part] & mask), local)))
            return _rows(items)

        for batch in batches:
            tables, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for tag in sorted(set(tables), key=str):
                mine = [i for i, t in enumerate(tables) if t == tag]
                salt = xxhash.xxh3_64_intdigest(str(tag))
                for a in range(0, len(mine), 2000):
                    part = mine[a : a + 2000]
                    doc, gram = gram_sets([texts[i] for i in part], width, least_words, salt, known)
                    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
                    sizes = np.diff(np.concatenate((starts, [len(doc)]))).astype(np.int64)
                    rows, fresh = [], np.zeros(len(starts), bool)
                    keys = np.array([xxhash.xxh3_64_intdigest(gram[s : s + n].tobytes(), seed=salt & 0xFFFF) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)], _U64)
                    whole = set(doc[starts].tolist())
                    for k in range(len(part)):
                        if k not in whole:  # a text without n-grams stands with those of the same words
                            words = " ".join(_WORD.findall((texts[part[k]] or "").lower()))
                            rows.append((_spread(ids[part[k]], blocks), 0, tag, ids[part[k]], _signed(xxhash.xxh3_64_intdigest(words, seed=(salt & 0xFFFF) + 1)), 0, None))
                    for k, (key, first, n) in enumerate(zip(keys.tolist(), starts.tolist(), sizes.tolist(), strict=True)):
                        if key not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(key)
                            fresh[k] = True
                        at = part[int(doc[first])]
                        rows.append((_spread(ids[at], blocks), 0, tag, ids[at], _signed(key), n, None))
                    if fresh.any():
                        # n-grams of one text that the product can't tell apart stand side by side, as hashes are in order
                        short = gram >> shift
                        equal = np.concatenate(([False], (short[1:] == short[:-1]) & (doc[1:] == doc[:-1])))
                        lost = np.add.reduceat(equal.astype(np.int64), starts)
                        for b, where in _split((keys[fresh] % _U64(blocks)).astype(np.int64), blocks):
                            rows.append((b, 5, None, None, None, None, _pack(keys[fresh][where], sizes[fresh][where].astype(np.uint32), lost[fresh][where].astype(np.uint32))))
                    yield _rows(rows)
                    take = np.repeat(fresh, sizes)
                    held_gram.append(gram[take])
                    held_class.append(np.repeat(keys, sizes)[take])
                    held += int(take.sum())
                    if held >= FLUSH:
                        yield hand_over()
                        held = 0
        if held:
            yield hand_over()

    return run


def _spread(key: str | None, blocks: int) -> int:
    return xxhash.xxh3_64_intdigest(key or "") % blocks


def _postings(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    grams, classes = [], []
    for p in _payloads(held, 1):
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        docs = np.frombuffer(p, _U64, n, 4)
        at = 4 + 8 * n
        m = int(np.frombuffer(p, np.uint32, 1, at)[0])
        grams.append(_read(p, _U24, m, at + 4))
        classes.append(docs[np.frombuffer(p, np.uint16, m, at + 4 + 3 * m)])
    if not grams:
        return np.empty(0, np.uint32), np.empty(0, _U64)
    return np.concatenate(grams), np.concatenate(classes)


def _counter(bits: int) -> Callable:
    """Step 2: n-grams of two classes or more, with their frequencies up to ``HOT``, sent to the blocks of their classes."""
    blocks = 1 << bits

    def step(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, owner = _postings(held)
        if not len(gram):
            return
        (hot,) = _unpack(_payloads(held, 4), _U24)
        ordered = np.sort(gram)
        kept = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], hot)
        if not len(kept):
            return
        spot = np.searchsorted(kept, gram)
        spot[spot == len(kept)] = 0
        keep = kept[spot] == gram
        gram, owner = gram[keep], owner[keep]
        order = np.lexsort((owner, gram))
        gram, owner = gram[order], owner[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner = gram[new], owner[new]
        if not len(gram):
            return
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(gram)])))
        sizes = np.where(np.isin(gram[starts], hot), HOT, np.minimum(sizes, HOT))
        often = np.repeat(sizes.astype(np.uint8), np.diff(np.concatenate((starts, [len(gram)]))))
        keep = often > 1
        gram, owner, often = gram[keep], owner[keep], often[keep]
        items = []
        for b, where in _split((owner % _U64(blocks)).astype(np.int64), blocks):
            where = where[np.argsort(owner[where], kind="stable")]
            docs, counts = np.unique(owner[where], return_counts=True)
            items.append((b, 2, None, None, None, block, _pack(docs, counts.astype(np.uint32)) + _pack(_three(gram[where]), often[where])))
        yield _rows(items)

    return _by_block(step, (0, 3, 5))


def _shared(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owners, grams, often = [np.empty(0, _U64)], [np.empty(0, _U64)], [np.empty(0, np.uint8)]
    for batch in held:
        for kind, source, p in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6), strict=True):
            if kind not in (2, 3):
                continue
            p = p.as_py()
            docs, counts = _unpack([p], _U64, np.uint32)
            rest = p[4 + 12 * len(docs) :]
            if kind == 2:
                low, f = _unpack([rest], _U24, np.uint8)
                grams.append((_U64(source) << _U64(LOW)) | low.astype(_U64))
            else:
                grams.append(_unpack([rest], _U64)[0])
                f = np.full(len(grams[-1]), HOT, np.uint8)
            owners.append(np.repeat(docs, counts))
            often.append(f)
    owner, gram, f = np.concatenate(owners), np.concatenate(grams), np.concatenate(often)
    order = np.lexsort((gram, f, owner))
    owner, gram, f = owner[order], gram[order], f[order]
    new = np.ones(len(owner), bool)  # a hot n-gram may come from several tasks
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new], f[new]


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for p in _payloads(held, 6):
        docs, sizes, counts = _unpack([p], _U64, np.uint32, np.uint32)
        low, room = _unpack([p[4 + 16 * len(docs) :]], _U24, np.uint32)
        parts.append((low, np.repeat(docs, counts), np.repeat(sizes, counts), room))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _prefixer(threshold: float, bits: int) -> Callable:
    """Step 3: of the classes that can have partners, their first n-grams sent to the n-grams' blocks (kind 6)."""
    blocks, least_shared = 1 << bits, shared_least(threshold)

    def step(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, gram, _ = _shared(held)
        if not len(owner):
            return
        keys, n_of, lost_of = _unpack(_payloads(held, 5), _U64, np.uint32, np.uint32)
        keys, first = np.unique(keys, return_index=True)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        counts = np.diff(np.concatenate((starts, [len(owner)])))
        at = first[np.searchsorted(keys, owner[starts])]
        n, lost = n_of[at].astype(np.int64), lost_of[at].astype(np.int64)
        least = np.ceil(threshold * n - 1e-9).astype(np.int64)
        prefix = np.where(counts + lost >= least, counts + lost - least + least_shared, 0).clip(0, counts)
        rank = np.arange(len(owner)) - np.repeat(starts, counts)
        take = rank < np.repeat(prefix, counts)
        room = (np.repeat(counts + lost, counts) - rank)[take].astype(np.uint32)  # n-grams from here on that can be shared
        size = np.repeat(n, counts)[take].astype(np.uint32)
        first_gram, first_owner = gram[take], owner[take]
        items = []
        for b, where in _split((first_gram >> _U64(LOW)).astype(np.int64), blocks):
            docs, index = np.unique(first_owner[where], return_inverse=True)
            order = where[np.argsort(index, kind="stable")]
            per_doc = np.bincount(index)
            items.append((b, 6, None, None, None, None, _pack(docs, size[order[np.cumsum(per_doc) - 1]], per_doc.astype(np.uint32)) + _pack(_three(first_gram[order] & _U64((1 << LOW) - 1)), room[order])))
        if items:
            yield _rows(items)

    return _by_block(step, (0,))


def _may_match(threshold: float, size_a, size_b, room_a, room_b) -> np.ndarray:
    """Whether what can follow a shared n-gram suffices for the threshold."""
    need = np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-9)
    return np.minimum(room_a, room_b) + shared_least(threshold) - 1 >= need


class _Pairs:
    """Pairs of classes gathered and counted up to a bound, then handed over."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.a.append(np.minimum(x, y))
        self.b.append(np.maximum(x, y))
        self.held += len(x)

    def counted(self) -> pa.RecordBatch:
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.a, self.b, self.held = [], [], 0
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        counts = np.diff(np.concatenate((starts, [len(a)])))
        return pa.RecordBatch.from_arrays([pa.array(a[starts].view(np.int64)), pa.array(b[starts].view(np.int64)), pa.array(counts.astype(np.int64))], names=["a", "b", "shared"])


_PAIRS_DDL = "a bigint, b bigint, shared bigint"


def _multiplier(threshold: float, tiles: bool = False) -> Callable:
    """Step 4: (a, b, shared): classes in one column of a block, within the bounds, with the columns they share there.

    Columns of more than ``COLUMN`` classes are left to ``_tiles``: with ``tiles``, (tile) of two runs of such a column.
    """

    def step(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, owner, size, room = _columns(held)
        order = np.lexsort((size, gram))
        gram, owner, size, room = gram[order], owner[order], size[order].astype(np.int64), room[order].astype(np.int64)
        # rows of one column are in the order of size: partners of a row follow it up to the size bound
        reach = np.searchsorted(gram, gram, side="right")
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        live = np.arange(len(gram))
        for s in starts[reach[starts] - starts > COLUMN].tolist():
            live = live[(live < s) | (live >= reach[s])]
            runs = [slice(x, min(x + COLUMN, int(reach[s]))) for x in range(s, int(reach[s]), COLUMN)] if tiles else []
            for i, p in enumerate(runs):
                for q in runs[i:]:
                    if size[p.stop - 1] >= threshold * size[q.start] - 1e-9:
                        body = b"".join(_pack(owner[r], size[r].astype(np.uint32), room[r].astype(np.uint32)) for r in ((p,) if p is q else (p, q)))
                        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["tile"])
        if tiles:
            return
        found, step_by = _Pairs(), 1
        while True:
            live = live[live + step_by < reach[live]]
            live = live[size[live] >= threshold * size[live + step_by] - 1e-9]  # sizes rise along the column
            if not len(live):
                break
            i, j = live, live + step_by
            ok = _may_match(threshold, size[i], size[j], room[i], room[j])
            if ok.any():
                found.add(owner[i[ok]], owner[j[ok]])
                if found.held > 4_000_000:
                    yield found.counted()
            step_by += 1
        if found.held:
            yield found.counted()

    return _by_block(step, ())


def _tiles(threshold: float) -> Callable:
    """The pairs of two runs of a hot column, or of one run with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                body = body.as_py()
                own_p, size_p, room_p = _unpack([body], _U64, np.uint32, np.uint32)
                rest = body[4 + 16 * len(own_p) :]
                own_q, size_q, room_q = _unpack([rest], _U64, np.uint32, np.uint32) if rest else (own_p, size_p, room_p)
                size_p, room_p, size_q, room_q = (x.astype(np.int64) for x in (size_p, room_p, size_q, room_q))
                found = _Pairs()
                for a in range(0, len(own_p), 200):
                    p = slice(a, a + 200)
                    ok = (size_p[p, None] >= threshold * size_q[None] - 1e-9) & _may_match(threshold, size_p[p, None], size_q[None], room_p[p, None], room_q[None])
                    i, j = np.nonzero(ok)
                    if not rest:
                        i, j = i[i + a < j], j[i + a < j]
                    if len(i):
                        found.add(own_p[i + a], own_q[j])
                        if found.held > 4_000_000:
                            yield found.counted()
                if found.held:
                    yield found.counted()

    return run


def _verifier(width: int, least_words: int) -> Callable:
    """Step 5: (a, b, similarity) from the texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [*part.column(2).to_pylist(), *part.column(3).to_pylist()]
                doc, gram = gram_sets(texts, width, least_words, 0, known)
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                out, half = [], part.num_rows
                for i in range(half):
                    x, y = gram[edges[i] : edges[i + 1]], gram[edges[half + i] : edges[half + i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(both / max(1, len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return run


def similar_classes(records: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (tbl, id, class, n) of each record, n its distinct n-grams; links (a, b, similarity) between classes.

    ``records`` has tbl, id, content. Records of equal n-gram sets share a class; records of different ``tbl`` never link.
    NULL, empty and short contents have n = 0 and no links; those of the same words share a class. A redelivered key stands
    once in members; a key given with different contents stands once for each class.
    """
    spark = records.sparkSession
    ship_package(spark)
    narrow = records.select(F.col("tbl").cast("string"), F.col("id").cast("string"), F.col("content").cast("string"))
    size = int(str(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # a source that doesn't know its size
        size = narrow.agg(F.sum(F.length("content"))).first()[0] or 0
    bits = max(1, min(20, (max(2 * cores(spark), size // (BLOCK * 4)) - 1).bit_length()))
    posted = narrow.mapInArrow(_poster(width, least_words, bits), _ROW_DDL)
    spread = lambda df: df.repartitionById(1 << bits, "block").sortWithinPartitions("block")  # noqa: E731  a partition a block
    counted = spread(posted).mapInArrow(_counter(bits), _ROW_DDL)
    kept = cut(spread(counted).mapInArrow(_prefixer(threshold, bits), _ROW_DDL))
    members = kept.where("kind = 0").select("tbl", "id", "class", "n").distinct()
    columns = spread(kept.where("kind = 6"))
    hot = columns.mapInArrow(_multiplier(threshold, tiles=True), "tile binary").repartition(4 * cores(spark), F.xxhash64("tile")).mapInArrow(_tiles(threshold), _PAIRS_DDL)
    products = columns.mapInArrow(_multiplier(threshold), _PAIRS_DDL).unionByName(hot)
    pairs = cut(products.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= shared_least(threshold)).select("a", "b"))
    heads = members.groupBy("class").agg(F.min(F.struct("id", "tbl")).alias("head"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(heads, "class").select("class", "head.tbl", "head.id")
    texts = narrow.join(needed, ["tbl", "id"]).groupBy("class").agg(F.max("content").alias("content"))
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("content").alias("x")), "a").join(texts.select(F.col("class").alias("b"), F.col("content").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verifier(width, least_words), "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold - 1e-12)
    return members, links


def representatives(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (tbl, id, class_id, representative) of each record, and (tbl, id_a, id_b, similarity), id_a < id_b,
    between the representatives of linked classes: the whole answer in a size that no group of copies can square."""
    heads = members.groupBy("class").agg(F.min("id").alias("representative"), F.min("tbl").alias("tbl"))
    membership = members.join(heads.drop("tbl"), "class").select("tbl", "id", F.col("class").alias("class_id"), "representative")
    x, y = heads.select(F.col("class").alias("a"), "tbl", F.col("representative").alias("x")), heads.select(F.col("class").alias("b"), F.col("representative").alias("y"))
    return membership, links.join(x, "a").join(y, "b").select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def similar_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: every pair of records that share a class or stand in linked classes.

    This is the expansion of ``representatives`` for callers that need each pair, at any size of the classes. Rows meet the
    records of a class in slices of about ``SLICE``, so a class that holds a third of all rows is spread over as many tasks
    as its pairs need. Where copies abound, keep to ``representatives``, which is linear.
    """
    links = cut(links)
    linked = links.select(F.explode(F.array("a", "b")).alias("class")).distinct().withColumn("linked", F.lit(True))
    counts = members.where("n > 0").groupBy("class").agg(F.count("*").alias("copies")).join(linked, "class", "left").where((F.col("copies") > 1) | F.col("linked"))
    slices = counts.select("class", F.ceil(F.col("copies") / SLICE).cast("int").alias("slices"))
    sized = cut(members.where("n > 0").select("tbl", "id", "class").join(slices, "class"))
    sliced = sized.select("tbl", F.col("id").alias("y"), "class", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))

    def met(rows: DataFrame) -> DataFrame:
        """Rows (x, class) with each record y of the class."""
        spread = rows.join(slices, "class").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        return spread.join(sliced, ["class", "slice"]).drop("class", "slice")

    equal = met(sized.select(F.col("id").alias("x"), "class").join(counts.where("copies > 1").select("class"), "class", "left_semi")).where("x < y").select("tbl", "x", "y")
    first = met(links.select(F.col("a").alias("class"), "b")).drop("tbl").withColumnRenamed("y", "x")
    across = met(first.withColumnRenamed("b", "class")).select("tbl", "x", "y")
    return equal.unionByName(across).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
