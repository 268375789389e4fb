import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import neighbours as N


def brute(rows, k):
    ok = sorted({i: v for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}.items())
    x = np.array([v for _, v in ok], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.rint(x @ x.T * 1e6)
    np.fill_diagonal(s, -9e6)
    return {ok[i][0]: [ok[j][0] for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(ok))}


def test_small_collections_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{i:03}", rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(f"d{i}", rows[0][1]) for i in range(9)]  # ties among equal vectors
    rows += [(f"p{i}", [2.0 * v for v in rows[1][1]]) for i in range(3)] + [rows[5], rows[5]]
    rows += [("n", None), ("z", [0.0] * 8), ("w", [1.0]), ("f", [float("nan")] * 8), ("i", [float("inf")] + [0.0] * 7), ("h", [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, embedding array<float>, class int")
    got = {}
    for r in N.nearest(df, 3, 8).orderBy("id", "rank").collect():  # all rows are pivots, so the first three meet
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute(rows, 3)


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 8)) * 3
    rows = [(f"{i:05}", (centres[i % 60] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(3000)]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, "id string, embedding array<float>"), 5, 8).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(rows, 5)
    assert sum(len(got.get(i, set()) & set(w)) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "id string, embedding array<float>")
    assert N.nearest(empty, 5, 8).count() == 0
    assert N.nearest(spark.createDataFrame([("a", [1.0] * 8)], empty.schema), 5, 8).count() == 0


def footrule(a, b):
    """The induced footrule distance of two orders: a missing pivot stands behind the last."""
    n = len(a)
    at = lambda order, p: order.index(p) if p in order else n
    return sum(abs(at(a, p) - at(b, p)) for p in set(a) | set(b))


def test_footrule():
    rng = np.random.default_rng(8)
    orders = np.array([rng.permutation(14)[:8] for _ in range(60)], np.uint16)
    for bound in (20, 40, 60, 72):
        got = N._near(orders, 10, 40, bound)
        assert got.tolist() == [[footrule(a, b) <= bound for b in orders.tolist()] for a in orders[10:40].tolist()]


@pytest.mark.parametrize("bound", [None, 48])
@pytest.mark.parametrize("parts", [1, 3])
def test_dense_and_split_files_lose_nothing(bound, parts):
    """Every list is the best of all vectors that share a file and are within the footrule distance, split or not."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    batch = pa.record_batch([pa.array(range(600), pa.int64()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([[f"{i:03}"] for i in range(600)], pa.list_(pa.string()))], names=["class", "vector", "ids"])
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    slices = np.full(9, parts, np.int64).tobytes()
    posted = pa.Table.from_batches(list(N._post(unit[:9].astype(np.float32).tobytes(), slices, 8, 5)(iter([batch])))).sort_by("file")
    own = np.zeros((600, 9), bool)
    own[posted["class"].to_numpy(), posted["file"].to_numpy() >> 32] = True
    orders = {c: np.frombuffer(o, np.uint16).tolist() for c, o in zip(posted["class"].to_pylist(), posted["order"].to_pylist(), strict=True)}
    assert own.sum(axis=0).max() > 300
    got = {}
    for out in N._rank(slices, 8, 5, 5, bound)(iter(posted.to_batches())):
        for c, sims, ids in zip(*(col.to_pylist() for col in out.columns), strict=True):
            got.setdefault(c, []).extend(zip([-s for s in sims], ids, strict=True))
    s = np.where((own[:, None] & own[None]).any(axis=2), np.rint(unit @ unit.T * 1e6), -9e6)
    for i in range(0, 600, 1 if bound is None else 12):
        row = s[i] if bound is None else np.where([footrule(orders[i], orders[j]) <= bound for j in range(600)], s[i], -9e6)
        want = [j for j in np.argsort(-row, kind="stable")[:6].tolist() if row[j] > -9e6]
        assert [int(n) for _, n in sorted(got[i])[: len(want)]] == want


def skewed(rng, n):
    """Half of the vectors in one dense cluster, the others in forty, 64 wide."""
    centres = rng.normal(size=(41, 64)) * 3
    which = np.where(np.arange(n) % 2, 40, rng.integers(0, 40, n))
    return (centres[which] + rng.normal(size=(n, 64)) * 0.5).astype(np.float32)


def test_recall_at_full_width_on_skewed_data_by_the_knobs(spark):
    rng = np.random.default_rng(5)
    x = skewed(rng, 4000)
    df = spark.createDataFrame([(f"{i:05}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.rint(u @ u.T * 1e6)
    np.fill_diagonal(s, -9e6)
    want = {f"{i:05}": {f"{j:05}" for j in np.argsort(-s[i], kind="stable")[:5]} for i in range(len(x))}

    def recall(**knobs):
        got = {}
        for r in N.nearest(df, **knobs).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        return sum(len(got.get(i, set()) & w) for i, w in want.items()) / 5 / len(want)

    usual, wide = recall(), recall(posted=16, footrule=None)
    assert usual >= 0.8 and wide >= 0.98
    assert recall(posted=64, footrule=None, pivots=64) == 1.0  # every pair meets
