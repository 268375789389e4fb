import random
from collections import defaultdict

import pytest

from corvane.llm import packing as P
from corvane.llm import tokens as T


@pytest.mark.parametrize(("capacity", "n", "seed"), [(64, 40, 1), (256, 900, 2), (1024, 900, 3), (7, 30, 4), (100, 1, 5)])
def test_plans_place_every_part_once(capacity, n, seed):
    rng = random.Random(seed)
    sizes = [max(1, min(capacity, int(rng.lognormvariate(3.5, 1)))) for _ in range(n)]
    large, small = defaultdict(int), defaultdict(int)
    for s in sizes:
        (small if s <= P.SMALL * capacity else large)[s] += 1
    slots, containers = P.plan_large(dict(large), capacity)
    load, seen = defaultdict(int), defaultdict(set)
    for s, a, b, first, repeat in slots:
        for k in range(a, b):
            load[first + (k - a) // repeat] += s
            assert k not in seen[s]
            seen[s].add(k)
    assert all(seen[s] == set(range(m)) for s, m in large.items())
    assert set(load) == set(range(containers)) and all(v <= capacity for v in load.values())
    rooms = defaultdict(int)
    for v in load.values():
        rooms[capacity - v] += 1
    slots, new = P.plan_small(dict(small), dict(rooms), capacity, containers)
    lent, seen = defaultdict(int), defaultdict(set)
    for s, a, b, room, first, repeat in slots:
        for k in range(a, b):
            lent[(room, first + (k - a) // repeat)] += s
            assert k not in seen[s]
            seen[s].add(k)
    assert all(seen[s] == set(range(m)) for s, m in small.items())
    assert all(v <= (room or capacity) and (not room or i < rooms[room]) for (room, i), v in lent.items())
    assert containers + new <= 1.1 * sum(sizes) / capacity + 2


def test_tables(spark):
    rows = [(1, 0), (2, 5), (2 + 1, 64), (4, 200), (5, None)] + [(10 + i, 1 + i % 40) for i in range(300)]
    sized = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, tokens bigint, rank int")
    caps = spark.createDataFrame([("a", 64), ("b", 500), ("none", None)], "pack_name string, capacity_tokens int")
    out = P.pack(sized, caps).collect()
    want = sum(t or 0 for _, t in rows)
    for name, cap in (("a", 64), ("b", 500)):
        mine = [r for r in out if r.pack_name == name]
        load = defaultdict(int)
        for r in mine:
            load[r.container] += r.tokens
        assert sum(load.values()) == want and max(load.values()) <= cap
        split = {r.doc_id for r in mine if r.part > 0}
        assert split == ({4} if cap == 64 else set())
        assert len({(r.doc_id, r.part) for r in mine}) == len(mine)
    assert P.fill(P.pack(sized, caps), caps).count() == 2
    assert P.pack(sized.limit(0), caps).count() == 0 and P.pack(sized, caps.limit(0)).count() == 0


def test_tokens(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hello world", "a"), (4, "x y " * 60_000, "a")], "doc_id bigint, text string, tokens string")
    out = {r.doc_id: r.tokens for r in T.counted(rows, "doc_id", "text").collect()}
    enc = T.encoding(T.VOCABULARY)
    assert out == {1: 0, 2: 0, 3: 2, 4: len(enc.encode_ordinary("x y " * 60_000))}


def test_counts_of_long_texts_are_those_of_the_whole():
    rng = random.Random(4)
    enc = T.encoding(T.VOCABULARY)
    body = "".join(rng.choice(["word ", "x1 ", "\n", "  \n ", "it's ", "語。", "\t", "...", "don't\n"]) for _ in range(90_000))
    assert len(body) > 2 * T.STRETCH and T.count(body) == len(enc.encode_ordinary(body))
    for text in ("漢字" * 120_000, "ab" * 150_000, "!" * 250_000, "1" * 250_000, "a" + " " * 20_000 + "b " + "\n" * 15_000):
        assert T.count(text) == len(enc.encode_ordinary(text))
    assert T.count(" " * 1_000_000 + "x") > 0  # too much white space for the splitter in one call


def test_slices_follow_the_counts(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id as doc_id", "0 as part", "'a' as pack_name", "cast(if(id < 400, 7, id) as bigint) as tokens")
    for most in (100_000, 30):
        monkeypatch.setattr(P, "SLICE", most)
        got = P.ranked(rows, "pack_name", "tokens").collect()
        assert sorted(r["rank"] for r in got if r.tokens == 7) == list(range(400)) and all(r["rank"] == 0 for r in got if r.tokens != 7)
