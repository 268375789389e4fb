import random

import pyarrow as pa
import pytest
import regex

from corvane.llm import nearcopies as N


def grams(text, width):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}, len(w)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "語", "ß"]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 90))] for _ in range(n)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"b{i:03}", " ".join(b)))
        for k in range(rng.randrange(4)):
            c = list(b)
            for _ in range(rng.randrange(0, 9)):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((f"c{i:03}-{k}", " , ".join(c).upper()))
    return rows


@pytest.mark.parametrize(("threshold", "width", "least"), [(0.6, 3, 30), (0.8, 5, 0)])
def test_equals_brute_force(spark, threshold, width, least):
    rows = [("t", i, t, 1) for i, t in corpus(5, 40)] + [("u", i, t, 1) for i, t in corpus(5, 6)] + [("t", "b000", corpus(5, 1)[0][1], 1), ("t", "n", None, 1), ("t", "e", "", 1), ("t", "s", "one two", 1)]
    df = spark.createDataFrame(rows, "tbl string, id string, content string, class int")
    members, links = N.similar_classes(df, threshold, width, least)
    got = [tuple(r) for r in N.similar_records(members, links).collect()]
    assert len(got) == len(set(got))
    want = set()
    seen = {(t, i): grams(c, width) for t, i, c, _ in rows}
    keys = sorted(k for k, (g, n) in seen.items() if g and n >= max(least, width))
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if a[0] == b[0]:
                g, h = seen[a][0], seen[b][0]
                if len(g & h) / len(g | h) >= threshold:
                    want.add((a[0], a[1], b[1]))
    assert set(got) == want and want


@pytest.mark.parametrize("copies", [64, 65, 1100])
def test_copies_take_one_form_at_any_number(spark, copies):
    text = " ".join(f"k{i}" for i in range(40))
    rows = [("t", f"{i:04}", text) for i in range(copies)] + [("t", "z", text + " more words here"), ("t", "s", "too short"), ("t", "n", None)]
    members, links = N.similar_classes(spark.createDataFrame(rows, "tbl string, id string, content string"), 0.6, 3, 30)
    membership, pairs = N.representatives(members, links)
    held = {r.id: r.representative for r in membership.collect()}
    assert held == {f"{i:04}": "0000" for i in range(copies)} | {"z": "z", "s": "s", "n": "n"}
    assert [tuple(r)[:3] for r in pairs.collect()] == [("t", "0000", "z")]
    every = N.similar_records(members, links)
    assert every.count() == every.distinct().count() == copies * (copies - 1) // 2 + copies
    assert every.where("id_b = 'z'").count() == copies


@pytest.mark.parametrize(("threshold", "width"), [(0.6, 3), (0.5, 2), (0.3, 1)])
def test_common_n_grams_and_low_thresholds(spark, threshold, width):
    rng = random.Random(9)
    stem = [f"s{i}" for i in range(12)]
    rows = [("t", f"{i:03}", " ".join(stem + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(9))])) for i in range(150)] + [("t", f"x{i}", t) for i, t in enumerate(("a b", "a b c", "a", "b a"))]
    df = spark.createDataFrame(rows, "tbl string, id string, content string").repartition(3)
    sets = {i: grams(t, width)[0] for _, i, t in rows}
    keys = sorted(k for k, g in sets.items() if g)
    want = {(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12}
    members, links = N.similar_classes(df, threshold, width)
    assert {tuple(r)[1:] for r in N.similar_records(members, links).collect()} == want


def test_hot_paths_in_one_process(monkeypatch):
    """Posting, counting and multiplying with hot n-grams and tiles gives the same pairs as without."""
    rng = random.Random(3)
    stem = [f"s{i}" for i in range(20)]
    texts = [" ".join(stem + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 12))]) for i in range(120)]

    def through(f, batches):
        return [r for b in f(iter(batches)) for r in b.to_pylist()]

    def pairs(bits=2):
        parts = [pa.record_batch([pa.array(["t"] * 40), pa.array([str(i) for i in range(a, a + 40)]), pa.array(texts[a : a + 40])], names=["tbl", "id", "content"]) for a in (0, 40, 80)]
        rows = [r for p in parts for r in through(N._poster(3, 0, bits), [p])]
        kinds = {r["kind"] for r in rows}
        for f in (N._counter(bits), N._prefixer(0.6, bits)):
            table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["block"]), schema=N._ROW)
            rows = through(f, table.to_batches())
        table = pa.Table.from_pylist(sorted((r for r in rows if r["kind"] == 6), key=lambda r: r["block"]), schema=N._ROW)
        out, counts = through(N._multiplier(0.6), table.to_batches()), {}
        tiles = through(N._multiplier(0.6, tiles=True), table.to_batches())
        for r in tiles:
            out += through(N._tiles(0.6), [pa.record_batch([pa.array([r["tile"]], pa.binary())], names=["tile"])])
        for r in out:
            counts[r["a"], r["b"]] = counts.get((r["a"], r["b"]), 0) + r["shared"]
        return counts, kinds, len(tiles)

    plain, kinds, tiles = pairs()
    assert plain and not kinds & {3, 4} and not tiles
    monkeypatch.setattr(N, "HOT", 25)
    monkeypatch.setattr(N, "COLUMN", 9)
    hot, kinds, tiles = pairs()
    assert {3, 4} <= kinds and tiles
    sets = [grams(t, 3)[0] for t in texts]
    wanted = sum(len(a & b) / len(a | b) >= 0.6 and a != b for i, a in enumerate({frozenset(s) for s in sets}) for b in list({frozenset(s) for s in sets})[i + 1 :])
    assert len([1 for n in hot.values() if n >= 2]) >= wanted <= len([1 for n in plain.values() if n >= 2])


def test_empty(spark):
    members, links = N.similar_classes(spark.createDataFrame([], "tbl string, id string, content string"))
    assert members.count() == 0 and links.count() == 0


def test_different_texts_of_one_class_are_paired_in_full(spark):
    words = [f"k{i}" for i in range(40)]
    rows = [("t", f"d{i:03}", " ".join(w.upper() if i >> b & 1 else w for b, w in enumerate(words))) for i in range(1, 71)]
    rows += [("t", f"e{i:03}", " ".join(words)) for i in range(70)] + [("t", "z", " ".join(words) + " more words here")]
    members, links = N.similar_classes(spark.createDataFrame(rows, "tbl string, id string, content string"), 0.6, 3, 30)
    got = [tuple(r)[1:] for r in N.similar_records(members, links).collect()]
    shown = [r[1] for r in rows]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in shown for b in shown if a < b}
