import pytest
from corvane.llm import provenance as P

HAND = "import re\n\n\ndef move(plan, size=3):\n    if not plan:\n        raise ValueError('no plan')\n    return [x * size for x in plan]\n"


def body(seed: int, n: int = 12) -> str:
    return "".join(f"def step_{seed}_{i}(a, b):\n    total = a * {seed} + b - {i * 7}\n    return check_{seed}(total, b)\n\n" for i in range(n))


def test_composition():
    c = P.composition
    assert c("a.py", HAND) is None
    assert c("a.py", "# Code generated by x. DO NOT EDIT.\n" + HAND) == "generated"
    assert c("a.go", "// (c) X team\n//\n// Diese Datei wurde maschinell erzeugt (x), bitte nicht bearbeiten\npackage a\n") == "generated"
    assert c("gen.py", HAND + 'HEADER = "Code generated by x. DO NOT EDIT."\n') is None
    assert c("r.py", "# The weekly report is generated by this module; edit freely.\n" + HAND) is None
    assert c("a.js", "var a=1;function b(c){return c?1:b(c-1)}" * 30) == "minified"
    assert c("a.py", "w = [\n" + "    [0.28919, -0.37889, -0.11004, 0.12560],\n" * 30 + "]\n") == "data"
    assert c("a.h", "static const unsigned char x[] = {\n" + "  0xd5, 0x6b, 0x58, 0xf5, 0x81, 0xf3,\n" * 30 + "};\n") == "data"
    assert c("limits.py", HAND + "LIMITS = [\n" + "".join(f'    ("item{chr(97 + i)}", {i * 13 % 50}),  # why\n' for i in range(8)) + "]\n") is None
    assert c("a.go", "".join(f'func (x *T) Get{n}{i}() string {{ if x != nil {{ return x.f{i} }}; return "" }}\n' for i, n in enumerate("abcdefghij"))) == "generated"
    assert c("a.c", "/*!\n * lib v1.2.3 | (c) 2011 X Project | MIT license\n */\nint a;\n") == "vendored"
    assert c("node_modules/x/i.py", HAND) == "vendored"
    assert c("services/vendors/i.py", HAND) is None
    assert c("a.py", "# Copyright (c) 2021 own maintainers\n" + HAND) is None
    assert c("a.py", "\n \n") is None


def test_unloaded():
    assert P.unloaded("dist/a.min.js", None) == "minified"
    assert P.unloaded("build/generated/a.pb.go", 0) == "generated"
    assert P.unloaded("vendor/x/x.go", 5) == "vendored"
    assert P.unloaded("src/a.go", 120_000) is None
    assert P.unloaded("src/a.bin", 5_000_000) == "data"


def test_containment(spark):
    lib, shared = body(1), body(2)
    patched = shared.replace("step_2_3", "step_2_3x").replace("total = a * 2 + b - 14", "total = a * 2 + b - 15")
    rows = [
        (1, "o/a", "src/copy.py", "file", 9, lib, "utf-8", 1), (2, "o/a", "src/shared.py", "file", 9, shared, "utf-8", 1), (3, "o/b", "lib/other.py", "file", 9, "# own\n" + patched, "utf-8", 1), (3, "o/b", "lib/other.py", "file", 9, "# own\n" + patched, "utf-8", 1),
        (4, "o/c", "src/own.py", "file", 9, body(3), "utf-8", 1), (5, "o/c", "src/own2.py", "file", 9, body(3), "utf-8", 1), (6, "o/c", "src", "dir", 0, None, None, 1), (7, "o/c", "dist/x.min.js", "file", None, None, None, 1), (8, None, None, "file", None, "", "utf-8", 1), (9, "o/d", "e.py", "file", 1, body(4)[:60], "utf-8", 1),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, path string, type string, size bigint, content string, encoding string, window int")
    libraries = spark.createDataFrame([("lib", lib), ("none", None)], "library string, content string")
    out = {r.file_id: r.verdict for r in P.not_hand_written(files, libraries).collect()}
    assert out == {1: "vendored", 7: "minified"}  # two repositories alone don't tell who copied
    third = spark.createDataFrame([(10, "o/e", "src/third.py", "file", 9, "# mine\n\n" + shared, "utf-8", 1)], files.schema)
    out = {r.file_id: r.verdict for r in P.not_hand_written(files.unionByName(third), libraries).collect()}
    assert out == {1: "vendored", 2: "vendored", 3: "vendored", 7: "minified", 10: "vendored"}
    assert P.not_hand_written(files.limit(0), libraries.limit(0)).count() == 0


def test_copying_has_a_direction(spark):
    text = body(6)
    rows = [
        (1, "o/velta", "src/velta.py", text), (2, "o/b", "node_modules/velta/velta.py", text), (3, "o/c", "src/renamed.py", "# tools\n" + text.replace("step_2_3", "step_9")), (4, "o/d", "src/own.py", body(7)),
        (5, "o/e", "a.py", "x = load_the_whole_table_of_names(path)\n"), (6, "o/f", "a.py", "x = load_the_whole_table_of_names(path)\n"), (7, "o/g", "a.py", "x = load_the_whole_table_of_names(path)\n"),
    ]
    files = spark.createDataFrame([(i, r, p, "file", 9, t, "utf-8") for i, r, p, t in rows], "file_id bigint, repo string, path string, type string, size bigint, content string, encoding string")
    libraries = spark.createDataFrame([("none", None)], "library string, content string")
    out = {r.file_id for r in P.not_hand_written(files, libraries).collect()}
    assert out == {2, 3}  # the original at home stays, and so do short files that only look alike
    short = spark.createDataFrame([("tiny", "x = load_the_whole_table_of_names(path)\n")], "library string, content string")
    assert {r.file_id for r in P.not_hand_written(files, short).collect()} == {2, 3, 5, 6, 7}


@pytest.mark.parametrize("line", [1, 9, 10, 11, 13, 200])
def test_banners_stand_anywhere(line):
    text = "\n".join(f"value_{i * 7} = compute(item_{i}, other_{i * i})" for i in range(line - 1)) + "\n# Code generated by mkcode. DO NOT EDIT.\n" + HAND
    assert P.composition("a.py", text) == "generated"


@pytest.mark.parametrize("lines", [3, 7, 8, 20])
def test_headings_are_read_to_their_end(lines):
    text = "".join("# some text ahead\n" for _ in range(lines)) + "# Released by Velta under MIT; upstream: https://velta.example/\n" + HAND
    assert P.composition("a.py", text) == "vendored"
