"""Files that nobody wrote by hand: generated, minified, vendored, and data kept as code.

1. Every file's windows of three successive normalised lines are posted in an inverted index, with the repository, whether
   the file is marked as foreign (a package folder in its path or a third party's heading), and the package's name. An
   upstream library posts its windows too.
2. A window is rare if at most ``RARE`` of all repositories hold it. Evidence of copying is a window of an upstream library
   or of a marked file in another repository, however common, and a rare window that at least ``SPREAD`` repositories
   hold unmarked: a library that came to all of them from outside. Copying has a direction: the repository named like the
   package is its home, and two repositories alone don't tell who copied, so their files stay.
3. A file is a copy if evidence covers at least ``CONTAINED`` of its windows, common ones without evidence left aside: exact
   containment, patched, renamed or without its heading as the copy may be. A file of fewer than ``FEW`` windows is one only
   if upstream or marked evidence covers all.
4. Token composition judges the remaining files: banners of generators, line lengths, counters that rise line by line, the
   share of literal data; path and size where content is missing; marks of third parties.

Single lines recur between unrelated files of one language; windows practically don't. Nothing caps how popular a library
may be: a window costs one row for each repository and task.

Defined results: rows that are no files, and empty contents, are not reported; repeated rows count once; a NULL repository
is one of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.credentials import decoded
from corvane.session import cut, ship_package

#: Lines in a window, the least characters of a window, and the windows below which a file must be covered wholly.
WINDOW, WINDOW_CHARS, FEW = 3, 36, 3
#: The share of a file's windows found elsewhere from which it counts as a copy, the share of repositories up to which a
#: window is rare, and the repositories that tell a library from a single copy.
CONTAINED, RARE, SPREAD = 0.5, 0.5, 3
#: Bytes from which a file without loaded content can't be hand-written.
HUGE = 1_000_000

_GENERATED = re.compile(
    r"code generated|@generated|auto-?generated|automatically generated|machine-written|machine generated|generated by (?:the )?\S{1,80} (?:compiler|generator|tool)|\bgenerated (?:by|from) \S{1,80} ?v?\d|"
    r"do not (?:edit|modify)|changes will be lost|regenerate (?:with|by|using)|edit \S{1,80}\.tmpl instead|generated file|generated code"
    # the same said in other languages
    r"|maschinell erzeugt|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|editieren)|ne pas (?:modifier|éditer)|(?:généré|créé) automatiquement|fichier généré|no (?:modificar|editar)|generado (?:automáticamente|por)|não (?:modificar|editar)|gerado automaticamente"
    r"|non modificare|generato automaticamente|сгенерирован|не редактировать|不要(?:修改|编辑)|请勿(?:修改|编辑)|自动生成|自動生成|編集しない|자동 생성|수정하지",
    re.IGNORECASE,
)
_BY_HAND = re.compile(r"edit freely|by this module|written by hand|hand-written|not generated", re.IGNORECASE)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;|%|\"\"\"|''')")
_FOREIGN = re.compile(r"\bv?\d+\.\d+(?:\.\d+)*\W+\|.*licen[cs]e|released by .{1,80} under|upstream:|licen[cs]e of\b|vendored from|third-?party", re.IGNORECASE)
_PACKAGES = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third_party|third-party|thirdparty|_thirdparty|_vendored|_bundled|vendor|extern|externals|deps|Godeps|Pods)/")
_MADE_PATH = re.compile(r"(?:^|/)(?:generated|__generated__|generated-sources)/|\.min\.(?:js|css)$|\.bundle\.js$|(?:_pb2|_pb2_grpc)\.py$|\.pb\.(?:go|cc|h)$|\.g\.(?:ts|dart|cs)$|\.designer\.cs$", re.IGNORECASE)
_PACKED = re.compile(r"\.(?:js|mjs|cjs|jsx|ts|css|html?|svg)$", re.IGNORECASE)
_MASK = re.compile(r"[A-Za-z_$]+|\d+")
_NAME = re.compile(r"[\W_]+")
_NUMBERS = re.compile(r"\d+")
_DIGITS = re.compile(r"[\s\[\](){},;:.+\-0-9xXeEa-fA-FLuU]+")
_BLOB = re.compile(r"[bBrRuU]?[\"'][A-Za-z0-9+/=\\]{40,}[\"'][,;)]?")
_ROW = re.compile(r"(?:INSERT INTO \S+(?: \([^)]*\))? VALUES|\(\d+,.*\)[,;]$|[\"']?[\w.-]+[\"']?(?:[,;\t][^,;\t]*){4,}$)", re.IGNORECASE)


def composition(path: str, text: str) -> str | None:
    """The verdict a file's own path and tokens give: generated, minified, data, vendored, or None."""
    lines = [x for x in (line.strip() for line in text.replace("\ufeff", "").split("\n")) if x]
    if not lines:
        return None
    if any(_GENERATED.search(line) and not _BY_HAND.search(line) for line in lines if _COMMENT.match(line)):
        return "generated"
    chars = sum(map(len, lines))
    long = sum(len(x) for x in lines if len(x) > 200)
    if long > 0.5 * chars and chars > 300:
        if _PACKED.search(path):
            return "minified"
        if sum(map(str.isdigit, text)) > 0.12 * chars or ("PRIVATE KEY-----" not in text and re.search(r"[A-Za-z0-9+/=]{200,}", text)):
            return "data"
    data = 0
    for x in lines:
        if len(x) >= 16 and (_BLOB.fullmatch(x) or (_DIGITS.fullmatch(x) and sum(map(str.isdigit, x)) > 0.2 * len(x)) or _ROW.match(x)):
            data += len(x)
    if data > 0.6 * chars and data > 300:
        return "data"
    risen, last_mask, last = 0, "", []
    for x in lines:
        numbers = _NUMBERS.findall(x)
        mask = _MASK.sub("w", x) if numbers else ""
        if numbers and mask == last_mask and len(numbers) == len(last) and any(len(b) < 9 and int(b) == int(a) + 1 for a, b in zip(last, numbers, strict=True)):
            risen += 1
        last_mask, last = mask, numbers
    if risen >= 6 and risen >= 0.5 * len(lines):
        return "generated"
    return "vendored" if package(path, text) is not None else None


def heading(text: str) -> list[str]:
    """The comment lines ahead of a file's first statement, and those among its first eight lines."""
    lines = [x for x in (line.strip() for line in text.replace("\ufeff", "").split("\n")) if x]
    first = next((i for i, x in enumerate(lines) if not _COMMENT.match(x)), len(lines))
    return [x for x in lines[: max(first, 8)] if _COMMENT.match(x)]


def package(path: str, text: str) -> str | None:
    """The name, letters and digits only, of the package that a marked file belongs to; None for unmarked files."""
    m = _PACKAGES.search(path)
    if m:
        return _NAME.sub("", path[m.end() :].split("/")[0].split(".")[0].lower())
    if any(_FOREIGN.search(x) for x in heading(text)):
        return _NAME.sub("", path.rsplit("/", 1)[-1].split(".")[0].lower())
    return None


def unloaded(path: str, size: int | None) -> str | None:
    """The verdict on a file without content, from its path and size."""
    if _PACKAGES.search(path):
        return "vendored"
    if _MADE_PATH.search(path):
        return "minified" if ".min." in path or ".bundle." in path else "generated"
    return "data" if (size or 0) >= HUGE else None


def windows(text: str) -> list[int]:
    """Hashes (signed 64 bit) of the windows of successive lines, white space and short lines set aside; a text of fewer
    lines is one window."""
    lines = [x for x in (" ".join(line.split()) for line in text.replace("\ufeff", "").split("\n")) if len(x) > 2]
    out = set()
    for i in range(max(1, len(lines) - WINDOW + 1)):
        joined = "\n".join(lines[i : i + WINDOW])
        if len(joined) >= WINDOW_CHARS + WINDOW - 1:
            out.add(xxhash.xxh3_64_intdigest(joined) - (1 << 63))
    return list(out)


_POSTING = "window bigint, repo bigint, upstream boolean, package string"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, repo, upstream, package) of each file, a window of a repository once in each task."""
    seen: set = set()
    for batch in batches:
        out: list[tuple] = []
        for repo, upstream, name, posted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for window in posted:
                key = (window, repo, name)
                if key not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(key)
                    out.append((window, repo, upstream, name))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["window", "repo", "upstream", "package"])


def not_hand_written(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, verdict) of each file that is not hand-written.

    ``files`` has file_id, repo, path, type, size, content, encoding; ``libraries`` has library, content (upstream files).
    The index is counted by window with one shuffle; the join back has unique keys on one side, and its hot keys are split
    by adaptive skew handling.
    """
    spark = files.sparkSession
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, names, posted = [], [], []
            for path, size, content, encoding in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                text = decoded(content, encoding)
                full = bool(text.strip())
                verdicts.append(composition(path or "", text) if full else None if content is not None else unloaded(path or "", size))
                names.append(package(path or "", text) if full else None)
                posted.append(windows(text) if full else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(verdicts, pa.string()), pa.array(names, pa.string()), pa.array(posted, pa.list_(pa.int64()))], names=["file_id", "repo", "home", "verdict", "package", "posted"]
            )

    schema = "file_id bigint, repo bigint, home string, verdict string, package string, posted array<bigint>"
    home = F.lower(F.regexp_replace(F.element_at(F.split(F.coalesce("repo", F.lit("")), "/"), -1), r"[^A-Za-z0-9]+", ""))
    own = files.where(F.col("type") == "file").select(
        F.col("file_id").cast("bigint"), F.xxhash64("repo").alias("repo"), home.alias("home"), F.col("path").cast("string"), F.col("size").cast("bigint"), F.col("content").cast("string"), F.col("encoding").cast("string")
    )
    read_files = cut(own.mapInArrow(read, schema))
    upstream = libraries.select(F.lit(None).cast("bigint"), F.xxhash64(F.lit("upstream"), "library"), F.lit(""), F.lit("x"), F.lit(0).cast("bigint"), F.col("content").cast("string"), F.lit("utf-8")).mapInArrow(read, schema)
    posting = read_files.unionByName(upstream).select("repo", F.col("file_id").isNull().alias("upstream"), "package", "posted").mapInArrow(_post, _POSTING)
    foreign = F.when(F.col("package").isNotNull(), F.col("repo"))
    held = posting.repartition("window").groupBy("window", "repo").agg(F.max("upstream").alias("upstream"), F.min("package").alias("p"), F.max("package").alias("q"), F.min(foreign).alias("foreign"))
    index = (
        held.groupBy("window")
        .agg(F.count("*").alias("repos"), F.count_if(F.col("p").isNull() & ~F.col("upstream")).alias("plain"), F.max("upstream").alias("upstream"), F.min("p").alias("p"), F.max("q").alias("q"), F.min("foreign").alias("first"), F.max("foreign").alias("last"))
        .where((F.col("repos") > 1) | F.col("upstream"))
    )
    repos = read_files.select("repo").distinct().count()
    rows = read_files.where(F.size("posted") > 0).select("file_id", "repo", "home", F.size("posted").alias("n"), F.explode("posted").alias("window"))
    elsewhere = (F.col("first") != F.col("repo")) | (F.col("last") != F.col("repo"))
    at_home = F.col("home").contains(F.col("p")) | F.col("home").contains(F.col("q"))
    told = F.col("upstream") | (F.coalesce(elsewhere, F.lit(False)) & ~F.coalesce(at_home, F.lit(False)))
    rare = F.col("repos") <= max(SPREAD, RARE * repos)
    spread = rare & (F.col("plain") >= SPREAD) & (F.col("n") >= FEW)
    copies = (
        rows.join(index.select("window", "repos", "plain", "upstream", "p", "q", "first", "last"), "window")
        .groupBy("file_id", "n")
        .agg(F.count_if(told | spread).alias("found"), F.count_if(~told & ~rare).alias("common"))
        .withColumn("own", F.col("n") - F.col("common"))
        .where((F.col("found") > 0) & (F.col("found") >= F.when(F.col("own") < FEW, F.col("own")).otherwise(CONTAINED * F.col("own"))))
        .select("file_id", F.lit("vendored").alias("verdict"))
    )
    decided = read_files.where(F.col("verdict").isNotNull()).select("file_id", "verdict")
    return copies.withColumn("order", F.lit(0)).unionByName(decided.withColumn("order", F.lit(1))).groupBy("file_id").agg(F.min_by("verdict", F.struct("order", "verdict")).alias("verdict"))
