"""Oversized documents cut into overlapping pieces at natural boundaries, and stored pieces held against that contract.

Cutting places balanced targets: the least number of pieces that the limit allows gives equal lengths, and every target is
snapped to the strongest boundary near it. Where a limit fails (what is left doesn't fit the pieces left, or a cut would
fall inside a word that a blank nearby spares) a piece is added or the cut moved, from that place on, so the work is linear
in the text. ``Judge`` is the contract that both sides answer to: it holds a new piece and a stored one to the same limits,
overlap and boundaries.

Offsets count code points, ends are exclusive. Defined results: NULL or blank content gives no pieces; content within the
limit gives one piece; a stored piece without parent, offsets or content has the fault ``offset``; a redelivered row
(same key, same content) counts once; a piece is judged by its own strategy, and one without limits (or with a NULL limit)
never for size or overlap; a piece with a NULL chunk_index comes last; pieces without document_id have no neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package, small_rows

#: Boundaries from the strongest to the weakest; a cut falls behind group 0.
_BOUNDARIES = {
    "text": tuple(re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n(?=#{1,6}\s|```|[-*+]\s|\d+[.)]\s)", r"\n", r"[.!?…][\"'”»)\]]*\s+|[。！？।][”」』）]*", r"[,;:،，；：、]\s*", r"\s+")),
    "code": tuple(re.compile(p) for p in (r"\n\s*\n(?=\S)", r"\n(?=(?:async |export |public |static )*(?:def|class|function|func|const|let|interface|type|struct|@|#|//))", r"\n\s*\n", r"\n", r"[;,{}]\s*", r"\s+")),
}
#: Share of a piece's length within which a target may move to a stronger boundary.
REACH = 0.25
FAULTS = ("oversize", "offset", "gap", "overlap", "midword")


def broken_word(text: str, start: int, end: int) -> bool:
    """Whether a piece ends between letters or digits although its second half has white space to end at."""
    if not 0 < end < len(text) or not (text[end - 1].isalnum() and text[end].isalnum()):
        return False
    return any(c.isspace() for c in text[start + (end - start) // 2 : end])


def overlap_out(shared: int, overlap: int) -> bool:
    return 2 * shared < overlap or shared > overlap


def _snap(text: str, target: int, low: int, high: int, kind: str) -> int:
    """The place in [low, high] behind the strongest boundary, the nearest to the target among equals; else the target."""
    for pattern in _BOUNDARIES[kind]:
        best = -1
        for m in pattern.finditer(text, max(0, low - 200), min(len(text), high + 1)):
            at = m.end()
            if low <= at <= high and (best < 0 or abs(at - target) < abs(best - target)):
                best = at
        if best >= 0:
            return best
    return max(low, min(high, target))


def split_points(text: str, max_chars: int, overlap: int, kind: str = "text") -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: all within the limit, each sharing the overlap with the one before."""
    n = len(text)
    if not text.strip():
        return []
    if n <= max_chars:
        return [(0, n)]
    overlap = max(0, min(overlap, max_chars // 2))
    stride = max_chars - overlap
    pieces: list[tuple[int, int]] = []
    start = previous = 0
    left = 1
    while True:
        left = max(left, -(-(n - start - overlap) // stride))  # a piece more where the rest wouldn't fit
        if left == 1:
            pieces.append((start, n))
            return pieces
        length = (n - start + (left - 1) * overlap) / left
        target, reach, least, most = start + round(length), round(REACH * length), max(previous, start + overlap) + 1, min(n, start + max_chars)
        end = _snap(text, target, max(least, target - reach), min(most, target + reach), kind)
        if broken_word(text, start, end):
            end = _at_blank(text, target, max(least, start + (end - start) // 2), most, end)
        pieces.append((start, end))
        if end >= n:
            return pieces
        earliest, latest = end - overlap, end - -(-overlap // 2)
        start, previous, left = (_snap(text, earliest, earliest, latest, kind) if latest > earliest else earliest), end, max(1, left - 1)


def _at_blank(text: str, target: int, low: int, high: int, otherwise: int) -> int:
    """The place in [low, high] behind a white space character that is nearest to the target."""
    best = otherwise
    for m in re.compile(r"\s").finditer(text, low - 1, high):
        if low <= m.end() <= high and (best == otherwise or abs(m.end() - target) < abs(best - target)):
            best = m.end()
    return best


class Judge:
    """The faults of one document's pieces, given in order; holds the text and what is known of the piece before."""

    def __init__(self, text: str | None) -> None:
        self.text, self.before, self.count, self.open = text, None, 0, None

    def piece(self, content: str | None, start: int | None, end: int | None, max_chars: int | None, overlap: int | None) -> list[str]:
        text, before, faults = self.text, self.before, []
        self.count += 1
        if max_chars is not None and content is not None and len(content) > max_chars:
            faults.append("oversize")
        if text is None or content is None or start is None or end is None or start < 0 or end < start or end > len(text) or end - start != len(content) or not text.startswith(content, start):
            self.before, self.open = -1, None  # its offsets are wrong
            return [*faults, "offset"]
        lost = self.count == 1 and bool(text[:start].strip())
        if before is not None and before >= 0:
            if start > before and text[before:start].strip():
                lost = True
            elif overlap is not None and overlap_out(before - start, overlap):
                faults.append("overlap")
        if lost:
            faults.append("gap")
        if broken_word(text, start, end):
            faults.append("midword")
        self.before, self.open = end, None if lost else end
        return faults

    def end(self) -> bool:
        """Whether text lies behind the last piece, which then has the fault ``gap`` (if it hasn't yet)."""
        return self.open is not None and bool(self.text[self.open :].strip())


def piece_faults(text: str | None, pieces: list[tuple], max_chars: int | None, overlap: int | None) -> Iterator[tuple[str, str]]:
    """(piece id, fault) over the pieces of one document in order; a piece is (id, content, start, end)."""
    judge = Judge(text)
    for key, content, start, end in pieces:
        for fault in judge.piece(content, start, end, max_chars, overlap):
            yield key, fault
    if pieces and judge.end():
        yield pieces[-1][0], "gap"


def contracts(limits: DataFrame) -> dict[str, tuple[int | None, int | None]]:
    """(max_chars, overlap_chars) by strategy."""
    return {r["strategy"]: (r["max_chars"], r["overlap_chars"]) for r in small_rows(limits.select("strategy", "max_chars", "overlap_chars"), "chunk_limits")}


def routed(source: F.Column, metadata: F.Column) -> F.Column:
    """The strategy of a document that has no pieces yet, from its extension, else from the language in its metadata."""
    ext = F.lower(F.regexp_extract(source, r"\.([^./]*)$", 1))
    code = ("py", "pyw", "js", "jsx", "ts", "tsx", "mjs")
    prose = ("md", "markdown", "rst", "txt")
    lang = F.lower(metadata["language"])
    return (
        F.when(ext.isin(*code) | ((F.coalesce(ext, F.lit("")) == "") & lang.isin("python", "javascript", "typescript")), "ast")
        .when(ext.isin(*prose) | ((F.coalesce(ext, F.lit("")) == "") & lang.isin("markdown", "text")), "semantic")
        .otherwise("fixed")
    )


_SCHEMA = "document_id string, kind string, strategy string, piece_no int, id string, fault string, start_char int, end_char int"


def _once(at: int):
    """Rows whose key (column ``at``) the task hasn't given yet, so a redelivered row costs one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(batch.column(at).to_pylist()):
                if key is None or key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    keep.append(i)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return run


def recut(documents: DataFrame, chunks: DataFrame, limits: DataFrame, new_pieces: bool = True) -> DataFrame:
    """The faults of stored pieces, and new pieces for every document whose stored pieces break the contract or are missing.

    Rows: (document_id, kind, strategy, piece_no, id, fault, start_char, end_char), kind ``fault`` or ``piece``; without
    ``new_pieces`` only faults. Documents and pieces, redelivered rows dropped in each task, meet by one shuffle on the
    document and stream through a sorted merge: a task holds one text and the end of the piece before. Pieces without
    document_id are judged where they lie. ``limits`` has one row for each of the few strategies.
    """
    spark = documents.sparkSession
    ship_package(spark)
    contract = contracts(limits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        current, text, strategy, judge, seen, last, faulty = None, None, None, None, None, None, False

        def give(*row) -> None:  # noqa: ANN002
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush() -> None:
            if current is None:
                return
            if judge is not None and judge.end():
                give(current, "fault", last[1], None, last[0], "gap", None, None)
            stored = strategy
            max_chars, overlap = contract.get(stored, (None, None))
            if new_pieces and (faulty or judge is None or judge.end()) and text is not None and max_chars is not None:
                for i, (a, b) in enumerate(split_points(text, max_chars, overlap or 0, "code" if stored == "ast" else "text")):
                    give(current, "piece", stored, i, None, None, a, b)

        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = ["document_id", "kind", "strategy", "piece_no", "id", "fault", "start_char", "end_char"]

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc, rank, _, key, content, start, end, kind in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if doc != current:
                    flush()
                    current, text, strategy, judge, seen, last, faulty = doc, None, None, None, None, None, False
                if rank == 0:
                    if text is None:
                        text, strategy = content, kind
                elif key is None or key != seen:
                    if judge is None:
                        judge, strategy = Judge(text), kind or strategy
                    for fault in judge.piece(content, start, end, *contract.get(kind, (None, None))):
                        give(doc, "fault", kind, None, key, fault, None, None)
                        faulty = True
                    seen, last = key, (key, kind)
            if out[0]:
                yield drain()
        flush()
        if out[0]:
            yield drain()

    whole = documents.select(
        F.col("id").cast("string").alias("document_id"), F.lit(0).alias("rank"), F.lit(0).alias("chunk_index"), F.lit("").alias("key"), F.col("content"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), routed(F.col("source"), F.col("metadata")).alias("strategy")
    )
    parts = chunks.select("document_id", F.lit(1).alias("rank"), F.col("chunk_index").cast("int"), F.col("id").cast("string").alias("key"), "content", F.col("start_char").cast("int"), F.col("end_char").cast("int"), "strategy")
    own = parts.where(F.col("document_id").isNotNull())
    kept = whole.where(F.col("document_id").isNotNull()).mapInArrow(_once(0), whole.schema).unionByName(own.mapInArrow(_once(3), parts.schema))
    rows = kept.repartition("document_id").sortWithinPartitions("document_id", "rank", F.asc_nulls_last("chunk_index"), "key")
    most = F.coalesce(*[F.when(F.col("strategy") == k, F.lit(m)) for k, (m, _) in contract.items() if k is not None and m is not None], F.lit(None).cast("int"))
    faults = F.when(F.length("content") > most, F.array(F.lit("oversize"), F.lit("offset"))).otherwise(F.array(F.lit("offset")))
    none = lambda kind: F.lit(None).cast(kind)
    lost = parts.where(F.col("document_id").isNull()).select("strategy", F.col("key").alias("id"), F.explode(faults).alias("fault")).distinct()
    orphans = lost.select(none("string").alias("document_id"), F.lit("fault").alias("kind"), "strategy", none("int").alias("piece_no"), "id", "fault", none("int").alias("start_char"), none("int").alias("end_char"))
    return rows.mapInArrow(merge, _SCHEMA).unionByName(orphans)


def split_documents(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(document_id, strategy, piece_no, total_pieces, start_char, end_char, content) of every document's pieces.

    ``documents`` has id, content, strategy. A narrow map without shuffle; keys are taken as unique.
    """
    ship_package(documents.sparkSession)
    contract = contracts(limits)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["document_id", "strategy", "piece_no", "total_pieces", "start_char", "end_char", "content"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for key, content, strategy in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                max_chars, overlap = contract.get(strategy, (None, None))
                if max_chars is not None and content:
                    found = split_points(content, max_chars, overlap or 0, "code" if strategy == "ast" else "text")
                    rows += [(key, strategy, i, len(found), a, b, content[a:b]) for i, (a, b) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    narrow = documents.select(F.col("id").cast("string"), F.col("content").cast("string"), F.col("strategy").cast("string"))
    return narrow.mapInArrow(split, "document_id string, strategy string, piece_no int, total_pieces int, start_char int, end_char int, content string")
