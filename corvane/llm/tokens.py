"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.tokenizer import VOCABULARY, encoding
from corvane.session import ship_package

#: Characters of one call to the tokenizer, more where no token can end: its splitter keeps a stack that long texts exhaust.
STRETCH = 100_000
#: Places where a token must begin: a blank that stands alone between other characters.
_SEAM = re.compile(r"(?<=\S)[ ](?=\S)|(?<=\S)(?=\n\S)")
#: Runs that the splitter takes as one piece; a run of white space gives its last character to what follows.
_SPACES = re.compile(r"(?<!\s)[ \t\r\n]{10000,}(?!\s)")


def _stretches(text: str) -> Iterator[str]:
    """A text cut where a token must begin, so the counts of the parts add up to that of the whole."""
    at = 0
    while len(text) - at > STRETCH:
        m = _SEAM.search(text, at + STRETCH)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text, the same however long it is."""
    enc, total = encoding(path), 0
    for part in _stretches(text):
        at = 0
        for m in _SPACES.finditer(part):  # a run of white space is one piece, but for its last character ahead of others
            end = m.end() - (m.end() < len(part))
            total += len(enc.encode_ordinary(part[at : m.start()])) + len(enc._encode_single_piece(part[m.start() : end]))
            at = end
        total += len(enc.encode_ordinary(part[at:]))
    return total


def counted(documents: DataFrame, key: str, text: str, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(key, *keep, tokens bigint): sizes in tokens; NULL and empty texts have 0. A narrow map; texts don't leave it."""
    ship_package(documents.sparkSession)
    narrow = documents.select(key, *keep, F.col(text).cast("string").alias("__text"))
    at = len(narrow.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count(t, path) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:at], "tokens"])

    fields = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:at])
    return narrow.mapInArrow(run, f"{fields}, tokens bigint")
