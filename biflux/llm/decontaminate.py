"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Text is normalised to lower-case words with single blanks, scanned once, and hits are mapped back to words and to byte
offsets of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from biflux.llm.common import carried, utf8

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: A-Z to a-z; bytes outside words to blanks. Every byte of a character beyond ASCII belongs to a word.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(text: bytes, length: int) -> list[bytes]:
    """The windows of an item; an item of fewer words, but not none, is one window."""
    found = words(text)
    if not found:
        return []
    return [b" ".join(found[k:k + length]) for k in range(max(1, len(found) - length + 1))]


class Scanner:
    """The automaton over windows, each with the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], length: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows(text, length):
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, names in owners.items():
            # bytes as characters: one automaton for all scripts; blanks around keep to whole words
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, sorted(names)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit runs of words as (first, end), items."""
        found = words(text)
        if self.empty or not found:
            return len(found), [], []
        line = f" {b' '.join(found).decode('latin-1')} "
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        word, seen = 0, 0
        for end, (count, names) in self.automaton.iter(line):
            word += line.count(" ", seen, end)  # words that ended before the closing blank
            seen = end
            items.update(names)
            runs.append((word - count, word))
        runs.sort()
        joined: list[tuple[int, int]] = []
        for first, last in runs:
            if joined and first <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], last))
            else:
                joined.append((first, last))
        return len(found), joined, sorted(items)


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit runs of words as byte offsets of the original."""
    if not runs:
        return []
    starts, ends = {a for a, _ in runs}, {b - 1 for _, b in runs}
    first, last = [], []
    for k, match in enumerate(_WORD.finditer(text)):
        if k in starts:
            first.append(match.start())
        if k in ends:
            last.append(match.end())
    return list(zip(first, last))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", length: int = 10, most_bytes: int = 64_000_000,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_hit, items, spans, carried) of every document; spans are (start, end) bytes of the original and
    ``carried`` a struct of the columns that ``carry`` names.

    A word inside any occurrence of an item's window is hit. The benchmark goes to every worker, so its text is limited
    to ``most_bytes`` (checked; an error beyond it). Null texts have no words, null item ids count as the item ``null``,
    repeated items as one; null document ids and repeated rows pass through; empty tables give no hits or no rows; other
    columns are ignored. Narrow: no shuffle.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), utf8(F.col(item_text_col)).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item")), F.lit(0)).alias("n")).first().n
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {most_bytes}")
    shared = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, length)
        for batch in batches:
            n_words, n_hit, found, spans = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                count, runs, names = scanner.scan(text)
                n_words.append(count)
                n_hit.append(sum(b - a for a, b in runs))
                found.append(names)
                spans.append([{"start": a, "end": b} for a, b in byte_spans(text, runs)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column(2)],
                names=["id", "n_words", "n_hit", "items", "spans", "carried"])

    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"), carried(carry))
    kind, more = (rows.schema[c].dataType.simpleString() for c in ("id", "carried"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, carried {more}").withColumnRenamed("id", id_col)
