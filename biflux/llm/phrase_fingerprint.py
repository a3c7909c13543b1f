"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: the shortest run of bytes that is not in the dictionary yet ends a phrase and
enters it. The phrases are hashed and the least hashes are the fingerprint; two fingerprints estimate how large a share
of their phrases two texts have in common, which is how much of one a compressor would find in the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from biflux.llm.common import carried, utf8
from biflux.runtime import durable

HASHES = 64
_MASK = (1 << 61) - 1
_FACTOR = 0x1B873593CC9E2D51 & _MASK
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parse(text: bytes, phrases: set[int], open_phrase: int = 0) -> int:
    """Adds the phrases of ``text`` as polynomial hashes of their bytes; returns the phrase that is still open."""
    for byte in text:
        open_phrase = (open_phrase * _FACTOR + byte + 1) & _MASK
        if open_phrase not in phrases:
            phrases.add(open_phrase)
            open_phrase = 0
    return open_phrase


def signature(phrases: set[int], hashes: int = HASHES) -> np.ndarray:
    """The least 32-bit hashes of the phrase set, ascending; all of them if there are fewer."""
    mixed = np.fromiter(phrases, np.uint64, len(phrases))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    mixed = np.unique(((mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(32)).astype(np.uint32))
    return mixed[:hashes]


def likeness(one: np.ndarray, other: np.ndarray, hashes: int = HASHES) -> float:
    """Share of common phrases among the least hashes of both; exact for small sets; two empty ones are equal."""
    both = np.sort(np.concatenate([one, other]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    least = np.unique(both)[:hashes]
    return int((both[1:][twice] <= least[-1]).sum()) / len(least)


class Parsed:
    """A text's fingerprint, and the parse of the part that the edit leaves, for the edited text to go on from."""

    def __init__(self, text: str, hashes: int = HASHES):
        self.text, self.hashes = text, hashes
        self.stays = len(text) - len(text) // 4
        phrases: set[int] = set()
        self.open_phrase = parse(text[:self.stays].encode(), phrases)
        self.phrases = set(phrases)
        parse(text[self.stays:].encode(), phrases, self.open_phrase)
        self.fingerprint = signature(phrases, hashes)

    def facts(self, following: Parsed) -> dict:
        """All that is known once the next text is there. Uses up the kept parse."""
        end = following.text[:len(self.text) - self.stays]
        parse(end.encode(), self.phrases, self.open_phrase)
        edited = signature(self.phrases, self.hashes)
        return {
            "n_chars": len(self.text), "edited_sha256": hashlib.sha256((self.text[:self.stays] + end).encode()).digest(),
            "fingerprint": _packed(self.fingerprint), "edited_fingerprint": _packed(edited),
            "near_edited": likeness(self.fingerprint, edited, self.hashes), "near_next": likeness(self.fingerprint, following.fingerprint, self.hashes)}


def _packed(found: np.ndarray) -> bytes:
    return found.astype(">u4").tobytes()


def _string(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


_FACTS = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
           ("near_edited", pa.float64()), ("near_next", pa.float64())]
DONE, FIRST, LAST = range(3)


def _in_pieces(hashes: int):
    """Rows of sorted pieces with the facts that their next row completes. A piece's first row is given once more with its
    text, and its last row only so: they meet across pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before, schema = TaskContext.get().partitionId(), None, None
        for batch in batches:
            schema = pa.schema([("carried", batch.schema.field("carried").type), ("piece", pa.int32()), ("kind", pa.int32()), ("text", pa.binary()), *_FIELDS])
            for k in range(0, batch.num_rows, 100):
                part, out = batch.slice(k, 100), []
                for keep, raw in zip(part.column("carried").to_pylist(), part.column("text").to_pylist()):
                    row = Parsed(_string(raw), hashes)
                    if before is None:
                        out.append({"carried": keep, "piece": piece, "kind": FIRST, "text": raw})
                    else:
                        out.append({"carried": before[0], "piece": piece, "kind": DONE, **before[1].facts(row)})
                    before = keep, row
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{"carried": before[0], "piece": piece, "kind": LAST, "text": before[1].text.encode()}], schema=schema)

    return run


def _at_edges(hashes: int):
    """Rows (carried, text, following) with their facts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("carried", batch.schema.field("carried").type), *_FIELDS])
            for k in range(batch.num_rows):
                keep, text, following = (batch.column(c)[k].as_py() for c in ("carried", "text", "following"))
                found = Parsed(_string(text), hashes).facts(Parsed(_string(following), hashes))
                yield pa.RecordBatch.from_pylist([{"carried": keep, **found}], schema=schema)

    return run


def fingerprint(docs: DataFrame, *, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, carried) of every row.

    The edited text has its last quarter (code points, rounded down) replaced by as many first ones of the next text, or
    all of that. Next is by ascending id, null ids first, rows of one id by a hash of their text; the first row comes after
    the last. Fingerprints are up to ``hashes`` 32-bit numbers as hex, ascending; equal texts have equal ones. The two
    likenesses are shares (0 to 1) of common phrases: with the edited text, and with the next row's text.

    A null text is empty, and empty texts are alike (1.0); repeated rows are rows of their own; a single row is its own
    next; an empty table gives no rows. The texts are dealt by ranges of ids once; an id of any number of rows spreads over
    several ranges. Across the ranges only one row of each travels.
    """
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("id"), carried(carry)).alias("carried"), utf8(F.col(f"`{text_col}`")).alias("text"))
    order = [F.col("carried.id"), F.xxhash64("text"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    kind = rows.schema["carried"].dataType
    met = durable(dealt.mapInArrow(_in_pieces(hashes), f"carried {kind.simpleString()}, piece int, kind int, text binary, {_FACTS}"))

    firsts, lasts = met.where(F.col("kind") == FIRST), met.where(F.col("kind") == LAST)
    by_piece, all_pieces = Window.orderBy("piece"), Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = firsts.select("piece", F.coalesce(F.lead("piece").over(by_piece), F.first("piece").over(all_pieces)).alias("next_piece"))
    edges = lasts.select("piece", "carried", "text").join(pieces, "piece").join(
        firsts.select(F.col("piece").alias("next_piece"), F.col("text").alias("following")), "next_piece").select("carried", "text", "following")
    facts = [f.split()[0] for f in _FACTS.split(", ")]
    found = met.where(F.col("kind") == DONE).select("carried", *facts).unionByName(
        edges.mapInArrow(_at_edges(hashes), f"carried {kind.simpleString()}, {_FACTS}"))
    shown = [F.lower(F.hex(c)).alias(c) if c.endswith(("sha256", "fingerprint")) else F.col(c) for c in facts]
    return found.select(F.col("carried.id").alias(id_col), *shown, F.col("carried.carried").alias("carried"))
