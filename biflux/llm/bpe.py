"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position, the root the leftmost pair of least rank. A merge clears
or renews the leaves of the two live neighbours and of the swallowed position, each in logarithmic time. Pieces of like
length share one tree array, a row each, so that numpy does one merge of every piece at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from biflux.llm.common import utf8

_NONE = np.iinfo(np.int64).max


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Rank file: base64 of the token and its rank in every line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """Encodes pieces by ranks; a piece that is a token as a whole is that token."""

    def __init__(self, ranks: dict[bytes, int], cached_pieces: int = 200_000, cached_bytes: int = 64):
        self.ranks, self.cached_pieces, self.cached_bytes = ranks, cached_pieces, cached_bytes
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.span = max(ranks.values()) + 1
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.span + right, rank))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [_NONE], dtype=np.int64)
        self.cache: dict[bytes, bytes] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of 2 to ``width`` bytes; width is a power of two."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.single[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        after[after >= lengths[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        ranks = self._pair_rank(ids[:, :-1], ids[:, 1:])
        ranks[(ids[:, :-1] < 0) | (ids[:, 1:] < 0)] = _NONE
        # a node is rank * width + position: least rank first, leftmost among equals
        tree[:, width:2 * width - 1] = np.where(ranks == _NONE, _NONE, ranks * width + np.arange(width - 1))
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_at(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            following = after[rows, at]
            rank = np.where(following < width, self._pair_rank(ids[rows, at], ids[rows, np.minimum(following, width - 1)]), _NONE)
            return np.where(rank == _NONE, _NONE, rank * width + at)

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best % width
            gone = after[rows, at]
            ids[rows, at] = best // width
            following = after[rows, gone]
            after[rows, at] = following
            linked = following < width
            before[rows[linked], following[linked]] = at[linked]
            ids[rows, gone] = -1
            update(rows, gone, np.full(len(rows), _NONE))
            update(rows, at, pair_at(rows, at))
            previous = before[rows, at]
            has = previous >= 0
            if has.any():
                update(rows[has], previous[has], pair_at(rows[has], previous[has]))
            rows = rows[tree[rows, 1] != _NONE]
        live = ids >= 0
        flat = ids[live].astype("<u4")
        return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in set(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif piece in self.cache:
                out[piece] = self.cache[piece]
            else:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)  # rows at once: bounds the trees to some tens of MB
            for k in range(0, len(group), step):
                part = group[k:k + step]
                for piece, ids in zip(part, self._merge(part, width)):
                    out[piece] = ids.tobytes()
                    if len(piece) <= self.cached_bytes:
                        if len(self.cache) >= self.cached_pieces:
                            self.cache.clear()
                        self.cache[piece] = out[piece]
        return list(map(out.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(merger: Merger, pattern, texts: list[str], piece_budget: int = 2_000_000) -> Iterator[bytes]:
    """Ids of each text. Texts share one call of the merger up to some bytes; a text beyond that has its own."""
    group: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[bytes]:
        encoded = merger.encode_pieces([piece for pieces in group for piece in pieces])
        at = 0
        for pieces in group:
            yield b"".join(encoded[at:at + len(pieces)])
            at += len(pieces)

    for text in texts:
        group.append([piece.encode() for piece in pattern.findall(text)])
        size += len(text)
        if size >= piece_budget:
            yield from flush()
            group, size = [], 0
    yield from flush()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, decoded as bytes.

    Every match of ``pattern`` is encoded by itself, without special tokens. Narrow: no shuffle, one Arrow batch in
    memory. A null or empty text has no ids; null ids and repeated rows pass through; an empty table gives no rows; other
    columns are ignored. The vocabulary (a file of fixed size) is the only thing that is broadcast.
    """
    return _mapped(docs, ranks, pattern, id_col, text_col, digest=False)


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with sha256 of ids and of decoded bytes in place of them, so that they need not leave the worker."""
    return _mapped(docs, ranks, pattern, id_col, text_col, digest=True)


def _mapped(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, compiled = Merger(shared.value), regex.compile(pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                counts, ids, decoded = [], [], []
                for found in encode_texts(merger, compiled, [t.as_py().decode("utf-8", "replace") for t in part.column(1)]):
                    back = merger.decode(found)
                    counts.append(len(found) // 4)
                    ids.append(hashlib.sha256(found).hexdigest() if digest else found)
                    decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)],
                    names=[id_col, "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col), utf8(F.col(text_col)).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    out = "string" if digest else "binary"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids {out}, decoded {out}")
