"""Conversation structure repair: the cheapest edits that make turns follow ``(system? (user assistant)+)?``.

Nodes of the graph are (rows read, state of the role grammar), edges are edits. A path's weight is one whole number: its
cost in the high digits, and below them one octal digit per edit, at the place that the edit has in the path. Places after
the last edit hold zero, so that of equal costs the smaller number is the ASCII-least audit. The least number per node
decides everything. At equal cost, no path to a node has an audit that begins with another one's (more edits without more
rows are insertions, and these cost), so least paths are made of least paths, and runs of rows can be solved apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from biflux.llm.common import BLANKS
from biflux.runtime import durable

# Fixed values of the contract: edits in ASCII order, costs, and the role grammar by initials.
LETTERS = "DIKR"
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}

RUN = 128
_DIGIT = {letter: k + 1 for k, letter in enumerate(LETTERS)}
_TO_OCTAL = str.maketrans(LETTERS, "1234")
_TO_LETTERS = str.maketrans("1234", LETTERS)

#: Best paths from one state to each state: (cost, audit as an octal number, length), or None.
Paths = list


def solve(items: list[tuple[str, bool, bool]], entry: int) -> Paths:
    """Least paths over rows (role initial, must go, truncated) from one state to every state, insertions around them included."""
    width = 3 * (3 * len(items) + 2)  # at most two insertions in a gap

    def edit(node, cost, letter):
        weight, place = node
        return weight + (cost << width) + (_DIGIT[letter] << (width - 3 * place - 3)), place + 1

    def inserted(best):
        found = [edit(best[q], INSERT, "I") for q in (START, SYSTEM, ASSISTANT) if best[q]]
        best[USER] = min([*found, best[USER]] if best[USER] else found, default=None)
        if best[USER]:
            found = edit(best[USER], INSERT, "I")
            best[ASSISTANT] = min(found, best[ASSISTANT]) if best[ASSISTANT] else found
        return best

    best: list = [None] * 4
    best[entry] = (0, 0)
    inserted(best)
    for initial, must_go, truncated in items:
        after: list = [None] * 4
        extra = TRUNCATED if truncated else 0
        for q, node in enumerate(best):
            if node is None:
                continue
            reached = [(q, edit(node, DELETE, "D"))]
            if not must_go:
                if (q, initial) in STEP:
                    reached.append((STEP[q, initial], edit(node, extra, "K")))
                reached += [(STEP[q, i], edit(node, RETYPE + extra, "R")) for i in "ua" if (q, i) in STEP]
            for state, found in reached:
                if after[state] is None or found < after[state]:
                    after[state] = found
        best = inserted(after)
    low = (1 << width) - 1
    return [node and (node[0] >> width, (node[0] & low) >> (width - 3 * node[1]), node[1]) for node in best]


def follow(first: Paths, runs: list[Paths]) -> Paths:
    """Least paths through one run and then the next; ``runs`` has the next run's paths per entry state."""
    out: Paths = []
    for state in range(4):
        found = [(a[0] + b[0], a[1] << (3 * b[2]) | b[1], a[2] + b[2]) for a, paths in zip(first, runs) if a and paths and (b := paths[state])]
        longest = max((length for _, _, length in found), default=0)
        out.append(min(found, key=lambda p: (p[0] << (3 * longest)) | (p[1] << (3 * (longest - p[2]))), default=None))
    return out


def identity(entry: int) -> Paths:
    return [(0, 0, 0) if q == entry else None for q in range(4)]


def _letters(path: tuple[int, int, int]) -> str:
    return f"{path[1]:o}".translate(_TO_LETTERS) if path[2] else ""


def best_audit(paths: Paths) -> tuple[int, str]:
    """Cost and audit of the least path that ends a conversation."""
    longest = max(p[2] for p in paths if p)
    cost, digits, length = min((p for p in (paths[START], paths[ASSISTANT]) if p), key=lambda p: (p[0] << (3 * longest)) | (p[1] << (3 * (longest - p[2]))))
    return cost, _letters((cost, digits, length))


def items_of(role: str, blank: bool, first: bool, truncated: bool, copies: int) -> Iterator[tuple[str, bool, bool]]:
    """The rows behind one row with a count: all but the first of equal rows are duplicates."""
    for k in range(copies):
        yield role[:1], blank or not first or k > 0, truncated


def replay(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns; reads rows and audit along."""
    state, letters = START, iter(audit)

    def named(letter: str, role: str) -> str:
        nonlocal state
        initial = role[:1] if letter == "K" else "a" if state == USER else "u"
        state = STEP[state, initial]
        return role if letter == "K" else NAMES[initial]

    for role, text in rows:
        for letter in letters:
            if letter == "I":
                yield named(letter, ""), ""
                continue
            if letter != "D":
                yield named(letter, role), text
            break
    for letter in letters:
        yield named(letter, ""), ""


def damage(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plants faults by crc32 of ``conversation:turn`` (nulls: one blank) modulo 20: 0 drops a row, 1 empties it, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user. Role and text come back without nulls."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    rows = turns.select(
        F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"), F.when(fault == 4, "user").otherwise(shown(role_col)).alias(role_col),
        text.alias(text_col), fault.alias("_fault")).where("_fault != 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


def faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row per different (conv, turn, role, text) with ``copies``, ``blank``, ``truncated`` and ``first``: whether no
    earlier turn has its role and text. Equal rows are counted before they are dealt out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    counted = rows.groupBy(F.struct("conv", "turn", "mark").alias("key")).agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    earliest = rows.groupBy("conv", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    earliest = earliest.select(F.struct("conv", F.col("least.turn").alias("turn"), "mark").alias("key"), F.lit(True).alias("first"))
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    return counted.join(earliest, "key", "left").select(
        F.col("key.conv").alias("conv"), F.col("key.turn").alias("turn"), "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"),
        (F.length(ends) == 0).alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


_PATHS = "array<struct<entry:int,state:int,cost:bigint,audit:string>>"


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            yield from zip(*(part.column(c).to_pylist() for c in names))


def _batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while made := list(islice(found, 500)):
        yield pa.RecordBatch.from_pylist(made, schema=schema)


def _first(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    ahead = next(batches, None)
    return ahead, chain([ahead] if ahead is not None else [], batches)


def paths_of(items: Iterable[tuple[str, bool, bool]], entries: Iterable[int]) -> list:
    """Least paths through all rows from each of the entry states, solved run by run."""
    paths = [identity(q) if q in entries else None for q in range(4)]
    items = iter(items)
    while run := list(islice(items, RUN)):
        solved = [solve(run, q) if any(p and p[q] for p in paths) else None for q in range(4)]
        paths = [p and follow(p, solved) for p in paths]
    return paths


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least paths of every conversation's rows in one sorted piece. Only the first one may go on from another piece."""
    ahead, batches = _first(batches)
    if ahead is None:
        return

    def found():
        entries: Iterable[int] = range(4)
        for (conv, piece), group in groupby(_rows(batches, ("conv", "piece", "role", "blank", "first", "truncated", "copies")), key=lambda r: r[:2]):
            paths = paths_of((item for row in group for item in items_of(*row[2:])), entries)
            yield {"conv": conv, "piece": piece, "paths": [
                {"entry": q, "state": s, "cost": p[0], "audit": _letters(p)} for q in entries for s, p in enumerate(paths[q]) if p]}
            entries = (START,)

    path = pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    yield from _batches(found(), pa.schema([("conv", ahead.schema.field("conv").type), ("piece", pa.int32()), ("paths", pa.list_(path))]))


class Tally:
    """Counts over a conversation's rows in order."""

    def __init__(self):
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, blank: bool, first: bool, truncated: bool, copies: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
            self.truncated += first and truncated
        initial = role[:1]
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        self.before = initial

    def counts(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


_NAMES = ("conv", "kind", "paths", "turn", "role", "text", "blank", "first", "truncated", "copies")


def mend(group: Iterator[tuple], whole: bool) -> dict:
    """One conversation: its paths per piece in order, then its rows in order (columns ``_NAMES``)."""
    paths, tally, rows = identity(START), Tally(), iter(())
    for row in group:
        if row[1] == 1:
            runs: list = [None] * 4
            for p in row[2]:
                runs[p["entry"]] = runs[p["entry"]] or [None] * 4
                runs[p["entry"]][p["state"]] = (p["cost"], int(p["audit"].translate(_TO_OCTAL) or "0", 8), len(p["audit"]))
            paths = follow(paths, runs)
        elif row[1] == 2:
            rows = chain([row], group)
            break
    cost, audit = best_audit(paths)

    def read():
        for _, _, _, turn, role, text, blank, first, truncated, copies in rows:
            tally.add(turn, role, blank, first, truncated, copies)
            for _ in range(copies):
                yield role, text

    turns, sha = [], hashlib.sha256()
    for k, (role, text) in enumerate(replay(audit, read())):
        if whole:
            turns.append({"role": role, "text": text})
        else:
            sha.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return {**tally.counts(), "cost": cost, "audit": audit, "repaired": turns if whole else sha.hexdigest()}


def repair(turns: DataFrame, *, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns).

    Rows are read by turn (nulls first), then role, then text. A row is blank without a visible character, else a
    duplicate if an earlier row has its role and text, else truncated if its last visible character ends no sentence.
    Keeping costs 0, changing the role to user or assistant 3, deleting 4 (blank and duplicate rows must go), inserting an
    empty user or assistant turn 3; a truncated row that stays costs 3 more. ``audit`` is the ASCII-least sequence of edits
    (D, I, K, R) of the least cost after which role initials read ``(s?(ua)+)?``. ``gaps`` are missing numbers between the
    least and the largest turn; ``illegal`` counts neighbours whose initials are not su, ua or au.

    A null role or text is one blank; an empty role has no initial and fits nowhere; rows with a null conversation are one
    conversation. ``conversations`` (column ``conv_col``) names conversations that may have lost all rows: they come back
    with zeros. Equal rows are counted first. An empty table gives no rows; other columns are ignored.

    Sorted pieces of the table are solved in parallel, also within one conversation; a conversation's pieces are then
    joined, and its rows streamed once in order, since its audit and its repaired text are one value each.
    """
    return _repaired(turns, conversations, conv_col, turn_col, role_col, text_col, True)


def digest(turns: DataFrame, *, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """As ``repair``, with the sha256 of the repaired ``role:text`` lines in place of the turns, made as they stream by."""
    return _repaired(turns, conversations, conv_col, turn_col, role_col, text_col, False)


def _repaired(turns: DataFrame, conversations: DataFrame | None, conv_col: str, turn_col: str, role_col: str, text_col: str, whole: bool) -> DataFrame:
    order = ["conv", "turn", "role", "text"]
    rows = faults(turns, conv_col, turn_col, role_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn("piece", F.spark_partition_id()))
    kind = rows.schema["conv"].dataType.simpleString()
    summaries = rows.mapInArrow(_summarise, f"conv {kind}, piece int, paths {_PATHS}")
    names = (turns if conversations is None else conversations).select(F.col(f"`{conv_col}`").alias("conv")).distinct()
    met = names.withColumn("kind", F.lit(0))
    for k, part in enumerate((summaries, rows), 1):
        met = met.unionByName(part.withColumn("kind", F.lit(k)), allowMissingColumns=True)
    met = met.repartition("conv").sortWithinPartitions("conv", "kind", "piece", "turn", "role", "text").select(*_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, batches = _first(batches)
        if ahead is None:
            return
        line = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])) if whole else pa.string()
        counts = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        found = ({conv_col: conv, **mend(group, whole)} for conv, group in groupby(_rows(batches, _NAMES), key=lambda r: r[0]))
        yield from _batches(found, pa.schema([(conv_col, ahead.schema.field("conv").type), *counts, ("audit", pa.string()), ("repaired", line)]))

    numbers = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    made = "array<struct<role:string,text:string>>" if whole else "string"
    return met.mapInArrow(run, f"`{conv_col}` {kind}, {numbers}, audit string, repaired {made}")
