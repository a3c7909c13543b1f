"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition before the score.

A suspicious stretch is a lattice: every character may stand for letters, be a repetition, a separator or a word end.
Viterbi takes the likeliest path under a trigram model of letters that is counted over all texts. The score weighs words
and word stems of the restored text by what labels say of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from biflux.llm.common import carried, utf8

#: Letters that a character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SEPARATORS = " .-_*~\t\n"
_EDGE = b".,;:?\"'()[]{}<>*#%&-_~=/\\`^"
_PLAIN = re.compile(rb"[a-z\x80-\xff']+\Z")
_LETTERS = re.compile(rb"[a-z]+\Z")
_DOUBLE = re.compile(rb"([a-z])\1+")
_SIGN = rb"[a-z0-9@$!|+]"
#: Pieces of up to three signs with separators between them.
_PIECE = rb"[\s.\-_*~]++" + _SIGN + rb"{1,3}+(?![a-z0-9@$!|+'\x80-\xff])"
_RUN = re.compile(rb"(?<![a-z0-9@$!|+'\x80-\xff])" + _SIGN + rb"{1,3}+(?:" + _PIECE + rb")++")
_SINGLES = re.compile(rb"(?:(?<![a-z0-9@$!|+])" + _SIGN + rb"[\s.\-_*~]+){3}")
_NOISE = re.compile(rb"[0-9@$!|+*]")
_LETTER = re.compile(rb"[a-z]")
_CODES = np.zeros(256, np.int64)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27
_STATES = 28


def count_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of letters over all texts (28 classes: word end, a to z, other scripts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_STATES ** 3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                codes = _CODES[np.frombuffer(b"  " + value.as_py() + b" ", np.uint8)]
                total += np.bincount((codes[:-2] * _STATES + codes[1:-1]) * _STATES + codes[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    counted = docs.select(utf8(F.col(text_col)).alias("text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(_STATES ** 3)
    for r in counted.collect():
        out[r.code] = r.n
    return out


class Channel:
    """Viterbi decoder of noisy stretches."""

    def __init__(self, trigrams: np.ndarray):
        counts = trigrams.reshape(_STATES, _STATES, _STATES) + 0.1
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.logs, self.rows = logs.tolist(), logs.reshape(-1, _STATES).tolist()
        self.signs: dict[str, tuple] = {}

    def sign(self, char: str) -> tuple:
        """What a character may be: letters with their classes, costs of a letter and a repetition, spacing, cost of a word end."""
        leet = char in LEET
        letters = LEET.get(char, char if "a" <= char <= "z" or ord(char) >= 128 else "")
        made = (
            tuple((letter, ord(letter) - 96 if "a" <= letter <= "z" else 27) for letter in letters),
            -0.1 if not leet else -0.7 if char != "*" else -2.5, -2.5 if leet else -1.0, char in SEPARATORS,
            (-2.0 if char in SEPARATORS else -9.0) if not letters or leet else 0.0)
        if ord(char) < 128:
            self.signs[char] = made
        return made

    def word(self, noisy: bytes) -> str:
        """``restore`` of a stretch of letters a to z: a run of a letter is emitted once or more often, two states at most."""
        logs, before, last = self.logs, 0, 0
        once, text = 0.0, ""  # the run's letter emitted once, after the class ``before``
        more, longer = None, ""  # emitted more often
        for code in noisy:
            c = code - 96
            if c == last:
                grown = once - 0.1 + logs[before][c][c]
                if more is not None:
                    kept, again = more - 1.0, more - 0.1 + logs[c][c][c]
                    if max(kept, again) >= grown:
                        grown, text_ = (again, longer + chr(code)) if again >= kept else (kept, longer)
                    else:
                        text_ = text + chr(code)
                else:
                    text_ = text + chr(code)
                once, more, longer = once - 1.0, grown, text_
                continue
            row = logs[last]
            score = once - 0.1 + logs[before][last][c]
            if more is not None and more - 0.1 + row[last][c] > score:
                score, text = more - 0.1 + row[last][c], longer
            once, text, more, before, last = score, text + chr(code), None, last, c
        if more is not None and more + logs[last][last][0] > once + logs[before][last][0]:
            return longer
        return text

    def restore(self, noisy: str) -> str:
        """The likeliest text of a lower-case stretch; a blank ends a word."""
        # a state is the last two classes as one number; a path is (log probability, chain of emitted characters)
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        logs = self.rows
        for char in noisy:
            letters, cost, repeated, spacing, end = self.signs.get(char) or self.sign(char)
            step: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, chain) in paths.items():
                row, b = logs[state], state % _STATES
                last = chain[1] if chain is not None else None
                for letter, c in letters:
                    after, to = score + cost + row[c], b * _STATES + c
                    if to not in step or step[to][0] < after:
                        step[to] = (after, (chain, letter))
                    if last == letter:
                        after = score + repeated
                        if state not in step or step[state][0] < after:
                            step[state] = (after, chain)
                if spacing and (state not in step or step[state][0] < score - 1.0):  # spacing inside a word
                    step[state] = (score - 1.0, chain)
                if end:
                    to, after, ended = (b * _STATES, score + end + row[0], (chain, " ")) if b else (state, score + end, chain)
                    if to not in step or step[to][0] < after:
                        step[to] = (after, ended)
            paths = step
        score, chain = max(((s + logs[state][0], c) for state, (s, c) in paths.items()), key=lambda p: p[0])
        out = []
        while chain is not None:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out))


def _once(word: bytes) -> bytes:
    """Every repeated letter once."""
    return _DOUBLE.sub(rb"\1", word)


class Restorer:
    """Words of restored texts and their features; what a token gives is remembered up to a bound."""

    def __init__(self, trigrams: np.ndarray, remembered: int = 200_000, weighted: dict[bytes, float] | None = None):
        """With ``weighted`` (the features that count), pieces of plain letters next to each other, of any size, are decoded
        where they add up to a word or stem of them but for repeated letters; other pieces of plain letters cannot."""
        self.channel, self.remembered = Channel(trigrams), remembered
        self.known: dict[bytes, tuple[bytes, ...]] = {}
        self.judged: dict[bytes, tuple[tuple[bytes, ...], bool]] = {}
        self.idle: set[bytes] = set()  # tokens without a weighted feature that begin none
        self.whole, self.stems = ({f[1:] for f in weighted or () if f[:1] == mark} for mark in (b"=", b"^"))
        self.weighted = weighted
        self.words = None if weighted is None else {_once(f[1:]) for f in weighted}
        self.cores: dict[bytes, bytes] = {}
        self.begins = {w[:k] for w in self.words or () for k in range(1, len(w))}

    def restored(self, noisy: bytes) -> set[bytes]:
        """Features of the words of a stretch, also with every repeated letter once."""
        found: set[bytes] = set()
        whole = self.channel.word(noisy) if _LETTERS.match(noisy) else self.channel.restore(noisy.decode("utf-8", "replace"))
        for word in whole.split():
            plain = word.encode()
            found.update(features(plain))
            if _DOUBLE.search(plain):
                found.update(features(_once(plain)))
        return found

    def token(self, token: bytes) -> tuple[bytes, ...]:
        core = token.strip(_EDGE)
        if _PLAIN.match(core) and not _DOUBLE.search(core):
            return features(core)  # letters without a repetition have one path
        found = set(features(core.strip(b"!$@|+")))
        if len(core) > 2 and (_LETTER.search(core) or _NOISE.search(core)):
            found |= self.restored(core)
        return tuple(found)

    def remember(self, key: bytes, make) -> tuple[bytes, ...]:
        own = self.known.get(key)
        if own is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            own = tuple(make(key))
            if self.weighted is not None:
                own = tuple(f for f in own if f in self.weighted)
            if len(key) <= 64:
                self.known[key] = own
        return own

    def weighed(self, token: bytes) -> tuple[tuple[bytes, ...], bool]:
        """Features with a weight, and whether the token may begin a word or stem that has one."""
        core = token.strip(_EDGE)
        if not _PLAIN.match(core) or (_DOUBLE.search(core) and not _LETTERS.match(core)):
            return tuple([f for f in self.token(token) if f in self.weighted]), _once(core) in self.begins
        forms, once = (core,), core
        if _DOUBLE.search(core):
            once = _once(core)
            forms = {core, self.channel.word(core).encode(), once} if len(core) > 2 else (core,)
        hits: tuple[bytes, ...] = ()
        for form in forms:
            if len(form) > 2 and (form in self.whole or form[:4] in self.stems or form[:5] in self.stems):
                hits += tuple([f for f in features(form) if f in self.weighted])
        return hits, once in self.begins

    def of_tokens(self, tokens: set[bytes]) -> tuple[set[bytes], set[bytes]]:
        """Features of tokens. With weights: those that have one, and the tokens that may begin a word or stem with one."""
        found: set[bytes] = set()
        first: set[bytes] = set()
        if self.weighted is None:
            for token in tokens:
                found.update(self.remember(token, self.token))
            return found, first
        idle, judged = self.idle, self.judged
        if len(idle) >= 2 * self.remembered:
            idle.clear()
        if len(judged) >= self.remembered:
            judged.clear()
        for token in tokens - idle:
            own = judged.get(token)
            if own is None:
                own = self.weighed(token)
                if len(token) <= 64:
                    if any(own):
                        judged[token] = own
                    else:
                        idle.add(token)
            found.update(own[0])
            if own[1]:
                first.add(token)
        return found, first

    def core(self, token: bytes) -> bytes:
        own = self.cores.get(token)
        if own is None:
            if len(self.cores) >= self.remembered:
                self.cores.clear()
            own = self.cores[token] = _once(token.strip(_EDGE))
        return own

    def joined(self, tokens: list[bytes], first: set[bytes]) -> Iterator[bytes]:
        """Stretches of tokens that add up to a word or stem with a weight and begin with one of ``first``."""
        words, begins, known = self.words, self.begins, self.cores
        for i in [i for i, token in enumerate(tokens) if token in first]:
            whole = self.core(tokens[i])
            for k in range(i + 1, len(tokens)):
                core = known.get(tokens[k])
                if core is None:
                    core = self.core(tokens[k])
                if not core:
                    continue
                # a letter at the joint counts once
                whole += core[1:] if whole[-1] == core[0] and core[:1].isalpha() else core
                if whole in words:
                    yield b" ".join(t.strip(_EDGE) for t in tokens[i:k + 1])
                if whole not in begins:
                    break

    def features(self, text: bytes) -> set[bytes]:
        lower = text.lower()
        tokens = lower.split()
        found, first = self.of_tokens(set(tokens))
        for run in _RUN.findall(lower):
            if self.words is None or _SINGLES.search(run) or (_NOISE.search(run) and _LETTER.search(run)):
                found.update(self.remember(b" ".join(run.split()), self.restored))
        if first:
            for stretch in self.joined(tokens, first):
                found.update(self.remember(stretch, self.restored))
        return found


def features(word: bytes) -> tuple[bytes, ...]:
    """The word and, where it is longer, its first four and five letters."""
    n = len(word)
    if n < 3:
        return ()
    if n > 5:
        return b"=" + word, b"^" + word[:4], b"^" + word[:5]
    return (b"=" + word, b"^" + word[:4]) if n == 5 else (b"=" + word,)


def raw_score(found: set[bytes], weights: dict[bytes, float]) -> float:
    """Sum of the three highest weights: one strong word is enough, more words add."""
    return sum(sorted((weights[f] for f in found if f in weights), reverse=True)[:3])


def _over(docs: DataFrame, trigrams: np.ndarray, each, finish, schema: str, only=None, lexis=None) -> DataFrame:
    """Arrow pass over (id, text): ``each(id, features)`` gives a row or None, ``finish()`` rows at the end."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, state = Restorer(trigrams, weighted=lexis.value if lexis else None), {}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if only is None or key in only.value:
                    made = each(state, key, restorer.features(text.as_py()))
                    if made is not None:
                        rows.append(made)
            for part in (rows, finish(state, False)):
                if part:
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*part))}, schema=kinds)
        part = finish(state, True)
        if part:
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*part))}, schema=kinds)

    of = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = pa.schema([(name, of[part.split()[1]]) for name, part in zip(names, schema.split(", "))])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = 20_000, lexicon: int = 20_000, least_texts: int = 5, smooth: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, carried): the higher, the likelier label 1; every row of ``docs`` has one, 0 to 1. ``carried`` is a
    struct of the columns that ``carry`` names.

    All given labels may be learned (hold rows out before the call); weights and calibration come from at most ``sample``
    labelled ids, taken by a hash of the id, and keep the ``lexicon`` best features. Of repeated labels of an id the
    highest counts; null labels and ids are none. Null texts are empty; a text without a weighted feature has the lowest
    score; repeated rows score alike; other columns are ignored. Without labels of both kinds every score is 0. The letter
    model is counted over all texts. Narrow but for sums over features: no text is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"), carried(carry))
    kind, more = (rows.schema[c].dataType.simpleString() for c in ("id", "carried"))
    none = rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), "carried")
    rows, whole = rows.drop("carried"), rows
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample).collect())
    told = {r.id: r.label for r in known}
    if len(set(told.values())) < 2:
        return none
    trigrams = count_letters(docs, text_col)
    shared = sc.broadcast(told)

    def count(state: dict, key, found: set[bytes]) -> None:
        counter = state.setdefault(shared.value[key], Counter())
        counter.update(found)
        counter[b""] += 1

    def counted(state: dict, last: bool) -> list[tuple]:
        if not last and sum(map(len, state.values())) < 300_000:
            return []
        both = {f for c in state.values() for f in c}
        out = [(f, state.get(1, {}).get(f, 0), state.get(0, {}).get(f, 0)) for f in both]
        state.clear()
        return out

    sums = (
        _over(rows, trigrams, count, counted, "feature binary, toxic bigint, clean bigint", shared)
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= least_texts) | (F.length("feature") == 0)))
    odds = F.col("toxic") / (F.col("clean") + smooth)
    best = sums.orderBy(F.length("feature") > 0, odds.desc(), "feature").limit(lexicon + 1).collect()
    totals = next(((r.toxic, r.clean) for r in best if not r.feature), (0, 0))
    if not all(totals):
        return none
    weights = {}
    for r in best:
        if r.feature:
            weight = math.log((r.toxic + smooth) / (totals[0] + 2 * smooth)) - math.log((r.clean + smooth) / (totals[1] + 2 * smooth))
            weight -= 1.64 * math.sqrt(1 / (r.toxic + smooth) + 1 / (r.clean + smooth))  # what little support allows
            if weight > 0.3:
                weights[bytes(r.feature)] = weight
    lexis = sc.broadcast(weights)

    def point(state: dict, key, found: set[bytes]) -> tuple:
        return shared.value[key], raw_score(found, lexis.value)

    def nothing(state: dict, last: bool) -> list[tuple]:
        return []

    points = (
        _over(rows, trigrams, point, nothing, "label int, raw double", shared, lexis)
        .groupBy("label", F.round("raw", 1).alias("raw")).agg(F.count("*").alias("n")).collect())
    slope, base = _logistic(points)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigrams, weighted=lexis.value)
        for batch in batches:
            raw = np.array([raw_score(restorer.features(text.as_py()), lexis.value) for text in batch.column(1)], float)
            scores = 1 / (1 + np.exp(-np.clip(base + slope * raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], names=["id", "score", "carried"])

    return whole.mapInArrow(judged, f"id {kind}, score double, carried {more}").withColumnRenamed("id", id_col)


def _logistic(points: list, penalty: float = 1.0) -> tuple[float, float]:
    """Slope and base of a logistic curve through counted (label, raw), by Newton steps."""
    x = np.array([[r.raw, 1.0] for r in points])
    y, n = np.array([r.label for r in points], float), np.array([r.n for r in points], float)
    beta, hold = np.zeros(2), np.diag([penalty, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - hold @ beta
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(2)
        move = np.linalg.solve(curvature, gradient)
        beta += np.clip(move, -2, 2)
    return max(0.0, float(beta[0])), float(beta[1])
