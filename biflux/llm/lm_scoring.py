"""Text scores under a log-bilinear neural language model trained by noise-contrastive estimation.

The model predicts the class of a token from the classes of the two before it: a frequent word is a class of its own, a
rarer word belongs to a class by its last two bytes. Within a class of rare words a word has its smoothed share of the
class, so token probabilities sum to one. Counts come from all training texts, and so does the model: every partition
trains on its own tokens in numpy and the parameters are averaged by tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from biflux.llm.common import utf8
from biflux.runtime import durable

#: The end of a text: a token of its own that no word equals, as words have no blanks.
END = b" "
ENDINGS = 64


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class Classes:
    """Class of a token: 0 to ``words`` - 1 for the frequent words, then one for each kind of ending."""

    def __init__(self, head: list[tuple[bytes, int]], words: int):
        self.words = words
        self.n = words + ENDINGS
        self.place = {w: k for k, (w, _) in enumerate(head)}
        self.kinds = np.array([k if k < words else words + ending(w) for k, (w, _) in enumerate(head)], np.int64)
        self.gains = np.log10(np.array([n for _, n in head], float) + 1)

    def places(self, found: list[bytes]) -> np.ndarray:
        """Place of each token among the counted words, -1 for others."""
        return np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))

    def at(self, places: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Classes of tokens whose places are known."""
        got = self.kinds[places] if len(self.kinds) else np.zeros(len(places), np.int64)
        for k in np.flatnonzero(places < 0).tolist():
            got[k] = self.words + ending(found[k])
        return got

    def __call__(self, found: list[bytes]) -> np.ndarray:
        return self.at(self.places(found), found)


def contexts(lengths: list[int], classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; ``start`` before a text begins."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    firsts = np.cumsum([0, *lengths[:-1]])
    one[firsts] = start
    two[firsts] = start
    seconds = firsts[np.array(lengths) > 1] + 1
    two[seconds] = start
    return one, two


class LogBilinear:
    """s(c | a, b) = q_c . (u * r_a + v * r_b) + bias_c with vectors r, q of ``size`` numbers."""

    def __init__(self, shares: np.ndarray, size: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shares = shares
        n = len(shares)
        self.r = rng.normal(0, 0.3, (n + 1, size))  # the last row stands before a text
        self.q = np.zeros((n, size))
        self.u, self.v = np.ones(size), np.full(size, 0.5)
        self.bias = np.log(shares)

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.u, self.v, self.bias])

    def assign(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("r", "q", "u", "v", "bias"):
            old = getattr(self, name)
            setattr(self, name, flat[at:at + old.size].reshape(old.shape))
            at += old.size

    def trainer(self, noise: int = 64, rate: float = 0.15, seed: int = 5):
        """A function that takes steps of noise-contrastive estimation on (class, one before, two before)."""
        rng = np.random.default_rng(seed)
        for name in ("r", "q", "u", "v", "bias"):
            setattr(self, name, getattr(self, name).astype(np.float32))
        log_noise = np.log(noise * self.shares).astype(np.float32)
        cumulative = np.cumsum(self.shares)
        squares = {k: np.full_like(getattr(self, k), 1e-3) for k in ("r", "q", "u", "v", "bias")}
        room = np.empty((0, noise), np.float32)  # the largest array of a step, kept from one to the next

        def descend(name: str, gradient: np.ndarray) -> None:
            gradient = gradient.astype(np.float32, copy=False)
            squares[name] += gradient * gradient
            getattr(self, name)[...] += rate * gradient / np.sqrt(squares[name])

        def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)

        def step(target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
            nonlocal room
            m, n = len(target), len(self.shares)
            if m > len(room):
                room = np.empty((m, noise), np.float32)
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise)), n - 1)  # shared by the batch
            ra, rb = self.r[one], self.r[two]
            predicted = self.u * ra + self.v * rb
            qt, qd = self.q[target], self.q[drawn]
            true = np.einsum("ij,ij->i", predicted, qt) + self.bias[target] - log_noise[target]
            pull = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - p(data)
            push = np.matmul(predicted, qd.T, out=room[:m])
            push += self.bias[drawn] - log_noise[drawn]
            np.clip(push, -30, 30, out=push)
            np.exp(np.negative(push, out=push), out=push)
            push += 1
            np.divide(-1, push, out=push)  # - p(data) of the noise
            back = pull[:, None] * qt + push @ qd
            gq = scatter(target, pull[:, None] * predicted, n) + scatter(drawn, push.T @ predicted, n)
            gb = np.bincount(target, pull, n) + np.bincount(drawn, push.sum(axis=0), n)
            gr = scatter(one, back * self.u, n + 1) + scatter(two, back * self.v, n + 1)
            gu, gv = (back * ra).sum(axis=0), (back * rb).sum(axis=0)
            for name, gradient in (("q", gq), ("bias", gb), ("r", gr), ("u", gu), ("v", gv)):
                descend(name, gradient / m)

        return step

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log scores by context one and two, and the normaliser of each pair of contexts, by matrix products."""
        one = (self.u * self.r) @ self.q.T + self.bias
        two = (self.v * self.r) @ self.q.T
        top1, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        z = np.log(np.maximum(np.exp(one - top1) @ np.exp(two - top2).T, 1e-300)) + top1 + top2.T
        return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)


def _count(rows: DataFrame) -> DataFrame:
    """(word, ending, n) over all training texts, added up in the workers first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            found = list(counter)
            return pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(map(ending, found), pa.int32()), pa.array(counter.values(), pa.int64())], names=["word", "ending", "n"])

        for batch in batches:
            for value in batch.column(0):
                counter.update(tokens(value.as_py()))
            if len(counter) > 400_000:
                yield out()
                counter.clear()
        if counter:
            yield out()

    return rows.select("text").mapInArrow(run, "word binary, ending int, n bigint").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _classes(sent: dict) -> Classes:
    """The classes of what was broadcast, made at the first use in a worker process."""
    if "classes" not in sent:
        sent["classes"] = Classes(sent["top"], sent["words"])
    return sent["classes"]


def _train(rows: DataFrame, shared, step_tokens: int = 4096) -> np.ndarray | None:
    """Parameters averaged over partitions, weighted by tokens; one pass over all training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes(shared.value)
        model = LogBilinear(shared.value["shares"])
        step, seen = model.trainer(), 0
        for batch in batches:
            lengths, line = [], []
            for value in batch.column(0):
                own = tokens(value.as_py())
                lengths.append(len(own))
                line += own
                if len(lengths) >= 512 or len(line) >= 400_000:
                    seen += walk(step, lengths, classes(line))
                    lengths, line = [], []
            if line:
                seen += walk(step, lengths, classes(line))
        if seen:
            flat = model.parameters()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen), pa.int64())], names=["at", "v", "n"])

    def walk(step, lengths: list[int], target: np.ndarray) -> int:
        one, two = contexts(lengths, target, len(shared.value["shares"]))
        order = np.random.default_rng(len(target)).permutation(len(target))
        for k in range(0, len(target), step_tokens):
            part = order[k:k + step_tokens]
            step(target[part], one[part], two[part])
        return len(target)

    summed = rows.select("text").mapInArrow(run, "at int, v double, n bigint").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    if not summed:
        return None
    flat = np.zeros(len(summed))
    for r in summed:
        flat[r["at"]] = r.v
    return flat


def score(docs: DataFrame, training: "F.Column", *, id_col: str = "doc_id", text_col: str = "text", words: int = 1024,
          head: int = 200_000) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text, learned from rows where ``training`` holds.

    ``score`` is the model's log10 probability of the tokens and the end, ``base_score`` the add-one unigram one. The
    ``words`` most frequent words are classes; the counts of up to ``head`` of the most frequent go to the workers (a bound of a
    few MB), all others are joined by word, spread over the cluster. A null text is empty (one token, the end); a null in
    ``training`` counts as no; repeated rows each have their result; other columns are ignored; without any training row
    all counts are zero and both scores are those of unknown words.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = durable(_count(rows.where("learn")))
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in sums), sum(r.v for r in sums)
    # the least count that at most ``head`` words reach: no task sends more than its share of them
    least, reached = 1, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        reached += r.words
        if reached > head:
            least = r.n + 1
            break
    top = sorted(((bytes(r.word), r.n) for r in counts.where(F.col("n") >= least).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))
    classes = Classes(top, min(words, max(0, len(top))))
    of_ending = np.zeros((ENDINGS, 2))
    for r in sums:
        of_ending[r.ending] += r.n, r.v
    for w, n in top[:classes.words]:
        of_ending[ending(w)] -= n, 1
    class_counts = np.array([n for _, n in top[:classes.words]] + list(of_ending[:, 0]), float)
    shares = (class_counts + 0.5) / (class_counts + 0.5).sum()
    # Plain data: a worker makes the classes itself, once, and needs no copy of this package.
    trainer = sc.broadcast({"top": top, "words": classes.words, "shares": shares})
    learned = _train(rows.where("learn"), trainer)
    shared = sc.broadcast({"top": top, "words": classes.words, "shares": shares, "learned": learned, "of_ending": of_ending})
    base_log = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, learned, of_ending = _classes(shared.value), shared.value["learned"], shared.value["of_ending"]
        model = LogBilinear(shared.value["shares"])
        if learned is not None:
            model.assign(learned)
        one_table, two_table, z = model.tables()
        within = np.log10(of_ending.sum(axis=1) + 1)  # of a class of rare words: log10 of (n + v + 1)
        ln10 = float(np.log(10))
        gains = np.append(classes.gains, 0.0)  # place -1, a word that is joined later, has none here
        for batch in batches:
            out = []
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [value.as_py() for value in part.column(1)]
                found = [tokens(text) for text in texts]
                lengths = list(map(len, found))
                line = [word for own in found for word in own]
                starts = np.cumsum([0, *lengths[:-1]])
                places = classes.places(line)
                kinds = classes.at(places, line)
                one, two = contexts(lengths, kinds, classes.n)
                gain, often = gains[places], kinds < classes.words
                logs = (one_table[one, kinds] + two_table[two, kinds] - z[one, two]).astype(float) / ln10
                logs += np.where(often, 0.0, gain - within[np.where(often, 0, kinds - classes.words)])
                base, logs = np.add.reduceat(gain, starts) - base_log * np.array(lengths), np.add.reduceat(logs, starts)
                known = np.add.reduceat((places >= 0).astype(np.int64), starts)
                tails: list[Counter[bytes]] = [Counter() for _ in texts]
                missed = np.flatnonzero(places < 0)
                for k, text in zip(missed.tolist(), (np.searchsorted(starts, missed, side="right") - 1).tolist()):
                    tails[text][line[k]] += 1
                out += zip(part.column(0).to_pylist(), lengths, known.tolist(), base.tolist(), logs.tolist(), map(zlib.crc32, texts),
                           ([{"word": w, "n": n} for w, n in tail.items()] for tail in tails))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"ids of type {kind} are not handled")
    types = [id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), tail_type]
    names = ["id", "n_tokens", "known", "base", "logs", "crc", "tail"]
    made = durable(rows.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens bigint, known bigint, base double, logs double, crc bigint, tail array<struct<word:binary,n:bigint>>"))
    # rows of one key are equal but for hash collisions of texts under one id, which n_tokens, base and logs tell apart
    key = F.xxhash64("id", "crc", "n_tokens", "base", "logs")
    made = made.withColumn("key", key)
    tails = made.select("key", F.explode("tail").alias("t")).groupBy("key", "t.word").agg(F.max("t.n").alias("n"))
    rare = tails.join(counts.select("word", F.col("n").alias("c")), "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("gain"))
    return made.drop("tail").join(rare, "key", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("logs") + F.coalesce("gain", F.lit(0.0))).alias("score"))
