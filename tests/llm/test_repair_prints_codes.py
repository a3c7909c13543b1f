"""Turn repair, phrase fingerprints and vector codes against brute force, with odd rows and several layouts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from biflux.llm import phrase_fingerprint, turn_repair, vector_codes

# turn repair

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def every_repair(rows):
    """Least (cost, audit, lines) of all edit sequences with at most two insertions in a gap; rows: (role, text, must go, truncated)."""
    found = []

    def walk(k, state, cost, audit, lines, inserted):
        if k == len(rows) and state in ("", "a"):
            found.append((cost, audit, lines))
        for name in ("user", "assistant"):
            if inserted < 2 and (state, name[0]) in GRAMMAR:
                walk(k, name[0], cost + 3, audit + "I", [*lines, f"{name}:"], inserted + 1)
        if k == len(rows):
            return
        role, text, must_go, truncated = rows[k]
        walk(k + 1, state, cost + 4, audit + "D", lines, 0)
        if must_go:
            return
        if (state, role[:1]) in GRAMMAR:
            walk(k + 1, role[0], cost + 3 * truncated, audit + "K", [*lines, f"{role}:{text}"], 0)
        for name in ("user", "assistant"):
            if (state, name[0]) in GRAMMAR:
                walk(k + 1, name[0], cost + 3 + 3 * truncated, audit + "R", [*lines, f"{name}:{text}"], 0)

    walk(0, "", 0, "", [], 0)
    return min(found)


def wanted(turns):
    """Rows of one conversation (turn, role, text) by the contract, one by one."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in turns))
    seen, judged, counts = set(), [], Counter()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        blank, again, cut = not body, (role, text) in seen, body[-1:] not in (".", "!", "?")
        seen.add((role, text))
        counts["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
        judged.append((role, text, blank or again, cut))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
    known = [t for t, _, _ in turns if t is not None]
    cost, audit, lines = every_repair(judged)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_turns(seed, conversations=40):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", None, " \n", "ünd ", "Go! ", "x" * 40]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "uncle", ""]
    out = []
    for conv in [None, *range(conversations)]:
        for k in range(rng.randint(0, 6)):
            out.append((conv, None if rng.random() < 0.1 else k + rng.choice([0, 0, 0, 1, 3]), rng.choice(roles), rng.choice(texts)))
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, piece string, kind int, conv int, paths int"


def turn_table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 7, 8, 9) for r in rows], TURNS).repartition(parts)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_the_least_of_all(spark, seed):
    rows = some_turns(seed)
    rows += rows[:15]  # repeated rows
    by_conv: dict = {}
    for conv, *turn in rows:
        by_conv.setdefault(conv, []).append(tuple(turn))
    by_conv = {c: t[:9] for c, t in by_conv.items()}
    rows = [(c, *t) for c, turns in by_conv.items() for t in turns]
    made = {r.conv_id: tuple(r[c] for c in COUNTS) for r in turn_repair.digest(turn_table(spark, rows)).collect()}
    assert made == {c: wanted(t) for c, t in by_conv.items()}
    whole = {r.conv_id: "\n".join(f"{t.role}:{t.text}" for t in r.repaired) for r in turn_repair.repair(turn_table(spark, rows)).collect()}
    assert {c: hashlib.sha256(t.encode()).hexdigest() for c, t in whole.items()} == {c: t[-1] for c, t in made.items()}


def plain_least(items):
    best = {0: (0, "")}

    def insert():
        for q, role in ((0, "u"), (1, "u"), (3, "u"), (2, "a"), (3, "u")):
            if q in best:
                z, n = turn_repair.STEP[q, role], (best[q][0] + 3, best[q][1] + "I")
                best[z] = min(n, best.get(z, n))

    insert()
    for initial, must_go, truncated in items:
        after: dict = {}
        for q, (cost, audit) in best.items():
            ways = [(q, cost + 4, "D")]
            if not must_go:
                ways += [(turn_repair.STEP[q, initial], cost + 3 * truncated, "K")] if (q, initial) in turn_repair.STEP else []
                ways += [(turn_repair.STEP[q, i], cost + 3 + 3 * truncated, "R") for i in "ua" if (q, i) in turn_repair.STEP]
            for z, c, letter in ways:
                after[z] = min((c, audit + letter), after.get(z, (c, audit + letter)))
        best = after
        insert()
    return min(best[q] for q in (0, 3) if q in best)


def test_a_conversation_over_many_pieces(spark):
    """Pieces of one long conversation are solved apart; the answer is that of one pass."""
    rng = random.Random(5)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "user", "system", "x"]), rng.choice(["A.", f"b{k}", f"c{k}.", f"c{k}?", ""])) for k in range(4000)]
    rows += [(1, None, "user", "A.")] * 500 + [(2, 0, "user", "y" * 2_000_000 + "."), (2, 1, "assistant", "Good.")]
    for parts in (1, 5):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            made = {r.conv_id: r for r in turn_repair.digest(turn_table(spark, rows, parts)).collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        ordered = sorted(((t is not None, t or 0, r, x) for c, t, r, x in rows if c == 1))
        seen, items = set(), []
        for _, _, role, text in ordered:
            items.append((role[0], not text or (role, text) in seen, text[-1:] not in (".", "?")))
            seen.add((role, text))
        assert (made[1].cost, made[1].audit) == plain_least(items)
        assert (made[2].cost, made[2].audit, made[2].truncated) == (0, "KK", 0)


def test_runs_join_to_the_same_path():
    rng = random.Random(3)
    for _ in range(200):
        items = [(rng.choice("suatx "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(items))
        joined = turn_repair.follow(turn_repair.follow(turn_repair.identity(0), turn_repair.paths_of(items[:cut], range(4))), turn_repair.paths_of(items[cut:], range(4)))
        assert turn_repair.best_audit(joined) == plain_least(items) == turn_repair.best_audit(turn_repair.paths_of(items, (0,))[0])


def test_damage_and_conversations_without_rows(spark):
    rows = some_turns(9, 60)
    made = turn_repair.damage(turn_table(spark, rows)).collect()
    want = Counter()
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            want[conv, turn, "user" if fault == 4 else role, text] += 2 if fault == 3 else 1
    assert Counter(tuple(r) for r in made) == want
    names = turn_table(spark, [(5, 1, "user", "x"), (6, 1, "user", "x"), (None, 1, "user", "x")])
    none = turn_repair.digest(turn_table(spark, rows).limit(0), conversations=names).collect()
    assert {tuple(r) for r in none} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (5, 6, None)}
    assert turn_repair.repair(turn_table(spark, rows).limit(0)).count() == 0


# fingerprints

def plain_phrases(text):
    phrases, start, data = set(), 0, text.encode()
    for end in range(1, len(data) + 1):
        if data[start:end] not in phrases:
            phrases.add(data[start:end])
            start = end
    return phrases


def share(one, other):
    return 1.0 if not one | other else len(one & other) / len(one | other)


DOCS = "doc_id bigint, text string, fingerprint string, piece int, kind int, carried string, row int"


def doc_table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DOCS).repartition(parts)


def prints(docs, **more):
    return [r.asDict() for r in phrase_fingerprint.fingerprint(docs, **more).collect()]


def test_fingerprints_against_plain_phrases(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gämma", "delta", "€uro", "omega", "zeta", "to", "of"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    rows += [(60, ""), (61, None), (62, "a"), (63, "🙂" * 9), (64, rows[3][1]), (65, rows[3][1])]
    rng.shuffle(rows)
    for parts in (1, 7):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:  # with room for all hashes the likeness is exact
            made = {r["doc_id"]: r for r in prints(doc_table(spark, rows, parts), hashes=10_000, carry=("kind", "fingerprint"))}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        texts = {d: t or "" for d, t in rows}
        for d, text in texts.items():
            following = texts[(d + 1) % len(texts)]
            quarter = len(text) // 4
            edited = text[:len(text) - quarter] + following[:quarter]
            got = made[d]
            assert got["n_chars"] == len(text) and got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got["near_edited"] == pytest.approx(share(plain_phrases(text), plain_phrases(edited)))
            assert got["near_next"] == pytest.approx(share(plain_phrases(text), plain_phrases(following)))
            assert len(got["fingerprint"]) == 8 * len(plain_phrases(text)) and got["carried"].kind == 2
        assert made[64]["fingerprint"] == made[65]["fingerprint"] == made[3]["fingerprint"] and made[64]["near_next"] == 1.0


def test_fingerprints_estimate_and_odd_rows(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(400_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (None, "null id"), (None, None), (3, "twice"), (3, "twice"), (3, "third")]
    made = prints(doc_table(spark, rows))
    assert len(made) == len(rows) and Counter(r["doc_id"] for r in made) == Counter(d for d, _ in rows)
    first = next(r for r in made if r["doc_id"] == 1)
    assert abs(first["near_next"] - share(plain_phrases(long), plain_phrases(rows[1][1]))) < 0.2 and len(first["fingerprint"]) == 8 * phrase_fingerprint.HASHES
    twins = [r["fingerprint"] for r in made if r["doc_id"] == 3]
    assert Counter(Counter(twins).values()) == Counter([1, 2])
    alone = prints(doc_table(spark, [(9, "abcdefgh")]))
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert prints(doc_table(spark, [(9, "x")]).limit(0)) == []


def test_fingerprints_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = ({r["doc_id"]: r for r in prints(docs.repartition(n))} for n in (1, 16))
    assert one == other and len(one) == docs.count()


# vector codes

def lloyd(rows, parts, entries, rounds, scale=4096):
    """Every part against every entry, in whole numbers; rows: (id, whole vector) in order of id."""
    whole = np.floor(np.array([v for _, v in rows], np.float64) * scale).astype(np.int64)
    length = whole.shape[1] // parts
    books = [whole[:entries, p * length:(p + 1) * length].copy() for p in range(parts)]

    def nearest(p):
        distance = ((whole[:, None, p * length:(p + 1) * length] - books[p][None]) ** 2).sum(2)
        return distance.argmin(1), distance.min(1)

    for _ in range(rounds):
        for p in range(parts):
            chosen, _ = nearest(p)
            for e in set(chosen.tolist()):
                members = whole[chosen == e, p * length:(p + 1) * length]
                books[p][e] = members.sum(0) // len(members)
    found = [nearest(p) for p in range(parts)]
    codes = ["".join(f"{c[k]:02x}" for c, _ in found) for k in range(len(rows))]
    return codes, sum(d for _, d in found).tolist(), np.stack(books)


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int, whole int, places int"


def vector_table(spark, rows, parts=3):
    return spark.createDataFrame([(d, v, lab, "x", 1, 2, 3) for d, v, lab in rows], VECTORS).repartition(parts)


def test_codes_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    good = [(k, np.float32(centres[k % 6] + 0.05 * rng.normal(size=16) * (k % 3)).tolist(), k % 4 if k % 5 else None) for k in range(700)]
    good += [(700 + k, good[k][1], 1) for k in range(40)]  # repeated vectors: ties
    odd = [(-9, None, 1), (-8, [], 1), (-7, [float("nan")] * 16, 1), (-6, [float("inf")] + [0.0] * 15, 1), (-5, [None] + [0.0] * 15, 1), (900, [1.0] * 8, 1)]
    codes, errors, books = lloyd([(d, v) for d, v, _ in good], 4, 16, 6)
    totals = Counter()
    for (_, _, label), error in zip(good, errors):
        totals[label] += error
    for parts in (1, 6):
        coded, found = vector_codes.compress(vector_table(spark, good + odd, parts), parts=4, carry=("label", "code"))
        made = {r.vec_id: r for r in vector_codes.with_group_error(coded, F.col("carried.label")).collect()}
        assert (found == books).all() and len(made) == len(good)
        assert [made[d].code for d, _, _ in good] == codes and [made[d].error for d, _, _ in good] == errors
        assert all(made[d].group_error == totals[label] and made[d].carried.code == "x" for d, _, label in good)


def test_pruning_leaves_ties_to_the_first(spark):
    rng = np.random.default_rng(1)
    for size in (1, 15, 17, 300, 2000):
        for entries in (1, 2, 7, 16):
            points, book = rng.integers(-4, 4, (size, 3)), rng.integers(-4, 4, (entries, 3))
            points = points[vector_codes.tree_order(points)]
            codes = np.empty(size, np.int64)
            counts, sums, _ = vector_codes.assign(points, vector_codes.EntryTree(book), codes)
            assert (codes == ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all() and counts.sum() == size
            assert (sums.sum(0) == points.sum(0)).all()
    near = np.concatenate([rng.integers(0, 50, (3000, 4)), rng.integers(5000, 5050, (3000, 4))])
    near = near[vector_codes.tree_order(near)]
    assert vector_codes.assign(near, vector_codes.EntryTree(np.array([[20] * 4, [5020] * 4])))[2] == 0  # whole nodes only


def test_codes_of_few_and_no_rows(spark):
    few = [(None, [1.0, -1.0], 1), (3, [0.5, 0.25], None), (3, [0.5, 0.25], None), (2, [-0.0001, 0.0], 1)]
    coded, books = vector_codes.compress(vector_table(spark, few), parts=2)
    assert coded.count() == 4 and books.shape == (2, 4, 1) and books[0, 0, 0] == -1 and books[0, 3, 0] == 4096
    coded, books = vector_codes.compress(vector_table(spark, [(1, None, 1)]))
    assert coded.count() == 0 and books.size == 0
    total = vector_codes.with_group_error(coded, F.col("carried"))
    assert total.count() == 0
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.compress(vector_table(spark, [(1, [1.0] * 9, 1)]))


def test_group_errors_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "broadcast_if_small", lambda df: df)
    rows = spark.range(500).select(F.col("id").alias("vec_id"), F.lit("00").alias("code"), F.col("id").alias("error"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    made = {(r.g, r.group_error) for r in vector_codes.with_group_error(rows, F.col("g")).collect()}
    assert made == {(None if g == 0 else g, sum(k for k in range(500) if k % 3 == g)) for g in range(3)}
