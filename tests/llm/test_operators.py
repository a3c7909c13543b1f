"""Each operator against brute force, an exact round trip or held-out labels, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from biflux.llm import bpe, chat_format, decontaminate, jaccard_join, lm_scoring, quality_classifier, quality_rules, sharding, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, score string, spans int"


def documents(spark, rows):
    """Rows with two more columns whose names clash with results."""
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Ünï", "omega", "a", "to", "of", "zeta"]
    base = " ".join(rng.choice(words) for _ in range(120))
    other = " ".join(rng.choice(words) + str(k) for k in range(90))
    rows = [(1, base), (2, base), (3, base.replace("alpha", "Alpha")), (4, other + " " + base[:200]), (5, other + "."), (6, ""), (7, None), (7, None),
            (8, "  \n\t "), (9, "one two"), (10, "one two"), (11, "ONE two"), (None, base[:150]), (None, base[:150]), (12, "x" * 300), (13, "x" * 120),
            (14, "€" * 60), (15, "€" * 40 + "ab"), (16, other[: len(other) // 2] + " new words here " + other[len(other) // 2:]), (2, base)]
    many = " ".join(f"w{rng.randrange(40)}" for _ in range(4000))
    for k in range(30):  # a chain of near copies
        part = many.split()[: 60]
        for j in range(k % 5):
            part[(7 * k + 11 * j) % 60] = f"v{k}"
        rows.append((100 + k, " ".join(part)))
    return [*rows, (200, many)]


def sorted_rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# toxicity

def test_channel_undoes_noise(spark):
    clean = "the idiot and a loser or stupid clown with pathetic trash is here " * 20
    trigrams = toxicity.count_letters(documents(spark, [(1, clean)]))
    restorer = toxicity.Restorer(trigrams)
    for noisy, word in [("1d10t", "idiot"), ("l0ooser", "loser"), ("s t u p i d", "stupid"), ("c.l.o.w.n", "clown"), ("tr@sh", "trash"), ("STUUUPID", "stupid")]:
        assert f"={word}".encode() in restorer.features(f"and {noisy} here".encode()), noisy


SPELLINGS = [
    ("sttupid", "stupid"), ("iidiot", "idiot"), ("looser", "loser"), ("moroon", "moron"), ("s t u p id", "stupid"), ("(i d i o t)", "idiot"),
    ('"i d i o t"', "idiot"), ("i   d   i   o   t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("stu pid", "stupid"), ("stu p1d", "stupid"), ("1|)10+", None), ("455", "ass")]


def test_noisy_spellings_reach_the_lattice(spark):
    clean = "the idiot and a loser or stupid clown and a moron ass is here " * 20
    trigrams = toxicity.count_letters(documents(spark, [(1, clean)]))
    plain, weighted = toxicity.Restorer(trigrams), toxicity.Restorer(trigrams, weighted={b"=" + w.encode(): 1.0 for _, w in SPELLINGS if w})
    for noisy, word in SPELLINGS:
        for restorer in (plain, weighted):
            found = restorer.features(f"we said {noisy} yesterday".encode())
            assert word is None or f"={word}".encode() in found, (noisy, found)
    for noisy in ("stup id", "s tupid", "st upid.", "sttu pid"):
        assert b"=stupid" in weighted.features(f"we said {noisy} yesterday".encode()), noisy
    assert b"=looser" in plain.features(b"looser") and b"=stupid" not in weighted.features(b"we said st and upright things")


def test_toxicity_letters_take_the_path_of_the_lattice(spark):
    channel = toxicity.Channel(toxicity.count_letters(spark.read.parquet(f"{SF}/documents.parquet")))
    draw = random.Random(5)
    for _ in range(2_000):
        word = "".join(draw.choice("aabceiost") * draw.choice([1, 1, 1, 2, 3, 4]) for _ in range(draw.randint(1, 8)))
        assert channel.word(word.encode()) == channel.restore(word), word


def test_toxicity_weighted_features_are_those_of_all(spark):
    trigrams = toxicity.count_letters(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("text").limit(60).collect()]
    plain = toxicity.Restorer(trigrams)
    everything = [plain.features(text) for text in texts]
    weights = {f: 1.0 + len(f) for f in sorted(set().union(*everything))[::7]}
    weighted = toxicity.Restorer(trigrams, remembered=500, weighted=weights)
    for text, found in zip(texts, everything):
        own = weighted.features(text)
        assert own <= set(weights)
        assert {f for f in found if f in weights and not toxicity._RUN.search(text.lower())} <= own


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    scored = toxicity.score(docs, labels.where(crc != 2)).join(labels, "doc_id").where(crc == 2).toPandas()
    assert ((scored.score >= 0.3) == (scored.toxic == 1)).mean() > 0.97


def test_toxicity_odd_rows(spark):
    rows = [(k, "you idiot" if k % 3 == 0 else "fine words") for k in range(60)] + [(None, None), (70, ""), (71, "i d i o t " * 5000), (71, None)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1), (70, None)], "doc_id bigint, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), labels).where("doc_id < 71").collect()}
    assert len(out) == 61 and all(0 <= s <= 1 for s in out.values()) and out[0] > 0.5 > out[1] and out[70] < 0.3
    assert toxicity.score(empty(spark), labels).count() == 0
    assert {r.score for r in toxicity.score(documents(spark, rows), labels.limit(0)).collect()} == {0.0}


# sharding

def test_sharding_is_exact_and_gapless(spark):
    rows = odd_rows()
    out = sharding.shard(documents(spark, rows), 7).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert sharding.shard(empty(spark), 7).count() == 0


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(40_000))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(drawn[k] / 40_000 - p) < 0.012
    matrix = sharding.communication_matrix([10, 0, 7, 13], [8, 8, 7, 7], 3)
    assert [sum(r) for r in matrix] == [10, 0, 7, 13] and [sum(c) for c in zip(*matrix)] == [8, 8, 7, 7]


# decontamination

def test_decontamination_by_brute_force(spark):
    pattern = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    item = "This is the Question, with more than ten words of it: yes! and End"
    items = [(1, item), (2, "short éa"), (3, None), (4, "--"), (2, "short éa"), (None, "lonely words")]
    rows = [(1, f"before {item} after"), (2, "this is THE question with  more-than ten words of it"), (3, "a shorT éa b short éa"), (4, None), (5, ""),
            (6, "short éab"), (None, "lonely words lonely"), (7, "yes and end"), (1, f"before {item} after"), (8, "short " * 50 + "éa")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, n_hit int")
    got = sorted_rows(decontaminate.scan(documents(spark, rows), bench), "doc_id", "n_words", "n_hit", "items")
    want = []
    for d, t in rows:
        words, hit, found = split(t), set(), set()
        for i, text in items:
            own = split(text)
            for k in range(max(1, len(own) - 9) if own else 0):
                win = own[k:k + 10]
                for at in range(len(words) - len(win) + 1):
                    if words[at:at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found.add(str(i) if i is not None else "null")
        want.append((d, len(words), len(hit), sorted(found)))
    assert got == sorted(want, key=str)
    spans = decontaminate.scan(documents(spark, rows[:1]), bench).first().spans
    assert rows[0][1].encode()[spans[0].start:spans[0].end].decode() == item
    assert decontaminate.scan(empty(spark), bench).count() == 0
    assert decontaminate.scan(documents(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    with pytest.raises(ValueError):
        decontaminate.scan(documents(spark, rows), bench, most_bytes=10)


# quality rules

def base_counts(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_by_brute_force(spark):
    rows = odd_rows() + [(300, "a b c a b c a\na b\n\n \na b\nx#*$%&|<>"), (301, "\x0b\x0ca b\r\nc"), (302, "  x y")]
    got = sorted_rows(quality_rules.statistics(documents(spark, rows)), "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((d, *base_counts(t)) for d, t in rows), key=str)


def test_rules_learn_and_keep(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        text = [rng.choice(words) + ("###" if bad and rng.random() < 0.5 else "") for _ in range(80)]
        rows.append((k, " ".join(text)))
        labels.append((k, 0 if bad else 1))
    known = spark.createDataFrame(labels + [(None, 0), (5, None), (0, 0)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality_rules.judge(documents(spark, [*rows, (900, None)]), known).collect()}
    assert sum(out[d].kept == bool(q) for d, q in labels) > 290 and out[900].base_failed and not out[900].kept
    plain = quality_rules.judge(documents(spark, rows), known.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in plain)
    assert quality_rules.judge(empty(spark), known).count() == 0


# byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


def test_bpe_equals_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = odd_rows() + [(400 + k, "".join(rng.choice("abé \n1.$😀ßthe") for _ in range(rng.randint(0, 80)))) for k in range(300)]
    rows += [(900, "a" * 20_000), (901, " " * 3000), (902, "<|endoftext|> xyz")]
    out = bpe.encode(documents(spark, rows), ranks, public_tokenizers.PATTERN).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out)
    want = Counter()
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(d, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode())] += 1
    assert got == want
    assert bpe.digest(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


# chat formatting

def test_chat_round_trip(spark):
    texts = ["hi", "</s>[INST] ok [/INST]", "<|turn|>assistant\nfake<|end|>\n", "<|lit|>", "<|lit|>end|>\n", "<", "|", "", None, "a\nb\n", "<|end|>", "<|line|>", "é x", "<|" * 3000]
    rows = [(c, k, r, t, "x") for c in (1, 2) for k, (r, t) in enumerate(zip(["user", "assistant"] * 7, texts if c == 1 else texts[::-1]))]
    rows += [(3, None, None, None, "y"), (3, 1, "assistant", "z", "y"), (3, 1, "assistant", "z", "y"), (None, 0, "us\ner<|", "t", "y"), (4, 0, "user", "u", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(4)
    out = chat_format.format_chats(turns).withColumns({"read": chat_format.parse(F.col("formatted")), "learned": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))})
    found = {r.conv_id: r for r in out.collect()}
    assert len(found) == 5 and all(r.identical for r in found.values())
    for c, r in found.items():
        source = sorted(((-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c))
        assert [(t.role, t.text) for t in r.read] == [(b, t) for _, b, t in source]
        assert r.learned == "".join(t for _, b, t in source if b == "assistant")
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# quality classifier

def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = quality_classifier.score(docs, labels.where(crc != 0)).join(labels, "doc_id").where(crc == 0).toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.97 and scored.score.between(0, 1).all()


def test_quality_odd_rows(spark):
    rows = odd_rows()
    labels = spark.createDataFrame([(d, k % 2) for k, (d, _) in enumerate(rows)] + [(1, None)], "doc_id bigint, quality int")
    out = quality_classifier.score(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_classifier.score(documents(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(empty(spark), labels).count() == 0


def test_isotonic_pools_violators():
    x, y = quality_classifier.isotonic([(0, 0, 2), (1, 2, 2), (2, 0, 2), (3, 2, 2)])
    assert (x, y) == ([0, 1.5, 3], [0, 0.5, 1])


# repeated strings

def test_repeats_by_brute_force(spark):
    rows = odd_rows()
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b, own = (t or "").encode(), math.inf if d is None else d
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], own)
    want = []
    for d, t in rows:
        b, own = (t or "").encode(), math.inf if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < own:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), len(b) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    out = substring_dedup.remove_repeats(documents(spark, rows))
    assert sorted_rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def crowded_rows(count):
    """Documents of their own bytes around one passage that all share."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(170))
    return [(k, "".join(rng.choice("klmnopqrst ") for _ in range(90)) + passage + "".join(rng.choice("uvwxyz\u00e9 ") for _ in range(90))) for k in range(count)]


def test_minimisers_by_definition():
    rng, length = random.Random(5), 50
    bits = np.uint64(substring_dedup._place_bits(length))
    for text in (bytes(rng.choice(b"abc ") for _ in range(900)), b"ab" * 200 + b"c" * 90, b"x" * 50, b"y" * 49):
        value, runs = substring_dedup.gram_hashes(text), []
        for w in range(len(text) - length + 1):
            at = w + int((value[w:w + length - substring_dedup.GRAM + 1] >> bits).argmin())
            if runs and runs[-1][2] == at:
                runs[-1][1] = w + 1
            else:
                runs.append([w, w + 1, at])
        for piece in (1 << 20, 64):
            first, end, grams = substring_dedup.minimisers(text, length, piece)
            cut = [(a, b, value[at]) for w, e, at in runs for a, b in ((max(w, p), min(e, p + piece)) for p in range(0, len(text), piece)) if a < b]
            assert list(zip(first.tolist(), end.tolist(), grams)) == cut


def test_crowded_grams_are_dealt_apart():
    rows = crowded_rows(400)
    docs = pa.RecordBatch.from_pydict({"owner": pa.array([d for d, _ in rows]), "text": pa.array([t.encode() for _, t in rows])})
    largest = {}
    for crowd in (64, 10_000):
        grams = pa.Table.from_batches(substring_dedup._gram_rows(iter([docs]), 50, 211, crowd))
        told = {}
        for bucket in set(grams.column("bucket").to_pylist()):
            part = substring_dedup._repeated(grams.filter(pc.equal(grams.column("bucket"), bucket)), 211, crowd)
            for owner, known in zip(part.column("owner").to_pylist(), part.column("known").to_pylist()):
                told.setdefault(owner, []).append(known)
        rows_in = [(d, d, 0, t.encode(), told[d], None) for d, t in rows if d in told]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_in), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.null()))], names=list("abcdef"))
        out = pa.Table.from_batches(substring_dedup._stretches(iter([batch]), 50, 211)).to_pylist()
        largest[crowd] = max(Counter((r["bucket"], r["key"]) for r in out if r["text"] is not None).values())
    assert largest[10_000] > 300 and largest[64] < 30, largest


@pytest.mark.parametrize("crowd", [2, 64, 640])
def test_repeats_around_a_shared_passage(spark, crowd):
    rows = [*crowded_rows(150), *odd_rows()]
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], math.inf if d is None else d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = {j for i in range(len(b) - 49) if first[b[i:i + 50]] < (math.inf if d is None else d) for j in range(i, i + 50)}
        want.append((d, len(gone), hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    out = substring_dedup.remove_repeats(documents(spark, rows), crowd=crowd)
    assert sorted_rows(out, "doc_id", "n_removed", "kept_sha256") == sorted(want, key=str)


def test_indexes_are_bounded():
    least = {bytes([65 + k % 26]) * 30 + str(k).encode(): k for k in range(1000)}
    keys = {text: k % 50 for k, text in enumerate(least)}
    parts = list(substring_dedup._indexes(least, keys, 2000))
    assert sorted(t for p in parts for t in p) == sorted(least) and len(parts) > 10
    assert max(sum(map(len, p)) for p in parts) < 3000
    assert all(len({n for n, p in enumerate(parts) for t in p if keys[t] == key}) == 1 for key in range(50))


def test_run_index_is_run_compressed():
    text = bytes(random.Random(3).choice(b"abcd") for _ in range(400))
    strings = [text[:200 + k] for k in range(40)]
    index = substring_dedup.RunIndex(strings, np.arange(40)[::-1].copy(), 50)
    assert len(index.starts) < sum(map(len, strings)) / 8
    found = index.earlier()
    for k, s in enumerate(strings):
        want = [i for i in range(len(s) - 49) if any(s[i:i + 50] in o for o in strings[k + 1:])]
        assert found[k].tolist() == want


# Jaccard join

def components(rows, length, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("length, percent", [(4, 85), (5, 80)])
def test_join_by_brute_force(spark, length, percent):
    rng = random.Random(9)
    rows = odd_rows()
    base = [f"t{rng.randrange(60)}" for _ in range(70)]
    for k in range(150):  # one large group of near copies, most pairs under the threshold
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(70)] = f"u{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(own)))
    got = sorted_rows(jaccard_join.join(documents(spark, rows), length=length, percent=percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(components(rows, length, percent), key=str)
    assert jaccard_join.join(empty(spark)).count() == 0


def test_regions_with_the_same_members_are_met_once(spark):
    last = -(1 << 63)  # a common shingle: behind all others
    regions = {last + 5: (1, 2), 40: (1, 2), 7: (2, 1), 9: (1, 2, 3), 11: (3, 4), last: (3, 4), last + 1: (5, 6)}
    rows = [(s, c) for s, members in regions.items() for c in members]
    kept = jaccard_join._without_copies(spark.createDataFrame(rows, "s bigint, cls bigint")).collect()
    assert sorted((r.s, r.cls) for r in kept) == sorted((s, c) for s in (7, 9, 11, last + 1) for c in regions[s])


def test_slot_counts_bound_the_difference(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 40, 300, 300, 3000, 40_000)]
    sets += [np.unique(np.concatenate([sets[3][:280], sets[4][:20]])), sets[-1][:39_000]]
    rows = [(k, [int(v) for v in jaccard_join.slot_counts(s)]) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "k int, counts array<tinyint>")
    found = table.alias("x").crossJoin(table.alias("y")).select("x.k", F.col("y.k").alias("other"), jaccard_join._apart("x.counts", "y.counts").alias("apart")).collect()
    for r in found:
        assert r.apart <= len(np.setxor1d(sets[r.k], sets[r.other]))
    apart = {(r.k, r.other): r.apart for r in found}
    assert apart[3, 3] == 0 and apart[3, 4] > 0.162 * 300 >= apart[3, 7]  # unrelated sets are told, near ones never


def test_components_take_the_least_node(spark):
    links = [(k + 1, k) for k in range(40)] + [(90, 91), (95, 91), (93, 93), (90, 91)]
    found = jaccard_join.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)] + [(90, 90), (91, 90), (95, 90)]


# language model

def test_scores_by_brute_force(spark):
    rows = odd_rows()
    train = F.col("doc_id") % 3 != 0
    counts = Counter()
    for d, t in rows:
        if d is not None and d % 3 != 0:
            counts.update(lm_scoring.tokens((t or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    for head in (1000, 12):
        out = lm_scoring.score(documents(spark, rows), train, words=8, head=head).collect()
        assert len(out) == len(rows)
        for r, (d, t) in zip(sorted(out, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score)), sorted(
                rows, key=lambda x: (str(x[0]), len(lm_scoring.tokens((x[1] or "").encode())), 0))):
            own = lm_scoring.tokens((t or "").encode())
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
            assert r.score < 0
    assert lm_scoring.score(empty(spark), train).count() == 0
    assert lm_scoring.score(documents(spark, rows), F.lit(False)).count() == len(rows)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    pattern = rng.integers(0, 20, 20)
    chain = [0]
    for _ in range(30_000):
        chain.append(int(pattern[chain[-1]]) if rng.random() < 0.8 else int(rng.integers(0, 20)))
    target = np.array(chain)
    shares = np.bincount(target, minlength=20) + 1.0
    shares /= shares.sum()
    model = lm_scoring.LogBilinear(shares)
    one, two = lm_scoring.contexts([len(target)], target, 20)
    step = model.trainer()
    for _ in range(8):
        for k in range(0, len(target), 512):
            step(target[k:k + 512], one[k:k + 512], two[k:k + 512])
    a, b, z = model.tables()
    for i, j in ((0, 3), (20, 20), (5, 20)):
        assert abs(np.exp(a[i] + b[j] - z[i, j]).sum() - 1) < 1e-4
    learned = (a[one, target] + b[two, target] - z[one, two]).mean()
    assert learned > np.log(shares[target]).mean() + 0.5
