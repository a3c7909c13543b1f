import random
import time
from itertools import permutations, product

import numpy as np
from pyspark.sql import functions as F

from biflux.operators import mapping as mp, validate as va
from biflux.operators.assignment import assign, best_rows, joint_cost, match_bucket, match_kinds, transport

FIELDS = {
    "src_ip": {"type": "string", "direction": "always", "reverse": "dst_ip"},
    "src_port": {"type": "int", "direction": "always", "reverse": "dst_port"},
    "protocol": {"type": "int", "direction": "always"},
    "bytes": {"type": "int", "direction": "forward", "reverse": "bytes@rev"},
    "agent": {"type": "string", "direction": "any"},
    "rr": {"type": "list", "direction": "any", "subfields": {
        "name": {"type": "string", "direction": "any"}, "ttl": {"type": "int", "direction": "any"}}},
}
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
BASE = {"src_ip": "1", "dst_ip": "2", "src_port": "10", "dst_port": "53", "protocol": "17"}
BACK = {"src_ip": "2", "dst_ip": "1", "src_port": "53", "dst_port": "10", "protocol": "17"}
SUPPORTED = ["bytes", "agent", "rr", "rr.name", "rr.ttl"]


def records(spark, rows, name):
    dictionary = mp.FieldDictionary(FIELDS, KEY)
    df = spark.createDataFrame(list(enumerate(rows)), f"{name} long, fields map<string,string>")
    return mp.with_keys(mp.direction_records(mp.normalize(df, dictionary), dictionary), dictionary)[0]


def run(spark, flows, refs, special=None):
    checks = va.Checks(mp.FieldDictionary(FIELDS, KEY), SUPPORTED, special or {})
    found = va.validate(records(spark, flows, "unit_id"), records(spark, refs, "ref_id"), checks).collect()
    return sorted((r.unit_id, r.ref_id, r.dir, r.outcome, sorted((f.field, f.outcome) for f in r.fields or [])) for r in found
                  if r.unit_id is not None), sorted((r.ref_id, r.dir) for r in found if r.unit_id is None)


def test_exact_and_wrong_value(spark):
    got, gone = run(spark, [{**BASE, "bytes": "5"}], [{**BASE, "bytes": "[\"4\", \"5\"]"}])
    assert got == [(0, 0, 0, "ok", [("bytes", "ok")])] and gone == []
    got, _ = run(spark, [{**BASE, "bytes": "5"}], [{**BASE, "bytes": "6"}])
    assert got[0][3:] == ("error", [("bytes", "error")])


def test_missing_unexpected_and_unchecked(spark):
    other = {**BASE, "dst_port": "80", "bytes": "1"}
    got, gone = run(spark, [other], [{**BASE, "bytes": "5"}])
    assert got == [(0, None, got[0][2], "unexpected", [])] and len(gone) == 1
    got, _ = run(spark, [{**BASE, "agent": "x"}], [{**BASE, "bytes": "5"}])
    assert got[0][4] == [("agent", "unchecked"), ("bytes", "missing")]


def test_field_of_any_direction_may_come_from_the_other_flow(spark):
    flows = [{**BASE, "bytes": "5"}, {**BACK, "bytes": "7", "agent": "curl"}]
    got, gone = run(spark, flows, [{**BASE, "bytes": "5", "bytes@rev": "7", "agent": "curl/8"}], {"agent": "StartsWith"})
    assert [g[3] for g in got] == ["ok", "ok"] and gone == []


def test_best_of_several(spark):
    flows = [{**BASE, "bytes": str(b)} for b in (9, 5, 7)]
    refs = [{**BASE, "bytes": str(b)} for b in (5, 9)]
    got, gone = run(spark, flows, refs)
    assert [(u, r, o) for u, r, _, o, _ in got] == [(0, 1, "ok"), (1, 0, "ok"), (2, None, "unexpected")] and gone == []


def test_lists(spark):
    want = {**BASE, "rr": '[{"name": "a", "ttl": "1"}, {"name": "b", "ttl": "2"}]'}
    flow = {**BASE, "rr": '[{"name": "b", "ttl": "2"}, {"name": "a", "ttl": "9"}, {"name": "c", "ttl": "3"}]'}
    got, _ = run(spark, [flow], [want])
    assert got[0][4] == sorted([("rr.name", "ok"), ("rr.name", "ok"), ("rr.ttl", "ok"), ("rr.ttl", "error"), ("rr", "unexpected")])
    got, _ = run(spark, [flow], [want], {"rr": "OneInArray"})
    assert got[0][3:] == ("ok", [("rr.name", "ok"), ("rr.ttl", "ok")])
    got, _ = run(spark, [{**BASE, "rr": '{"name": "a", "ttl": "1"}'}], [want])
    assert got[0][4] == sorted([("rr.name", "ok"), ("rr.ttl", "ok"), ("rr.name", "missing"), ("rr.ttl", "missing")])


def test_best_rows_against_permutations():
    rng = random.Random(1)
    for _ in range(500):
        r, c = rng.randint(1, 5), rng.randint(1, 5)
        cost = [[rng.randint(0, 6) for _ in range(c)] for _ in range(r)]
        candidates = list(range(r)) + [-1] * max(0, c - r)
        best = min(sum(cost[x][j] for j, x in enumerate(p) if x >= 0) for p in permutations(candidates, c))
        got = best_rows(cost)
        assert sum(cost[x][j] for j, x in enumerate(got) if x >= 0) == best and sum(x >= 0 for x in got) == min(r, c)


def brute_force(refs, units):
    """Least cost over all placements of records on expectation sides that respect the pairing rules."""
    slots = [[i for i, r in enumerate(refs) if r["paired"] or r["dir"] == d] for d in (0, 1)]
    stock = [[n for n, u in enumerate(units) if u["paired"] or u["dir"] == d] for d in (0, 1)]
    lists = [set(permutations(stock[d] + [-1] * max(0, len(slots[d]) - len(stock[d])), len(slots[d]))) for d in (0, 1)]
    best = None
    for chosen in product(*lists):
        at = [dict(zip(slots[d], chosen[d])) for d in (0, 1)]
        of = [{n: i for i, n in at[d].items() if n >= 0} for d in (0, 1)]
        cost, valid = 0, True
        for d in (0, 1):
            for i, n in at[d].items():
                if n < 0:
                    continue
                other = at[1 - d].get(i, -1) if refs[i]["paired"] else None
                if units[n]["paired"]:
                    if refs[i]["paired"]:
                        valid &= other == n
                    else:
                        twin = of[1 - d].get(n)
                        valid &= twin is not None and not refs[twin]["paired"]
                elif refs[i]["paired"]:
                    valid &= other < 0 or not units[other]["paired"]
        if not valid:
            continue
        for i, ref in enumerate(refs):
            a, b = at[0].get(i, -1), at[1].get(i, -1)
            if ref["paired"] and a >= 0 and a == b and units[a]["paired"]:
                cost += units[a]["both"][0][i] + units[a]["both"][1][i]
            elif ref["paired"] and a >= 0 and b >= 0:
                cost += joint_cost(i, units[a], units[b])
            else:
                cost += (units[a]["alone"][0][i] if a >= 0 else 0) + (units[b]["alone"][1][i] if b >= 0 else 0)
        best = cost if best is None else min(best, cost)
    return best


def total(refs, units, found):
    cost, at = 0, {(i, d): (n, o) for i, d, n, o in found}
    for i, ref in enumerate(refs):
        a, b = at.get((i, 0), (-1, -1))[0], at.get((i, 1), (-1, -1))[0]
        if ref["paired"] and a >= 0 and a == b:
            cost += units[a]["both"][0][i] + units[a]["both"][1][i]
        elif ref["paired"] and a >= 0 and b >= 0:
            cost += joint_cost(i, units[a], units[b])
        else:
            cost += (units[a]["alone"][0][i] if a >= 0 else 0) + (units[b]["alone"][1][i] if b >= 0 else 0)
    return cost


def test_match_bucket_against_all_placements():
    rng = random.Random(7)
    for _ in range(600):
        refs = [{"id": i, "paired": rng.random() < 0.5, "dir": rng.randrange(2)} for i in range(rng.randint(1, 3))]
        units = []
        for n in range(rng.randint(0, 4)):
            table = lambda: [[rng.randint(0, 3) for _ in refs] for _ in (0, 1)]
            units.append({"id": n, "paired": rng.random() < 0.4, "dir": rng.randrange(2), "alone": table(), "both": table(),
                          "lacks": [["f"] if rng.random() < 0.4 else [] for _ in refs],
                          "gives": [{"f": rng.randint(0, 1)} if rng.random() < 0.5 else {} for _ in refs]})
            if rng.random() < 0.3:
                units.append({**units[-1], "id": 50 + n})
        units = units[:5]
        want = brute_force(refs, units)
        found = match_bucket(refs, units)
        if want is None:
            assert all(n < 0 for _, _, n, _ in found)
        else:
            assert total(refs, units, found) == want


def test_transport_is_the_assignment_of_its_copies():
    rng = np.random.default_rng(3)
    for _ in range(200):
        rows, columns = rng.integers(1, 5, 2)
        cost, supply, demand = rng.integers(0, 6, (rows, columns)), rng.integers(1, 5, rows), rng.integers(1, 5, columns)
        amounts = transport(cost, supply.tolist(), demand.tolist())
        assert (amounts.sum(1) <= supply).all() and (amounts.sum(0) <= demand).all() and amounts.sum() == min(supply.sum(), demand.sum())
        spread = np.repeat(np.repeat(cost, supply, 0), demand, 1)
        found = assign(spread)
        assert (amounts * cost).sum() == sum(spread[r, c] for r, c in enumerate(found) if c >= 0)


def random_kinds(rng, mixed):
    refs = [{"kind": f"r{i}", "paired": mixed != 0 and rng.random() < (0.5 if mixed == 1 else 1), "dir": rng.randrange(2), "copies": rng.randint(1, 3)} for i in range(rng.randint(1, 3))]
    units = []
    for n in range(rng.randint(0, 3)):
        table = lambda: [[rng.randint(0, 3) for _ in refs] for _ in (0, 1)]
        units.append({"kind": f"u{n}", "paired": mixed != 0 and rng.random() < (0.5 if mixed == 1 else 1), "dir": rng.randrange(2), "copies": rng.randint(1, 3),
                      "alone": table(), "both": table(), "lacks": [[] for _ in refs], "gives": [{} for _ in refs]})
    return refs, units


def test_kinds_cost_what_their_copies_cost():
    rng = random.Random(2)
    for k in range(300):
        refs, units = random_kinds(rng, k % 3)
        index = [i for i, r in enumerate(refs) for _ in range(r["copies"])]
        one_refs = [refs[i] for i in index]
        spread = lambda u: {**u, "alone": [[x[i] for i in index] for x in u["alone"]], "both": [[x[i] for i in index] for x in u["both"]], "lacks": [[]] * len(index), "gives": [{}] * len(index)}
        one_units = [spread(u) for u in units for _ in range(u["copies"])]
        want = match_bucket(one_refs, one_units)
        place = {(i, c): n for n, (i, c) in enumerate((i, c) for i, r in enumerate(refs) for c in range(r["copies"]))}
        at = {(i, c): n for n, (i, c) in enumerate((i, c) for i, u in enumerate(units) for c in range(u["copies"]))}
        runs = match_kinds(refs, units)
        found = [(place[i, a + k], d, at[n, b + k] if n >= 0 else -1, -1) for i, a, d, n, b, size in runs for k in range(size)]
        assert len(found) == len({f[:2] for f in found}) == sum(r["copies"] * (2 if r["paired"] else 1) for r in refs)
        used = [(n, d) for _, d, n, _ in found if n >= 0]
        assert len(used) == len(set(used)) == sum(n >= 0 for _, _, n, _ in want)
        assert total(one_refs, one_units, found) == total(one_refs, one_units, want)


def test_many_annotations_under_one_key():
    rng = random.Random(200)
    refs, units, contents = [], [], []
    for i in range(200):
        refs.append({"id": i, "paired": rng.random() < 0.5, "dir": rng.randrange(2)})
        contents.append([[rng.randrange(6) for _ in range(4)] for _ in (0, 1)])
    for n in range(230):
        ref = refs[n] if n < 200 else {"paired": rng.random() < 0.5, "dir": rng.randrange(2)}
        own = [[x if rng.random() > 0.08 else 9 for x in side] for side in (contents[n] if n < 200 else [[7] * 4] * 2)]
        for paired, d in ([(False, 0), (False, 1)] if ref["paired"] and rng.random() < 0.2 else [(ref["paired"], ref["dir"])]):
            costs = [[sum(a != b for a, b in zip(own[e], contents[i][e])) for i in range(200)] for e in (0, 1)]
            units.append({"paired": paired, "dir": d, "alone": costs, "both": costs, "lacks": [[]] * 200, "gives": [{}] * 200})
    rng.shuffle(units)
    began = time.perf_counter()
    found = match_bucket(refs, units)
    assert time.perf_counter() - began < 20
    slots = [(i, d) for i, r in enumerate(refs) for d in (0, 1) if r["paired"] or r["dir"] == d]
    assert sorted(f[:2] for f in found) == sorted(slots) and total(refs, units, found) <= sum(sum(x == 9 for x in s) for c in contents for s in c) + 200


def modelled(flows, refs):
    """The rules of one bucket spelled out for fields bytes (own direction) and agent (either), as input of ``brute_force``."""
    def sides(fields):
        forward = {k: v for k, v in fields.items() if k in ("bytes", "agent")}
        backward = {("bytes" if k == "bytes@rev" else k): v for k, v in fields.items() if k in ("bytes@rev", "agent")}
        d = 0 if fields["src_ip"] == "1" else 1
        two = "bytes@rev" in fields
        return {"dir": d, "paired": two, d: forward, 1 - d: backward if two else None}

    def outcome(wanted, own, other):
        """Missing and wrong fields; the other direction may supply the agent."""
        bad = {}
        for name, value in wanted.items():
            got = own.get(name, (other or {}).get(name) if name == "agent" else None)
            if got is None:
                bad[name] = "missing"
            elif got != value:
                bad[name] = "error"
        return bad

    flows, refs = [sides(f) for f in flows], [sides(r) for r in refs]
    units = []
    for f in flows:
        cost = {kind: [[None if r[d] is None or f[d] is None else len(outcome(r[d], f[d], f[1 - d] if kind else None)) for r in refs] for d in (0, 1)] for kind in (0, 1)}
        lacks = [["agent"] if r[f["dir"]] is not None and outcome(r[f["dir"]], f[f["dir"]], None).get("agent") == "missing" else [] for r in refs]
        gives = [{"agent": int(r[1 - f["dir"]]["agent"] != f[f["dir"]]["agent"])} if r[1 - f["dir"]] and "agent" in f[f["dir"]] and "agent" in r[1 - f["dir"]] else {} for r in refs]
        units.append({"paired": f["paired"], "dir": f["dir"], "alone": cost[0], "both": cost[1], "lacks": lacks, "gives": gives})
    return refs, units


def test_search_against_all_placements(spark):
    """Several flows and annotations per key: two-way and one-way, both ends, repeated, with and without the shared field."""
    rng = random.Random(11)
    flows, refs, want = [], [], {}
    for key in range(60):
        ends = [{**BASE, "src_port": str(100 + key)}, {**BACK, "dst_port": str(100 + key)}]

        def some(n):
            rows = []
            for _ in range(n):
                row = {**ends[rng.random() < 0.3], "bytes": str(rng.randint(1, 3))}
                if rng.random() < 0.5:
                    row["bytes@rev"] = str(rng.randint(1, 3))
                if key % 2 or rng.random() < 0.5:
                    row["agent"] = rng.choice("xy")
                rows += [row] * (1 if rng.random() < 0.8 else 2)
            return rows[:4 if n > 3 else 3]

        own_flows, own_refs = some(rng.randint(0, 4)), some(rng.randint(1, 3))
        modelled_refs, units = modelled(own_flows, own_refs)
        want[100 + key] = brute_force(modelled_refs, units)
        flows += own_flows
        refs += own_refs
    checks = va.Checks(mp.FieldDictionary(FIELDS, KEY), ["bytes", "agent"])
    found = va.validate(records(spark, flows, "unit_id"), records(spark, refs, "ref_id"), checks).collect()
    port = lambda r: int((refs[r.ref_id] if r.ref_id is not None else flows[r.unit_id])["src_port" if (refs[r.ref_id] if r.ref_id is not None else flows[r.unit_id])["src_ip"] == "1" else "dst_port"])
    got = dict.fromkeys(want, 0)
    for r in found:
        got[port(r)] += sum(f.outcome in ("error", "missing") for f in r.fields or [])
    sides = lambda rows: sum(2 if "bytes@rev" in r else 1 for r in rows)
    assert sum(r.unit_id is not None for r in found) == sides(flows) and sum(r.ref_id is not None for r in found) == sides(refs)
    assert got == {k: w or 0 for k, w in want.items()}


def test_equal_records_pair_off_without_a_search(spark, monkeypatch):
    """A key of thousands of equal and a few odd records."""
    flows = [{**BASE, "bytes": str(k % 50)} for k in range(3000)] + [{**BASE, "bytes": "900"}] * 40
    refs = [{**BASE, "bytes": str(k % 50)} for k in range(2990)] + [{**BASE, "bytes": "700"}] * 30
    for heavy in (2_000_000, 100):
        monkeypatch.setattr("biflux.skew.heavy_keys.__defaults__", (heavy, 1 / 16384))
        checks = va.Checks(mp.FieldDictionary(FIELDS, KEY), SUPPORTED)
        found = va.validate(records(spark, flows, "unit_id"), records(spark, refs, "ref_id"), checks).groupBy("outcome").count().collect()
        assert {r.outcome: r["count"] for r in found} == {"ok": 2990, "error": 30, "unexpected": 20}


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalised_records_are_made_once_per_row(spark):
    # The filter on missing key fields and the key columns read the records; none of them may make the records again.
    text = planned(records(spark, [{**BASE, "bytes": "5", "bytes@rev": "7"}], "unit_id").select("unit_id", "bucket", "dir", "f", "r"))
    assert text.count("as bigint") <= 4  # typed scalars, list items (in an array, alone and twice as a size)


def test_the_best_list_item_is_ranked_once(spark):
    checks = va.Checks(mp.FieldDictionary(FIELDS, KEY), SUPPORTED, {"rr": "OneInArray"})
    rows = records(spark, [{**BASE, "rr": '{"name": "a", "ttl": "1"}'}], "unit_id").select("biflow", F.col("f").alias("obs"), F.col("f").alias("want"))
    found = va.with_comparisons(
        rows, {"fields": (lambda x: F.col("obs"), lambda x: F.col("obs"), lambda x: x)}, "want", checks, F.col("biflow"), single=True)
    judged = F.col("fields")[0]
    assert planned(found.select(judged.alias("a"), F.size(judged).alias("n")).where("n > 0")).count("array_min(") == 1
    assert sorted((f.field, f.outcome) for f in found.first().fields[0])[-2:] == [("rr.name", "ok"), ("rr.ttl", "ok")]


def test_rows_of_a_bucket_are_dealt_together_for_the_search(spark, monkeypatch):
    """Spark drops a deal by bucket after a union of tables dealt by bucket; the parts of each may then be merged differently."""
    import __spark_entry__ as entry

    plans = []
    frame = type(spark.range(1))
    found = frame.mapInArrow

    def spied(self, *args, **kwargs):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return found(self, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    entry.queries()["best_match"](spark, "/root/testdata/sf0.001")
    assert plans and all("REPARTITION_BY_COL" in p for p in plans)


def test_validation_writes_its_tables_once_and_slim(spark, monkeypatch):
    """What is kept of the records has no key fields, and nothing as wide as the joined records is written."""
    kept, written = [], va.stored

    def spied(df):
        kept.append(written(df))
        return kept[-1]

    monkeypatch.setattr(va, "stored", spied)
    monkeypatch.setattr(va, "durable", lambda df: (_ for _ in ()).throw(AssertionError("rows kept as they are")))
    flows = [{**BASE, "bytes": "5", "bytes@rev": "7", "rr": '[{"name": "a"}, {"name": "b"}]'}, {**BASE, "src_port": "11", "bytes": "6"}]
    got, gone = run(spark, flows, [{**flows[0], "rr": '[{"name": "b"}, {"name": "a"}]'}, {**BASE, "src_port": "12"}])
    assert [g[:4] for g in got] == [(0, 0, 0, "ok"), (0, 0, 1, "ok"), (1, None, 0, "unexpected")] and gone == [(1, 0)]
    assert got[0][4] == [("bytes", "ok"), ("rr.name", "ok"), ("rr.name", "ok")]
    names = {r.k for df in kept if "s0" in df.columns for s in ("s0", "s1") for r in df.select(F.explode(F.map_keys(f"{s}.values")).alias("k")).collect()}
    assert names == {"bytes"}
    assert all("back" not in df.columns and "want" not in df.columns for df in kept)


def test_records_of_two_flows_serve_a_two_way_annotation(spark):
    """The other direction's record may be another flow's; it supplies fields of any direction."""
    flows = [{**BASE, "bytes": "5"}, {**BACK, "bytes": "7", "agent": "x"}]
    got, gone = run(spark, flows, [{**BASE, "bytes": "5", "bytes@rev": "7", "agent": "x"}])
    assert [g[:4] for g in got] == [(0, 0, 0, "ok"), (1, 0, 1, "ok")] and not gone
    assert got[0][4] == [("agent", "ok"), ("bytes", "ok")]
