"""Validation verdict from collector records and an annotation file."""

import json

from biflux.operators import mapping as mp, validate as va
from biflux.plans.verdicts import validation_verdict
from biflux.sources.readers import read_annotations
from tests.test_validate import FIELDS, KEY, SUPPORTED

TABLE = {
    "src": {"map": "src_ip"}, "dst": {"map": "dst_ip"}, "sp": {"map": "src_port"}, "dp": {"map": "dst_port"},
    "proto": {"map": "protocol"}, "b": {"map": "bytes"}, "b@r": {"map": "bytes@rev"}, "agent": {"map": "agent", "converter": "hex_to_lower"},
    "rr_name": {"map": "rr.name"}, "rr_ttl": {"map": "rr.ttl"},
}


def test_verdict(spark, tmp_path):
    flow = {"src_ip": "1", "dst_ip": "2", "src_port": 10, "dst_port": 53, "protocol": 17, "bytes": [4, 5], "bytes@rev": 7,
            "_reverse": {"rr": [{"name": "a", "ttl": 3}]}}
    path = tmp_path / "annotations.jsonl"
    path.write_text(json.dumps({"test": "dns", "at_least_one": ["rr.name"], "flow": flow}) + "\n")
    annotations = read_annotations(spark, str(path))
    assert annotations.first()["at_least_one"] == ["rr.name"]
    records = spark.createDataFrame([
        (1, {"src": "1", "dst": "2", "sp": "10", "dp": "53", "proto": "17", "b": "5", "x": "y"}),
        (2, {"src": "2", "dst": "1", "sp": "53", "dp": "10", "proto": "17", "b": "7", "rr_name": "a", "rr_ttl": "3"}),
        (3, {"src": "9", "dst": "1", "sp": "53", "dp": "10", "proto": "17", "b": "7"}),
        (4, {"dst": "1", "b": "7"}),
    ], "unit_id long, record map<string,string>")
    known = mp.converters()
    checks = va.Checks(mp.FieldDictionary(FIELDS, KEY), SUPPORTED)
    result, unmapped = validation_verdict(records, annotations, mp.check_mapping(TABLE, known), checks, known)
    found = {r.unit_id: (r.outcome, sorted((f.field, f.outcome) for f in r.fields or [])) for r in result.collect()}
    assert found == {
        1: ("ok", [("bytes", "ok")]), 2: ("ok", [("bytes", "ok"), ("rr.name", "ok"), ("rr.ttl", "ok")]),
        3: ("unexpected", []), 4: ("unexpected", [])}
    assert [tuple(r) for r in unmapped.collect()] == [("x", 1)]
    assert va.coverage(result, ["rr.name"]).first()[0] and not va.passed(result).first()[0]
