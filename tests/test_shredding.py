import json
import random

from pyspark.sql import functions as F

from loomtext.operators.reports import ReportTables
from loomtext.operators.shredding import Shredder, bridge, objects, occurrences, shred_payload
from loomtext.workspace import Workspace


def rebuild(nodes):
    """The payload's objects from their rows: the round trip."""
    by = {n["hash"]: n for n in nodes}

    def scalar(v):
        return v[1:] if v.startswith('"') else json.loads(v)

    def make(h):
        n = by[h]
        out = {k: scalar(v) for k, v in n["scalars"]}
        for field, _, place, child, value in n["children"]:
            x = json.loads(value) if child is None else make(child)
            if not place:
                out[field] = x
                continue
            at = out.setdefault(field, [])
            for _ in place.split("/")[:-1]:
                i = int(_)
                if len(at) == i:
                    at.append([])
                at = at[i]
            at.append(x)
        return out

    return [make(n["hash"]) for n in sorted((n for n in nodes if n["root"] is not None), key=lambda n: n["root"])]


def test_round_trip_and_identity():
    deep = {"a": 1}
    for i in range(60):
        deep = {"x": [deep, {"k": i}], "s": "é \"", "n": None, "l": [1, [2, 3]], "e": [], "o": {"p": {}}, "mixed": [1, "t", {"q": [[{"z": 1}, 2], [], [[3]]]}, None]}
    assert rebuild(shred_payload(json.dumps(deep))) == [deep]
    a = shred_payload('{"x": {"a": 1, "b": [{"c": 2.0}]}, "y": {"b": [{"c": 2}], "a": 1}}')
    assert len({n["hash"] for n in a}) == 3 and len(a) == 5
    assert [n["parent"] for n in a] == [1, 4, 3, 4, None]
    assert shred_payload('[{"a": 1}, 5, {"a": 1}]')[0]["hash"] == shred_payload('{"a":1}')[0]["hash"]


def test_hash_depends_on_content_alone():
    top = lambda s: shred_payload(s)[-1]["hash"]
    assert top('{"a": [1, {"x": 1, "y": 2}]}') == top('{"a": [1.0, {"y": 2, "x": 10e-1}]}')
    differ = ['{"a": [1, {"x": 1}]}', '{"a": [2, {"x": 1}]}', '{"a": [{"x": 1}, 1]}', '{"a": [[1], {"x": 1}]}', '{"a": {"x": 1}}', '{"a": [{"x": 1}]}', '{"a": [[{"x": 1}]]}', '{"a": "1"}', '{"a": 1}', '{"a": null}', '{"a": [1, [{"x": 1}]]}']
    assert len({top(s) for s in differ}) == len(differ)
    assert shred_payload('{"a": [1, {"x": 1}, "s"]}')[-1]["children"] == [("a", 0, "0", None, "1"), ("a", 1, "1", shred_payload('{"x": 1}')[0]["hash"], None), ("a", 2, "2", None, '"s"')]


def test_numbers_keep_all_digits():
    same = [("1e2", "100"), ("1.50", "15e-1"), ("-0.0", "0"), ("1e400", "10E+399"), ("0.1234567890123456789", "1234567890123456789e-19"), ("1" + "0" * 60, "1e60")]
    for x, y in same:
        assert shred_payload(f'{{"a": {x}}}')[0]["hash"] == shred_payload(f'{{"a": {y}}}')[0]["hash"], x
    differ = ["0.1234567890123456789", "0.123456789012345678", "1e400", "1e401", "-1", "1", "9" * 5000, "9" * 4999 + "8", "1e" + "9" * 5000]
    assert len({shred_payload(f'{{"a": {x}}}')[0]["hash"] for x in differ}) == len(differ)
    assert shred_payload('{"a": ' + "7" * 5000 + "}")[0]["scalars"] == [("a", "7" * 5000)]


def test_deep_payloads():
    for depth in (900, 5000, 60000):
        nodes = shred_payload('{"a": [1, ' * depth + '{"b": 2}' + "]}" * depth)
        assert len(nodes) == depth + 1 and nodes[-1]["root"] == 0 and nodes[0]["parent"] == 1
    assert len(shred_payload("[" * 50000 + '{"a": 1}' + "]" * 50000)) == 1
    assert shred_payload('{"a": ' + "[" * 50000 + "]" * 50000 + "}")[0]["scalars"][0][1] == "[" * 50000 + "]" * 50000


def test_the_parser_of_deep_payloads_is_as_the_other():
    rng = random.Random(2)

    def value(d):
        k = rng.randrange(8 if d else 5)
        return [None, True, "a\"é\n", rng.random() * 10 ** rng.randint(-9, 9), rng.randint(-99, 99)][k] if k < 5 else [value(d - 1) for _ in range(rng.randrange(4))] if k == 5 else {f"k{i}": value(d - 1) for i in range(rng.randrange(4))}

    texts = [json.dumps(value(4), indent=rng.choice([None, 1])) for _ in range(300)]
    texts += [t[:-1] for t in texts[:60]] + ["{", "[1,]", '{"a" 1}', '{"a": 1,}', "01", "1 2", "tru", '{"a": NaN}', "[1 2]", "{1: 2}", '"a', "-", "1.", '{"a": {}, "a": 2}', " [ ] ", "\ufeff{}"]
    for t in texts:
        one, two = Shredder(), Shredder()
        try:
            a = [one.parse(t), one.nodes]
        except ValueError:
            a = None
        try:
            b = [two._deep(t), two.nodes]
        except ValueError:
            b = None
        assert a == b, t


def test_odd_payloads():
    for p in (None, "", "  ", "null", "3", '"x"', "[]"):
        assert shred_payload(p) == []
    for p in ("{", '{"a": NaN}', "{} {}", "[" * 200000):
        assert shred_payload(p) is None
    assert shred_payload('{"a": "\\ud800"}')[0]["scalars"] == [("a", '"�')]
    assert shred_payload('{"a": 1, "a": {"b": 2}, "a": 3, "a#1": 0}')[-1]["scalars"] == [("a", "3"), ("a#1", "0"), ("a#2", "1")]


def frame(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "file_id long, payload string, hash string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))


def test_objects_once_with_every_occurrence(spark):
    df = frame(spark, ['{"m": [{"v": 1}, {"v": 1}]}', '{"m": [{"v": 1}, {"v": 1}]}', None, "{"])
    occ = Workspace(spark, "t").keep(occurrences(df.repartition(3, "file_id"), "payload", {"file_id": F.col("file_id")}))
    assert occ.count() == 6
    objs = objects(occ)
    assert objs.count() == 2
    assert sorted(r["ordinal"] for r in bridge(objs).collect()) == [0, 1]


def record(n, text, mentions, revision=1, **more):
    return {"report_number": n, "text": text, "revision": revision, "mentions": mentions, **more}


def test_report_tables(spark):
    ok, bad = {"mention": "bc", "start": 1, "length": 2}, {"mention": "bc", "start": "2", "length": 2}
    payloads = [
        json.dumps(record(" 007 ", "abcd", {"x": [ok]})),
        json.dumps([record("7", "abcd", {"x": [ok, bad, {"mention": "a", "start": -1, "length": 1}, {"mention": "a", "start": 0}, None, {"mention": "d", "start": 3.0, "length": "1"}], "y": bad, "z": None, "e": []}, revision=2)]),
        json.dumps({"batch": {"document": record(8, "\U0001d40d é", {"x": [{"mention": "é", "start": 2, "length": 2}]}, evaluation={"rounds": [{"annotator": "a", "checks": [{"attr": "x", "ok": True, "hits": [0, 1]}]}]})}}),
        json.dumps(record(9, None, {})), json.dumps({"text": "no number", "mentions": {}}), "{", "",
    ]
    t = ReportTables(frame(spark, payloads))
    assert sorted(r["report_number"] for r in t.reports.collect()) == [7, 8, 9]
    m = {(r["report_number"], r["attribute"], r["pos"]): r for r in t.mentions().collect()}
    assert sorted(k for k, r in m.items() if r["located"] and not r["agrees"]) == [(7, "x", 1), (7, "x", 2), (7, "y", 0)]
    assert m[7, "x", 5]["agrees"] and m[8, "x", 0]["agrees"] and not m[7, "x", 3]["located"]
    assert [tuple(r) for r in t.rounds().collect()] == [(8, 0, "a")]
    assert [tuple(r) for r in t.checks().collect()] == [(8, 0, 0, "x", True, "[0,1]")]


def test_empty(spark):
    t = ReportTables(frame(spark, ["x"]).where("false"))
    assert t.mentions().count() == 0 and t.checks().count() == 0
