import json
import random

import pytest

from tallyfield.sources import arrays as A

SCHEMA = "id bigint, orderTime string, items array<struct<id:bigint,name:string,amount:bigint>>"
NAMES = ['quote " inside', "brace } and {", "back\\slash", 'both \\" of } them', "größe 日本 😀", "[not] an array", "", "\\", '"', "tab\tline\nbreak", "}}}}", "\\\\\""]


def orders(count, seed):
    draw = random.Random(seed)
    return [
        {"id": k, "orderTime": draw.choice(NAMES), "items": [{"id": j, "name": draw.choice(NAMES) * draw.choice([1, 1, 30]), "amount": j} for j in range(draw.randint(0, 4))]}
        for k in range(count)
    ]


def rows_of(df):
    return sorted((r.id, r.orderTime, tuple(tuple(i) for i in r["items"])) for r in df.collect())


def want(many):
    return sorted((o["id"], o["orderTime"], tuple((i["id"], i["name"], i["amount"]) for i in o["items"])) for o in many)


@pytest.mark.parametrize(
    "chunk, block, form",
    [(1 << 20, "128m", "array"), (1 << 20, "128m", "indented"), (1, "1000b", "ascii"), (40, "300b", "array"), (500, "700b", "indented")],
)
def test_arrays_cut_anywhere(spark, tmp_path, monkeypatch, chunk, block, form):
    monkeypatch.setattr(A, "CHUNK", chunk)
    many, few = orders(60, 1), [{**o, "id": 1000 + o["id"]} for o in orders(3, 2)]
    how = {"array": {"ensure_ascii": False}, "indented": {"indent": 2, "ensure_ascii": False}, "ascii": {}}[form]
    (tmp_path / "many.json").write_text(json.dumps(many, **how))
    (tmp_path / "few.json").write_text("\ufeff \n" + json.dumps(few, **how) + "\n\n")
    (tmp_path / "one.json").write_text(json.dumps({**few[0], "id": 5000}, **how) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows_of(A.read_json_arrays(spark, str(tmp_path), SCHEMA))
        parts = spark.read.option("lineSep", "}").text(str(tmp_path / "many.json")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want([*many, *few, {**few[0], "id": 5000}])
    assert block == "128m" or parts > 4


def test_one_object_over_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 30)
    big = {"id": 1, "orderTime": "x", "items": [{"id": k, "name": "n}" * 20, "amount": 1} for k in range(200)]}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 0, "orderTime": "", "items": []}, big, {"id": 2, "orderTime": "", "items": []}]))
    got = A.read_json_arrays(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.id, len(r["items"])) for r in got) == [(0, 0), (1, 200), (2, 0)]


def test_lines_and_other_values(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": 1}\n{"id": 2, "more": [1, {"id": 9}]}\n')
    (tmp_path / "mixed.json").write_text('[1, "a}", {"id": 3}, [{"id": 4}], null, {"id": "no number"}, {"id": 5}]')
    got = sorted(str(r.id) for r in A.read_json_arrays(spark, str(tmp_path), "id bigint").collect())
    assert got == ["1", "2", "3", "5", "None"]


def test_summaries_compose():
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice('"\\{}[]ab,') for _ in range(draw.randint(0, 30))).encode()
        for state in (A.OUTSIDE, A.INSIDE, A.ESCAPED):
            *steps, (_, end) = A.brackets(text, state)
            assert A.summary(text)[2 * state : 2 * state + 2] == [end, sum(s for _, s in steps)]
            cut = draw.randint(0, len(text))
            left, right = A.summary(text[:cut])[2 * state : 2 * state + 2], None
            right = A.summary(text[cut:])[2 * left[0] : 2 * left[0] + 2]
            assert [right[0], left[1] + right[1]] == [end, sum(s for _, s in steps)]


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else f'a"{k}', [(1, "b", k)]) for k in range(50)], SCHEMA)
    A.write_json_arrays(df.repartition(3), str(tmp_path / "out"))
    assert sorted(map(str, A.read_json_arrays(spark, str(tmp_path / "out"), SCHEMA).collect())) == sorted(map(str, df.collect()))
    texts = [p.read_text().strip() for p in (tmp_path / "out").glob("part-*")]
    assert all("\n" not in t and isinstance(json.loads(t), list) for t in texts) and sum(len(json.loads(t)) for t in texts) == 50
    A.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    assert A.read_json_arrays(spark, str(tmp_path / "none"), SCHEMA).collect() == []


@pytest.mark.parametrize("state", [A.OUTSIDE, A.INSIDE, A.ESCAPED])
def test_brackets_at_once_as_token_by_token(state):
    draw = random.Random(5)
    texts = [bytes(draw.choice(b'{}[]"\\ax,') for _ in range(draw.randint(0, 12))) for _ in range(4000)]
    for text in [*texts, json.dumps(orders(30, 3)).encode()]:
        *steps, (_, end) = A.brackets(text, state)
        places, changes, last = A.Lexed(text).brackets(state)
        assert (list(zip(places.tolist(), changes.tolist())), last) == (steps, end), text


def test_plain_chunks_are_not_lexed_token_by_token(monkeypatch):
    text = json.dumps([{"name": 'a "quoted" } word', "k": [1, {"m": "\\"}]}] * 50).encode()
    want = A.summary(text)
    slow, tried = A.brackets, []
    monkeypatch.setattr(A, "brackets", lambda t, s: tried.append(s) or slow(t, s))
    assert A.summary(text) == want and A.OUTSIDE not in tried
    tried.clear()
    assert len(list(A._objects(text, A.OUTSIDE, 0, 1))) == 50 and not tried
