import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from table_rows import rows

from larkspur.functions import gear
from larkspur.operators.shredding import gear_items

#: Deeper than the standard reader goes.
DEEP = 20_000


def brute(text):
    """Paths by plain recursion."""
    out = []

    def walk(entries, path):
        for i, x in enumerate(entries):
            cls = gear.item_class(x)
            if cls is None:
                continue
            p = f"{path}.{i}"
            out.append((p, cls, gear.item_count(x)))
            for field, raw in gear.item_children(x):
                try:
                    walk(gear.read_list(raw), f"{p}.{field}")
                except gear.Unreadable:
                    pass

    try:
        walk(gear.gear_list(text) if text and text.strip() else [], "gear")
    except gear.Unreadable:
        pass
    return sorted(out, key=repr)


def random_item(rng, depth=0):
    kind = rng.random()
    if kind < 0.15:
        return None
    if kind < 0.35:
        return f"c{rng.randrange(99)}"
    children = [random_item(rng, depth + 1) for _ in range(rng.randrange(4))] if depth < 5 else []
    if kind < 0.6:
        return [f"c{rng.randrange(99)}", rng.choice([None, 3]), children][: rng.randrange(1, 4)]
    item = {rng.choice(["class", "className"]): f"c{rng.randrange(99)}", "count": rng.choice([1, "7", None]), "meta": {"log": [{"class": "no"}]}}
    for f in ("attachments", "mags", "contents"):
        if rng.random() < 0.4:
            inner = [random_item(rng, depth + 1) for _ in range(rng.randrange(4))] if depth < 5 else []
            item[f] = rng.choice([inner, json.dumps(inner), None, {"class": "lone"}])
    return item


FIXED = [
    (None, []),
    ("", []),
    ('{"gear":[{"class":"a","con', []),
    ("{}", []),
    ("[]", []),
    ('[["a",2,["b",nil,["c",1]]],nil,"d"]', ["gear.0", "gear.0.contents.0", "gear.0.contents.2", "gear.2"]),
    ("[['a',1,[['b''s']]]]", ["gear.0", "gear.0.contents.0"]),
    ('{"x":{"y":{"gear":{"class":"a","mags":"[{\\"class\\":\\"b\\"},null,\\"c\\"]"}}}}', ["gear.0", "gear.0.mags.0", "gear.0.mags.2"]),
    ('"[\\"a\\"]"', ["gear.0"]),
    ('{"class":"a","contents":["b"]}', ["gear.0", "gear.0.contents.0"]),
    ('["a",3,["b"]]', ["gear.0", "gear.0.contents.0"]),
]


def test_fixed_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FIXED)], "id long, t string")
    got = {}
    for r in gear_items(df.unionAll(df), "x", "id", "t").collect():
        got.setdefault(int(r.row_key), []).append(r.item_path)
    for i, (_, want) in enumerate(FIXED):
        assert sorted(got.get(i, [])) == sorted(want), FIXED[i]


def test_shredding_equals_recursion(spark):
    rng = random.Random(5)
    texts = [json.dumps({"v": 1, "gear": [random_item(rng) for _ in range(rng.randrange(6))]}) for _ in range(700)]
    texts[13] = texts[13][:-5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = gear_items(df, "x", "id", "t").collect()
    got = {}
    for r in out:
        got.setdefault(int(r.row_key), []).append((r.item_path, r["class"], r["count"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=repr) == brute(t)
    known = {(r.row_key, r.item_path) for r in out}
    assert all(r.parent_path is None or (r.row_key, r.parent_path) in known for r in out)
    assert all((r.parent_path is None) == (r.depth == 1) for r in out)


def test_array_notation():
    assert gear.read_sqf('[1, -2.5, "a""b", nil, true, [\'c\']]') == [1, -2.5, 'a"b', None, True, ["c"]]
    for bad in ("[1,", "[1 2]", "]", "[1]]", "[,1]", "[1,]", "x", ""):
        with pytest.raises(gear.Unreadable):
            gear.read_sqf(bad)


def test_nesting_of_any_depth(spark):
    deep = 700
    array = '["c",1,[' * deep + '"x"' + "]]" * deep
    objects = '{"class":"c","mags":[' * deep + '"x"' + "]}" * deep
    wrapped = json.dumps(["a", {"class": "b", "contents": "[\"x\"]"}])
    for _ in range(10):
        wrapped = json.dumps(wrapped)
    texts = ["[" * 50_000 + "]" * 50_000, array, objects, wrapped, "[" * 50_000, objects[:-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in gear_items(df, "x", "id", "t").select("row_key", "item_path", "depth").collect():
        got.setdefault(r.row_key, {})[r.depth] = r.item_path
    assert set(got) == {"1", "2", "3"}
    assert len(got["1"]) == len(got["2"]) == deep + 1
    assert got["1"][deep + 1] == "gear.0" + ".contents.0" * deep and got["2"][deep + 1] == "gear.0" + ".mags.0" * deep
    assert got["3"] == {1: "gear.1", 2: "gear.1.contents.0"}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12))
@settings(max_examples=30, deadline=None)
def test_deep_reader_agrees_with_the_standard_one(value):
    text = json.dumps(value)
    with pytest.raises(RecursionError):
        json.loads("[" * DEEP + "]" * DEEP)
    inner = gear.read_json("[" * DEEP + text + "]" * DEEP)
    for _ in range(DEEP):
        inner = inner[0]
    assert inner == value


@pytest.mark.parametrize("bad", ["1]", "[1,]", "[,1]", '{"a" 1}', '{"a":1,}', "[1 2]", "{1:2}", "{]", '{"a"}', "x"])
def test_deep_reader_refuses_what_is_no_json(bad):
    with pytest.raises(gear.Unreadable):
        gear.read_json("[" * DEEP + bad + "]" * DEEP)
