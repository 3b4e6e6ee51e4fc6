import json
import math

import pytest
from table_rows import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import exprs, script
from larkspur.operators import boards, fuzzy, relational
from larkspur.plans.session import Session
from larkspur.sources import store, text

GOLDEN = [
    ("rhs_m4a1", "rhs_m4", 0.5), ("rhs_m4a1_carryhandle", "rhs_m4", 0.25), ("hlc_ak74", "rhs_m4", 1 / 17), ("rhs_m4a1", "m4a1", 4 / 12),
    ("hello world", "hello", 6 / 14), ("Rifleman M4", "rifle", 5 / 15), ("", "", 1.0), ("abc", "xyz", 0.0),
]


def test_trigram_similarity(spark):
    df = spark.createDataFrame(GOLDEN, "a string, b string, w double")
    assert df.filter(F.abs(fuzzy.similarity(F.col("a"), F.col("b")) - F.col("w")) > 1e-9).count() == 0


def test_fuzzy_join_equals_brute_force(spark):
    words = ["steel ring", "steel rings", "steal ring", "blue gear", "blue gears", "gear", "", None, "ring", "ring"]
    a = spark.createDataFrame(list(enumerate(words)), "id long, t string")
    b = a.withColumnsRenamed({"id": "k", "t": "u"})
    for t in (0.2, 0.5, 1.0):
        brute = a.crossJoin(b).withColumn("s", fuzzy.similarity(F.col("t"), F.col("u"))).filter(F.col("s") >= t).select("id", "k")
        assert rows(fuzzy.fuzzy_join(a, "id", "t", b, "k", "u", t).select("left_key", "right_key")) == rows(brute)
    assert fuzzy.posting_lists(a, "id", "t").filter("id = 8").count() == fuzzy.posting_lists(a, "id", "t").filter("id = 9").count()


def test_two_valued_and_patterns(spark):
    df = spark.createDataFrame([(1, None, "x.y"), (1, 1, "a\\b"), (1, 2, None)], "a int, b int, s string")
    assert [r[0] for r in df.select(exprs.ne2(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(exprs.in2(F.col("b"), F.lit(None).cast("int"), F.lit(2))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(exprs.glob_match(F.col("s"), "?.*")).collect()] == [True, False, None]
    assert [r[0] for r in df.select(exprs.like_plain(F.col("s"), "a\\_")).collect()] == [False, True, None]
    one = spark.range(1)
    assert one.select(exprs.int_div(F.lit(-7), F.lit(2)), exprs.int_div(F.lit(7), F.lit(0)), exprs.mod_float(F.lit(7), F.lit(4))).first()[:] == (-3, None, 3.0)
    assert one.select(exprs.loose_cast(F.lit(""), "bigint"), exprs.loose_cast(F.lit("2.9"), "bigint"), exprs.loose_cast(F.lit("z"), "double")).first()[:] == (0, 2, None)
    assert one.select(exprs.loose_lt(F.lit("9"), F.lit("10")), exprs.loose_lt(F.lit("b"), F.lit("a"))).first()[:] == (True, False)
    assert one.select(exprs.char_codes(F.lit(72), F.lit(8364), F.lit(128512))).first()[0] == "H€😀"


def test_date_patterns():
    assert exprs.date_pattern("%Y-%m at %H%%") == "yyyy'-'MM' at 'HH'%'"
    with pytest.raises(ValueError):
        exprs.shift(F.lit(None), "3 fortnights")


def test_group_concat_and_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", None), ("b", None)], "g string, v int")
    out = df.groupBy("g").agg(relational.group_concat(F.col("v"), ";").alias("c"), relational.count_distinct_with_null(F.col("v")).alias("n"))
    assert rows(out) == [("a", "1;2", 3), ("b", "", 1)]


def test_asof_join_buckets_agree(spark):
    left = spark.createDataFrame([("k", t, i) for i, t in enumerate(range(0, 100, 7))] + [("z", 5, 99)], "key string, at long, i long")
    right = spark.createDataFrame([("k", t, t * 10) for t in range(3, 100, 20)], "key string, at long, v long")
    plain = rows(relational.asof_join(left, right, "key", "at", ["v"]))
    assert plain == rows(relational.asof_join(left, right, "key", "at", ["v"], bucket=F.floor(F.col("_at") / 10)))
    assert all(v is None if t < 3 or k == "z" else v == (3 + (t - 3) // 20 * 20) * 10 for k, t, i, m, v in plain)


CASES = [
    ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("-2 + 5 % 3", 0.0), ("sqrt 16 + abs -2", 6.0), ("3 max 4 min 2", 3.0), ("sin (pi / 2)", 1.0), ("round 2.5", 3.0),
    ("round -2.5", -3.0), ("trunc -2.7", -2.0), ("log 1000", 3.0), ("5 clamp [1, 3]", 3.0), ("parseNumber ' 4.5 '", 4.5), ("parseNumber 'x'", 0.0), ("vectorMagnitude [3, 4]", 5.0),
    ("[5, 6, 7] select 1", 6.0), ("count [1, 2, 3]", 3.0), ("1 < 2 && !(3 == 4)", True), ("2 in [1, 2]", True), ("'abc' find 'c'", 2.0), ("toUpper 'ab'", "AB"), ("isNil nil", True), ("1 / 0", None),
]


@pytest.mark.parametrize(("expression", "want"), CASES)
def test_script_both_ways(spark, expression, want):
    got = script.evaluate(expression)
    via = spark.range(1).select(script.column(expression, {}).alias("v")).first()[0]
    for v in (got, via):
        assert v == want or (isinstance(want, float) and math.isclose(float(v), want, abs_tol=1e-9)), (expression, v)


def test_script_errors_and_column(spark):
    for bad in ("1 +", "(1", "1 2", "§"):
        with pytest.raises(script.ScriptError):
            script.parse(bad)
    df = spark.createDataFrame([("1 + 1",), ("1 +",), (None,)], "e string")
    assert [r[0] for r in df.select(script.evaluate_column(F.col("e"))).collect()] == ["2.0", None, None]


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.integers(0, 99).map(float), lambda x: st.tuples(x, st.sampled_from("+-*"), x), max_leaves=8))
def test_script_arithmetic(tree):
    def text_of(t):
        return repr(t) if isinstance(t, float) else f"({text_of(t[0])} {t[1]} {text_of(t[2])})"

    assert math.isclose(script.evaluate(text_of(tree)), eval(text_of(tree)), rel_tol=1e-12, abs_tol=1e-9)


def test_value_operators(spark):
    cases = [
        ("5", "set", "9", "9"), ("true", "toggle", "", "false"), ("x", "toggle", "", "true"), ("5", "inc", "2", "7"), ("x", "add", "2", "2"), ("5", "sub", "0.5", "4.5"), ("5", "mul", "2", "10"), ("5", "div", "0", "0"),
        ("7", "mod", "4", "3"), ("a", "cat", "b", "ab"), (None, "default", "z", "z"), ("", "default", "z", "z"), ("2.345", "round", "1", "2.3"), ("50", "clamp", "1|10", "10"), ("5", "negate", "", "-5"),
        ("aab", "replace", "a|x", "xxb"), ("7", "format", "<%1>", "<7>"), ("7", "unknown", "1", "7"),
    ]
    df = spark.createDataFrame(cases, "v string, op string, arg string, want string")
    out = df.withColumn("got", boards.apply_operator(F.col("v"), F.col("op"), F.col("arg")))
    assert [(r.op, r.got) for r in out.collect() if r.got != r.want] == []


def test_csv_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", 1.5, ["x", "y"]), (2, None, None, None), (3, "", 0.0, [])], "i long, s string, d double, l array<string>")
    text.write_csv(df.drop("l"), str(tmp_path / "c"), null_value="NULL")
    assert rows(text.read_csv(spark, str(tmp_path / "c"), df.drop("l").schema, "NULL")) == rows(df.drop("l"))
    name, back = text.from_json_document(spark, json.dumps(text.json_document("t", df, ["i"])))
    assert name == "t" and rows(back) == rows(df)


def test_store_round_trip(spark, tmp_path):
    s = Session(spark)
    s.run("CREATE TABLE keep (id INT PRIMARY KEY, t TEXT DEFAULT 'q', CHECK (id > 0)); INSERT INTO keep (id) VALUES (1), (2); CREATE TABLE none (a INT); CREATE VIEW kv AS SELECT count(*) AS n FROM keep")
    path = str(tmp_path / "db")
    store.save(s, path)
    store.save(s, path)
    t = Session(spark)
    (tmp_path / "db" / "_meta.json").write_text("broken")
    store.load(t, path)
    assert rows(t.table("keep")) == [(1, "q"), (2, "q")] and t.table("none").count() == 0
    assert t.sql("SELECT n FROM kv").first()[0] == 2 and t.state.meta["keep"].checks == s.state.meta["keep"].checks
    again = Session(spark)
    again.state.tables.clear()
    again.run("\n".join(x for x in store.dump(s)).replace("CREATE VIEW", "CREATE OR REPLACE VIEW"))
    assert rows(again.table("keep")) == [(1, "q"), (2, "q")]
    with pytest.raises(PermissionError):
        store.guarded(str(tmp_path), "../x")
    store.export(s.table("keep"), str(tmp_path), "out/k", "parquet")
    assert spark.read.parquet(str(tmp_path / "out/k")).count() == 2


def test_array_literals(spark):
    df = spark.createDataFrame([("[1,'a',nil]",), ("[1,",), (None,)], "t string")
    assert [r.j for r in text.literal_to_json(df, "t", "j").collect()] == ['[1, "a", null]', None, None]


def test_host_commands_give_their_first_operand():
    assert script.evaluate("diag_log 5") == 5 and script.evaluate("3 setDamage 4") == 3 and script.evaluate("allPlayers") is None
    assert script.evaluate("diag_log (2 + 3) * 2") == 10 and script.evaluate("hint sqrt 9") == 3
