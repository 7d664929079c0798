"""The plan: JSON, check, compile, lineage; relational edge cases; types and transforms."""

import pytest
from pyspark.sql import functions as F

from millrace.control.lineage import LineageStore
from millrace.functions import types as T
from millrace.functions.transforms import TransformChain, trim_whitespace
from millrace.operators import infer as I
from millrace.operators import quality as Q
from millrace.operators import relational as R
from millrace.plans.check import PlanChecker, parse_condition
from millrace.plans.compile import Compiler, PlanError
from millrace.plans.ir import Aggregate, Aggregation, Cast, Filter, Join, JoinKey, Map, Pipeline, Source, Union, WindowStep


def frames(spark):
    return {
        "a": spark.createDataFrame([("1", "x", None), ("2", None, 5), ("oops", "x", 7)], "id string, s string, n bigint"),
        "b": spark.createDataFrame([("x", "first"), ("x", "second"), (None, "none")], "k string, v string"),
    }


def plan(*steps):
    return Pipeline("p", [Source("a", "given", ""), Source("b", "given", "")], list(steps))


def test_round_trip_and_text():
    p = plan(Filter("f", "a", "s == 'x'"), Join("j", "f", "b", [JoinKey("s", "k", {"x": "x"})]), WindowStep("w", "f", order_by=["id"]), Aggregate("g", "f", ["s"], [Aggregation("sum", "n", "t")]))
    assert Pipeline.from_json(p.to_json()).to_json() == p.to_json()
    assert p.pseudocode().count("\n") == 6
    with pytest.raises(ValueError):
        Pipeline.from_json('{"name": "x", "steps": [{"op": "Explode", "output": "y"}]}')


def test_all_seven_steps_run_out_of_order(spark):
    p = plan(
        Aggregate("g", "u", ["s"], [Aggregation("count", "*", "rows")]), Union("u", ["c", "m"]), Map("m", "c", transform="prefix_id", field="id", params={"prefix": "p"}), Cast("c", "f", "n", "Double"),
        Filter("f", "a", "s != 'y'"), Join("j", "f", "b", [JoinKey("s", "k")]), WindowStep("w", "f", order_by=["n"]),
    )
    lineage = LineageStore()
    out = Compiler(spark).compile(p, frames(spark), lineage)
    assert {r.s: r.rows for r in out["g"].collect()} == {"x": 4, None: 2}
    assert out["j"].columns == ["record", "matched"]
    assert ("a", "id") in lineage.source_fields("u", "id")
    assert ("a", "s") in lineage.source_fields("j", "record") and ("b", "v") in lineage.source_fields("j", "matched")


def test_errors_come_before_any_data(spark):
    c = Compiler(spark)
    for step in (Filter("f", "ghost", "x == '1'"), Cast("c", "a", "n", "Money"), Map("m", "a", mapper="none"), Aggregate("g", "a", ["zzz"], []), Join("j", "a", "b", [JoinKey("s", "k")], "cross"), WindowStep("w", "a", order_by=[])):
        with pytest.raises(PlanError):
            c.compile(plan(step), frames(spark))
    with pytest.raises(PlanError):
        c.compile(plan(Filter("x", "y", "a == '1'"), Filter("y", "x", "a == '1'")), frames(spark))
    found = PlanChecker({"a": frames(spark)["a"].schema, "b": frames(spark)["b"].schema}).check(plan(Join("j", "a", "b", [JoinKey("n", "k")])))
    assert found.ok and found.warnings


@pytest.mark.parametrize("text, want", [("s == 'x==y'", ("s", "==", "x==y")), ("a != 'x'", ("a", "!=", "x")), ("a == 1", ("a", "==", "1")), ("a == 'x' AND b == 'y'", None), ("a > 3", None), ("a != 'x==y'", ("a", "!=", "x==y"))])
def test_conditions(text, want):
    assert parse_condition(text) == want


def test_joins_keep_every_rule(spark):
    f = frames(spark)
    keys = [JoinKey("s", "k")]
    assert R.join_frames(f["a"], f["b"], keys).count() == 5
    assert R.join_frames(f["a"], f["b"], keys, null_safe=True).filter("v = 'none'").count() == 1
    assert R.join_frames(f["a"], f["b"], keys, "full", "nested").filter("record IS NULL").count() == 1
    first = R.join_frames(f["a"], f["b"], keys, shape="nested", one_to_many=False, order_by="v")
    assert {r.matched.v for r in first.collect() if r.matched} == {"first"}
    two = R.join_frames(f["a"], f["b"].withColumn("id", F.lit("1")), [JoinKey("s", "k"), JoinKey("id", "id")])
    assert two.filter("v IS NOT NULL").count() == 2 and "right_id" in two.columns
    mapped = R.join_frames(f["a"], f["b"], [JoinKey("s", "k", {"x": "nosuch"})], shape="nested").collect()
    assert all(r.matched == [] for r in mapped) and {r.matched_category for r in mapped} == {"nosuch", None}


def test_cast_counts_failures(spark):
    a = frames(spark)["a"]
    assert [r.id for r in R.cast_column(a, "id", "Integer").collect()] == [1, 2, None]
    assert R.cast_failures(a, "id", "Integer").first().asDict() == {"field": "id", "n_values": 3, "n_failed": 1}


def test_union_checks(spark):
    f = frames(spark)
    with pytest.raises(R.SchemaMismatchError):
        R.union_frames(f)
    assert R.check_union({"a": f["a"]}) == []
    rows = spark.createDataFrame([("1", "t", "s1"), ("1", "t", "s2"), ("2", "o", "s1")], "case_id string, subject string, source_system string")
    flags = R.duplicate_flags(rows).collect()
    assert len(flags) == 1 and flags[0].sources == ["s1", "s2"]


def test_chain(spark):
    df = spark.createDataFrame([("  hello  ", ""), ("world", "text"), ("   ", None)], "name string, d string")
    chain = TransformChain().add("name", "trim_whitespace").add("d", "empty_to_none").add("new", "empty_to_none")
    assert [tuple(r) for r in chain.apply(df).collect()] == [("hello", None, None), ("world", "text", None), ("", None, None)]
    assert len(chain.preview_all(df)) == 3
    with pytest.raises(IndexError):
        chain.apply(df, 3)
    with pytest.raises(ValueError):
        chain.add("x", "nothing")
    assert [s.output for s in chain.plan_steps("in", "out")] == ["in_step_0", "in_step_1", "out"]
    assert spark.createDataFrame([("　a ",)], "s string").select(trim_whitespace(F.col("s"))).first()[0] == "a"


def test_types():
    reg = T.TypeRegistry()
    assert reg.version == 1 and len(reg.snapshot()) == 7
    assert reg.register(T.enum_type("Level", ["low", "high"])) == 2
    assert "Level" not in reg.snapshot(1) and "Level" in reg
    with pytest.raises(ValueError):
        reg.register(T.enum_type("Level", []))
    s = T.SCHEMAS["SupportCase"]
    assert T.Schema.from_struct(s.name, s.struct(), s.key) == s


def test_quality(spark):
    rows = spark.createDataFrame([("r1",), ("r2",), ("r1",), ("r3",), ("r2",)], "a string")
    assert Q.duplicate_rate(rows).first().asDict() == {"total_rows": 5, "unique_rows": 3, "duplicate_rows": 2, "duplicate_rate": 0.4}
    assert Q.null_rates(rows.limit(0)).count() == 0
    schema = T.SCHEMAS["JoinedCaseOutput"]
    make = lambda rs: spark.createDataFrame(rs, schema.struct().fieldNames() and "case_id string, subject string, ticket_type string, matched_category string, matched_article_count bigint, source_system string")
    assert Q.check_contract(make([("1", "s", None, None, 0, "x")]), schema).satisfied
    assert [v["kind"] for v in Q.check_contract(make([]), schema).violations] == ["empty_output"]
    kinds = {v["kind"] for v in Q.check_contract(make([("1", None, None, None, 0, "x"), ("1", "s", None, None, 0, "x")]), schema).violations}
    assert kinds == {"missing_required", "null_violation", "duplicate_key"}
    assert Q.check_contract(make([("1", "s", None, None, 0, "x")]), schema, previous=T.Schema("old", (T.Field("gone", "String", required=True),))).warnings


def test_inference(spark):
    left = spark.createDataFrame([(str(i),) for i in range(1, 11)], "product_id string")
    right = spark.createDataFrame([(str(p), str(i)) for i, p in enumerate([1, 1, 1, 2, 2, 3, 3, 3, 3, 4], 1)], "product_id string, product_variation_id string")
    found = I.infer_joins(left, ["product_id"], right, ["product_id", "product_variation_id"])
    assert [(f["right"], f["confidence"]) for f in found] == [("product_variation_id", 0.85), ("product_id", 0.61)]
    assert found[1]["note"].startswith("WARNING") and found[0]["is_unique_key"]
    assert I.route("join", 1.0) == "review" and I.route("mapping", 0.85) == "auto" and I.route("source", 0.1) == "auto"
    kinds = spark.createDataFrame([("1", "1.5", "hello", "0", None), ("2", "2.5", "2018-01-01", "1", "")], "a string, b string, c string, d string, e string")
    assert {r.field_name: r.type_name for r in I.infer_types(kinds).collect()} == {"a": "Integer", "b": "Double", "c": "Timestamp", "d": "Boolean", "e": "String"}
