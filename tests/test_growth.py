"""Steps whose work must grow with the rows: what a plan does once, and which way its frames grow."""

from pyspark.sql import functions as F

from tidemark.operators import samples as P


def test_the_first_price_after_is_found_by_a_growing_frame(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 0, 30), (4, 1, 5)], "id int, g int, at int")
    right = spark.createDataFrame([(0, 10, 1.0), (0, 20, None), (0, 25, 3.0), (0, 25, 2.0), (1, 5, 9.0)], "g int, at int, price double")
    x = P.asof_forward(left, right, ["g"], "at", "at", "price")
    assert {r.id: r.next_price for r in x.collect()} == {1: 2.0, 2: 2.0, 3: None, 4: None}
    assert "unboundedfollowing" not in x._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_record_is_parsed_and_typed_once(spark):
    raw = spark.createDataFrame([('{"a": " ", "b": "1.5"}',), ('{"a": "x", "b": "1e3"}',), ("none",)], "record string")
    good, bad = P.decode(raw, {"a": "text", "b": "number"})
    assert [tuple(r) for r in good.collect()] == [("x", 1000.0)]
    assert {r.record: r.wrong for r in bad.collect()} == {'{"a": " ", "b": "1.5"}': "a", "none": "a,b"}
    for x in (good, bad, good.select(F.col("b") * 2)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("try_cast") <= 3


def test_resamples_hash_an_id_in_a_batch_not_by_text_functions(spark):
    import hashlib

    from tidemark.operators import validation as V

    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 5.0), (None, 2, 3.0), ("a", 3, None)], "form string, id int, v double")
    x = V.resample_sums(rows, ["form"], "v", ["id"], 11, "s")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and plan.count("Generate") == 0
    draw = lambda n, i: int(hashlib.md5(f"s:{n}:{i // 8}".encode()).hexdigest()[4 * (i % 8) :][:4], 16)
    weight = lambda n, i: sum(draw(n, i) >= t for t in V.POISSON)
    want = {(f, i): (weight(n, i), weight(n, i) * v) for f, n, v in (("a", 1, 2.0), ("b", 1, 5.0), (None, 2, 3.0)) for i in range(11)}
    assert {(r.form, r.i): (r.weight, r.total) for r in x.collect()} == want


def test_facts_join_judgements_before_their_nodes_are_laid_out(spark):
    from tidemark.operators import rules as R

    trace = "trace array<struct<node:string,branch:string,facts:array<string>>>"
    prices = {p: None for p in R.PRICES}
    row = {"id": 1, "diagnosed": True, "decided": True, "regime": "spike", "alternative_regime": None, "direction": "bullish", "gate_result": "proceed", "confidence": 1.0, "stance": "wait", **prices, "active_entry": 100.0, "take_profit": 500.0}
    row["trace"] = [("D1", "a", ["F1", "F2", "F8"]), ("D2", "spike", [None, "F1"]), ("D3", "bullish", ["F1"]), ("D4", "b", ["F1"])]
    kind = "id int, diagnosed boolean, decided boolean, regime string, alternative_regime string, direction string, gate_result string, confidence double, stance string, " + ", ".join(f"{p} double" for p in R.PRICES)
    j = spark.createDataFrame([row], f"{kind}, {trace}")
    facts = spark.createDataFrame([(1, "F1", 100.0), (1, "F2", None), (1, "F2", None)], "id int, fact_id string, fact double")
    cited = spark.createDataFrame([(1, "F1", 100.1)], "id int, fact_id string, value double")
    x = R.judgement_errors(j, cited, facts, "id")
    assert sorted(r.code for r in x.collect()) == ["UNANCHORED_PRICE"] + ["UNKNOWN_FACT"] * 4
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
