import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions import money
from plumbline.functions.hashing import fnv1a, fnv1a_mod
from plumbline.functions.text import exact_match, redact_userinfo
from plumbline.operators import value
from plumbline.operators.value import controls, t_quantile
from plumbline.sources import agent_ref, cases, tree_hash
from plumbline.sources.cases import SplitCounts, holdout_fraction, split_of


def test_hash_and_split(spark):
    ids = ["", "a", "case-000", "ünïcødé", "3f2504e0-4f89-11d3-9a0c-000000000001", "x" * 300, None]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", fnv1a_mod(F.col("id"), 10_000).alias("plain"), fnv1a_mod(F.col("id"), 1000, "s").alias("seeded")).collect()
    for row in rows:
        data = (row["id"] or "").encode()
        assert row["plain"] == fnv1a(data) % 10_000
        assert row["seeded"] == fnv1a(data + b"\0s") % 1000
    golden = spark.range(50).select(F.format_string("case-%03d", "id").alias("id")).select(split_of(F.col("id")).alias("s"))
    assert golden.filter("s = 'HOLDOUT'").count() == 6


def test_fractions():
    assert holdout_fraction(0) == 0.2
    for bad in (-0.1, 1.0):
        with pytest.raises(errors.Actionable):
            holdout_fraction(bad)
    for dev, held in ((0, 0), (5, 0), (0, 5)):
        with pytest.raises(errors.Actionable):
            SplitCounts(dev, held).check()
    assert SplitCounts(44, 6).underpowered and not SplitCounts(100, 20).underpowered


def test_money(spark):
    shown = spark.createDataFrame([(0,), (-1_239_999,), (5_000_000,), (999,)], "m long").select(money.display_usd(F.col("m")).alias("s")).collect()
    assert [r["s"] for r in shown] == ["$0.00", "-$1.23", "$5.00", "$0.00"] == [money.show_usd(m) for m in (0, -1_239_999, 5_000_000, 999)]
    cost = lambda rate, n: spark.range(1).select(money.cost_per_mtok(F.lit(rate).cast("long"), F.lit(n).cast("long")).alias("c")).first()["c"]
    assert cost(1_000_000, 1) == 1 and cost(3, 1) == 1 and cost(0, 5) == 0 and cost(5, -1) == 0
    assert cost((1 << 63) - 1, (1 << 63) - 1) == (1 << 63) - 1


@pytest.mark.parametrize(("text", "real"), [("SGVsbG8gV29ybGQhIFRoaXMgaXMgYQ==" * 25, 546), ("a3f9c2e18b7d4056" * 50, 448), ("3f2504e0-4f89-11d3-9a0c-0305e82c3301\n" * 40, 759), ('{"id":1,"name":"x","v":[1,2,3]},' * 75, 1142), ("How do I get a refund for my order? " * 10, 101)])
def test_token_estimate_is_pessimistic(spark, text, real):
    n = spark.range(1).select(money.estimate_tokens(F.lit(len(text.encode())), F.lit("gpt-5.6-luna")).alias("n")).first()["n"]
    assert real <= n <= 6 * real


def test_prices(spark):
    calls = spark.createDataFrame([("anthropic", "claude-opus-4-8-x"), ("openai", "gpt-5.6-luna"), ("openai", "nope")], "scheme string, model string")
    rows = {r["model"]: r for r in money.with_price(calls, money.prices(spark), "scheme", "model").collect()}
    assert rows["claude-opus-4-8-x"]["price_key"] == "claude-opus-4-8"
    assert rows["gpt-5.6-luna"]["cache_write_per_mtok_usd_micros"] is None and rows["gpt-5.6-luna"]["input_per_mtok_usd_micros"] == 200_000
    assert rows["nope"]["price_key"] is None


def test_exact_match(spark):
    rows = spark.createDataFrame([("a", "a"), (" A \n", "a"), (None, ""), ("a", None)], "o string, e string")
    got = rows.select(exact_match(F.col("o"), F.col("e")).alias("s"), exact_match(F.col("o"), F.col("e"), trim=True, ignore_case=True).alias("r")).collect()
    assert [(r["s"], r["r"]) for r in got] == [(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_t_quantile():
    assert t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    assert t_quantile(0.975, 10) == pytest.approx(2.22814, abs=1e-4)
    assert t_quantile(0.975, 1000) == pytest.approx(1.96234, abs=1e-4)


ACCEPTED = [
    ("openai:gpt-4.1", "openai", "gpt-4.1", ""), ("fake:", "fake", "", ""), ("openai:llama3:8b", "openai", "llama3:8b", ""), ("openai:my-model@v2", "openai", "my-model@v2", ""), ("  OpenAI:gpt-4.1  ", "openai", "gpt-4.1", ""),
    ("openai:m@https://API.example.com:443/v1//", "openai", "m", "https://api.example.com/v1"), ("openai:llama3:8b@http://localhost:11434/v1", "openai", "llama3:8b", "http://localhost:11434/v1"), ("exec:own-agent", "exec", "own-agent", ""), ("tuned:job-1", "tuned", "job-1", ""),
]


@pytest.mark.parametrize("row", ACCEPTED)
def test_agent_refs(row):
    ref = agent_ref.parse(row[0])
    assert (ref.scheme, ref.target, ref.base_url) == row[1:]
    assert agent_ref.parse(str(ref)) == ref


@pytest.mark.parametrize(("text", "why"), [("", "empty"), ("   ", "empty"), ("gpt-4.1", "no scheme"), ("opeani:x", "unknown scheme"), ("openai:", "no model"), ("openai:   ", "no model"), ("https://api.example.com/v1", "bare URL"), ("openai:m@https://", "no host"), ("openai:m@https://u:p@h/v1", "credentials"), ("openai:a\x00b", "control")])
def test_agent_refusals(text, why):
    with pytest.raises(errors.Actionable, match=why) as caught:
        agent_ref.parse(text)
    assert "u:p" not in str(caught.value)


def test_redaction(spark):
    assert spark.range(1).select(redact_userinfo(F.lit("see http://u:p@h/x ok")).alias("t")).first()["t"] == "see http://[redacted]@h/x ok"


@pytest.mark.parametrize("n", [3, 40])
def test_controls_step_over_an_assets_own_cases(spark, n):
    cases = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    wide = cases.filter("id not in ('7', '1234', '2999', '15', '16')").select(F.lit("wide").alias("asset_id"), F.col("id").alias("case_id"))
    narrow = cases.filter("id % 3 = 0").select(F.lit("narrow").alias("asset_id"), F.col("id").alias("case_id"))
    rows = [tuple(r) for r in wide.unionByName(narrow).collect()]
    got = controls(cases, wide.unionByName(narrow), n).collect()
    order = sorted((str(i) for i in range(3000)), key=lambda i: (fnv1a(i.encode() + b"\0control") % 10_000, i))
    for asset in ("wide", "narrow"):
        own = {c for a, c in rows if a == asset}
        assert sorted(r["case_id"] for r in got if r["asset_id"] == asset) == sorted([i for i in order if i not in own][:n])
    assert controls(cases, wide.limit(0), n).count() == 0


def test_t_quantiles_are_those_of_the_tables():
    for df, want in ((1, 12.706205), (2, 4.302653), (3, 3.182446), (5, 2.570582), (10, 2.228139), (30, 2.042272), (200, 1.971896)):
        assert abs(value.t_quantile(0.975, df) - want) < 1e-6
    z = 1.959963984540054
    assert abs(z + sum(c / 200**k for k, c in enumerate(value.t_expansion(z), 1)) - value.t_quantile(0.975, 200)) < 1e-8


def test_tree_hash_is_the_same_however_rows_are_dealt_and_finds_what_changed(spark):
    rows = [(i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "i long, t string")
    trees = [tree_hash.tree(x, ["i"], F.col("t"), 4) for x in (df, df.repartition(7), df.coalesce(1))]
    assert len({tree_hash.root(t) for t in trees}) == 1
    level, n = [hashlib.sha256(t.encode()).hexdigest() for _, t in rows], 0
    while len(level) > 1:
        level, n = [hashlib.sha256("".join(level[i:i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)], n + 1
    assert tree_hash.root(trees[0]) == level[0] and trees[0].agg(F.max("level")).first()[0] == n
    other = tree_hash.tree(df.withColumn("t", F.when(F.col("i").isin(5, 77), "new").otherwise(F.col("t"))), ["i"], F.col("t"), 4)
    assert [r["node"] for r in tree_hash.changed(trees[0], other, 4).orderBy("node").collect()] == [5, 77]
    longer = tree_hash.tree(spark.createDataFrame([*rows, *[(100 + i, "x") for i in range(200)]], "i long, t string"), ["i"], F.col("t"), 4)
    assert {r["node"] for r in tree_hash.changed(trees[0], longer, 4).collect()} == set(range(100, 300))
    assert tree_hash.changed(trees[0], trees[1], 4).isEmpty() and tree_hash.root(tree_hash.tree(df.limit(0), ["i"], F.col("t"))) == ""


def test_content_hash_is_of_the_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("x\ny\n")
    first = cases.JsonLines(spark, str(path)).content_hash()
    assert cases.JsonLines(spark, str(path)).content_hash() == first != cases.JsonLines(spark, str(path), seed="s").content_hash()
    path.write_text("x\nz\n")
    assert cases.JsonLines(spark, str(path)).content_hash() != first
