"""The pipeline's stages, each held against its operator on its own input, and its SQL-expressible parts against DuckDB."""

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")
common = pytest.importorskip("plumbline.llm.common")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        before, rows = {r["doc_id"]: r for r in docs.collect()}, after.collect()
        assert 0 < len(rows) <= len(before) and all(before[r["doc_id"]] == r for r in rows)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]["text"] or ""), i)
            assert {r["doc_id"] for r in rows} == set(first.values())
        docs = spark.createDataFrame(rows, docs.schema)
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_is_the_stages_in_turn(spark):
    got = pipeline.run(spark, SF).toPandas()
    assert len(got) and not got.duplicated(["doc_id", "piece"]).any() and got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "near_dedup", "packing"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_oracle_sql(spark):
    names = [n for n in entry.oracle_sql() if n.startswith("op")]
    assert names
    for name in names:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name]).df()
        got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
        key = list(want.columns)
        assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_stages_that_drop_rows_leave_texts_where_they_stand(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.randbytes(3).hex() for _ in range(3000)) for _ in range(200)]
    texts += texts[:10] + [t + " end" for t in texts[10:20]] + ["few words"] * 5
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    size, shared = sum(map(len, texts)), Path(common.shared_dir(spark).removeprefix("file:"))
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    written = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    want = {"quality_rules": 220, "toxicity": 220, "exact_dedup": 210, "near_dedup": 200}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        before = moved(), written()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == want[name], name
        assert moved() - before[0] < 0.25 * size and written() - before[1] < 0.25 * size, name


def test_rows_are_numbered_and_told_apart_alike_in_each_scan(spark, tmp_path):
    ids = spark.range(0, 100_000, 1, 5).withColumn("text", F.col("id").cast("string"))
    ids.write.parquet(str(tmp_path / "a b%20c"))
    read = spark.read.parquet(str(tmp_path / "a b%20c"))
    for docs in (read, spark.createDataFrame(read.limit(1000).collect(), read.schema)):
        at = common.placed(docs, "row")
        assert at.columns == ["id", "text", "row"]
        rows = {r["id"]: r["row"] for r in at.collect()}
        assert len(set(rows.values())) == len(rows) == docs.count() and min(rows.values()) >= 0
        assert {r["id"]: r["row"] for r in at.select("row", "id").repartition(7).collect()} == rows
        listed = at.filter("id % 7 = 3 or id between 40 and 90").select("row")
        of = {i for i in rows if i % 7 == 3 or 40 <= i <= 90}
        assert {r["id"] for r in common.only_rows(at, "row", listed).collect()} == of
        assert {r["id"] for r in common.without_rows(at, "row", listed).collect()} == set(rows) - of
        assert common.without_rows(at, "row", listed.limit(0)).count() == len(rows) and common.only_rows(at, "row", listed.limit(0)).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, tmp_path):
    text = " ".join(random.Random(4).randbytes(3).hex() for _ in range(15_000))
    spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = lambda batches: (b["text"].str.len().agg(["sum"]).to_frame("n").astype("int64") for b in batches)
    for name in ("toxicity", "near_dedup", "packing"):
        own = spark.newSession()
        docs = own.read.parquet(str(tmp_path / "documents.parquet"))
        dict(pipeline.STAGES)[name](own, docs, str(tmp_path))
        assert max(r["n"] for r in docs.select("text").mapInPandas(sizes, "n long").collect()) <= common.BATCH_BYTES + len(text), name
    own = spark.newSession()
    own.conf.set(common.BATCH_SETTING, "1m")
    common.small_batches(own)
    assert own.conf.get(common.BATCH_SETTING) == "1m"


def test_a_worker_gives_its_free_memory_back():
    anonymous = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) // 1024
    seen = []

    def rows():
        between = []  # what is still needed stands between what is not
        texts = [(bytes(100_000), between.append(bytes(1000))) for _ in range(1000)]
        yield len(texts)
        del texts
        seen.extend([anonymous(), between])

    assert list(common.memory_back(rows())) == [1000]
    assert anonymous() < seen[0] - 50


def test_training_texts_do_not_come_to_the_driver(spark, monkeypatch):
    toxicity = pytest.importorskip("plumbline.llm.toxicity")
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["good", "plain", "word", "bad" if i % 2 else "fine"]) for _ in range(20)), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    used = {r["doc_id"] for r in docs.filter(~toxicity.is_held_out(F.col("doc_id"))).collect()}
    own = [r for r in rows if r[0] in used]
    want = toxicity.train([toxicity.words_of(r[1]) for r in own], np.array([r[2] for r in own]), sum(r[2] for r in own) / len(own), rounds=6)
    net, here = toxicity.fit(docs, docs.select("doc_id", "toxic")), []
    texts = [r[1] for r in rows]
    assert np.allclose(toxicity.scores_of(texts, net), toxicity.scores_of(texts, want), atol=1e-3)
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: here.append(a))
    assert toxicity.fit(docs, docs.select("doc_id", "toxic")) is None and not here
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic")) is None


def test_small_graphs_are_read_in_few_tasks_where_shuffles_have_many(spark, monkeypatch):
    module = pytest.importorskip("plumbline.llm.components")
    own, parts, plain = spark.newSession(), [], module.unestimated
    own.conf.set("spark.sql.shuffle.partitions", "50")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(module, "unestimated", lambda df: parts.append(df.rdd.getNumPartitions()) or plain(df))
    links = own.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {tuple(r) for r in module.components(links).collect()} == {(i, 0) for i in range(10)}
    assert parts and max(parts) <= common.parts_for(own, 18)
