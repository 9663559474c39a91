"""Sources of cases and assets. A source is validated as a whole before a row of it is used; the first bad record, by line, is the error."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import errors, schemas
from plumbline.functions.hashing import fnv1a_mod
from plumbline.sources import tree_hash

DEFAULT_HOLDOUT, BUCKETS, UNDERPOWERED = 0.2, 10_000, 20
MAX_RECORD_BYTES = 4 << 20


class Cases(Protocol):
    def cases(self) -> DataFrame: ...


class Pool(Protocol):
    def assets(self) -> DataFrame: ...


def holdout_fraction(fraction: float) -> float:
    """0 stands for the default; anything outside [0, 1) is refused."""
    if not 0 <= fraction < 1:
        raise errors.INVALID_INPUT(f"the holdout fraction {fraction} is not in [0, 1)")
    return fraction or DEFAULT_HOLDOUT


def split_of(case_id: Column, *, seed: str = "", fraction: float = 0.0) -> Column:
    """HOLDOUT for a share of ids that the id itself decides, else DEV; growth of a source moves no case."""
    share = holdout_fraction(fraction)
    return F.when(fnv1a_mod(case_id, BUCKETS, seed).cast("double") < F.lit(share * BUCKETS), "HOLDOUT").otherwise("DEV")


@dataclass(frozen=True)
class SplitCounts:
    dev: int
    holdout: int

    @property
    def underpowered(self) -> bool:
        return 0 < self.holdout < UNDERPOWERED

    def check(self, fraction: float = 0.0) -> None:
        """Both sides must have cases before anything is spent."""
        if not self.dev + self.holdout:
            raise errors.INVALID_INPUT("the source has no cases")
        if not self.holdout:
            raise errors.INVALID_INPUT("no case fell into the holdout", f"add cases, {int(1 / holdout_fraction(fraction)) + 1} or more")
        if not self.dev:
            raise errors.INVALID_INPUT("every case fell into the holdout", "lower the holdout fraction")


def count_splits(cases: DataFrame) -> SplitCounts:
    row = cases.agg(F.count_if(F.col("split") == "HOLDOUT").alias("h"), F.count("*").alias("n")).first()
    return SplitCounts(row["n"] - row["h"], row["h"])


def record_problem(value: Column, record: Column) -> Column:
    """Why a line is no record, or null; strict where from_json is lenient. value: the line, record: from_json of it."""
    keys = F.json_object_keys(value)
    allowed = F.array(*[F.lit(n) for n in schemas.RECORD.names])
    unknown = F.array_except(keys, allowed)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(F.octet_length(value) > MAX_RECORD_BYTES, F.lit(f"a record is larger than {MAX_RECORD_BYTES} bytes"))
        .when(keys.isNull(), F.lit("not a JSON object"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")))
        .when(record.isNull(), F.lit("not a record"))
        .when(empty(record["id"]), F.lit("has no id"))
        .when(empty(record["input"]), F.lit("has no input"))
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """lines (line, value) to line, record fields and problem; blank lines are no records but count as lines."""
    text = F.regexp_replace("value", "\r$", "")
    parsed = lines.select("line", text.alias("value")).filter(F.length(F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))) > 0)
    parsed = parsed.withColumn("record", F.from_json("value", schemas.RECORD.simpleString()))
    return parsed.select("line", record_problem(F.col("value"), F.col("record")).alias("problem"), "record.*")


def first_problem(records: DataFrame) -> tuple[int, str] | None:
    """The lowest line with a problem; a repeated id is one, at its second place."""
    again = Window.partitionBy("id").orderBy("line")
    own = records.filter(F.col("problem").isNotNull()).select("line", "problem")
    repeated = records.filter(F.col("problem").isNull()).withColumn("nth", F.row_number().over(again)).filter("nth > 1").select("line", F.concat(F.lit("duplicate case id "), "id").alias("problem"))
    row = own.unionByName(repeated).orderBy("line").first()
    return (row["line"], row["problem"]) if row else None


class JsonLines:
    """One JSON object on each line of a file: id, input and, if wanted, expected, rubric, tags."""

    def __init__(self, spark: SparkSession, path: str, *, seed: str = "", fraction: float = 0.0) -> None:
        self.spark, self.path, self.seed, self.fraction = spark, path, seed, holdout_fraction(fraction)
        self._kept: DataFrame | None = None

    def _read(self) -> DataFrame:
        """Each line with its file, the start of its stretch of the file, and its place in the scan; written once, since
        another scan may put the stretches in another order."""
        if self._kept is None:
            stretch = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
            self._kept = durable(self.spark.read.option("lineSep", "\n").text(self.path).select("value", *stretch).withColumn("at", F.monotonically_increasing_id()))
        return self._kept

    def lines(self) -> DataFrame:
        """Numbered from 1, by file and then by line; a stretch of a file is read by one task, so a number for each is enough."""
        own, raw = ["file_path", "file_block_start"], self._read()
        sizes = raw.groupBy(*own).agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each stretch
        return raw.join(sizes.select(*own, "first", before.alias("before")), own).select((F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")

    def cases(self) -> DataFrame: ...


class Pool(Protocol):
    def assets(self) -> DataFrame: ...


def holdout_fraction(fraction: float) -> float:
    """0 stands for the default; anything outside [0, 1) is refused."""
    if not 0 <= fraction < 1:
        raise errors.INVALID_INPUT(f"the holdout fraction {fraction} is not in [0, 1)")
    return fraction or DEFAULT_HOLDOUT


def split_of(case_id: Column, *, seed: str = "", fraction: float = 0.0) -> Column:
    """HOLDOUT for a share of ids that the id itself decides, else DEV; growth of a source moves no case."""
    share = holdout_fraction(fraction)
    return F.when(fnv1a_mod(case_id, BUCKETS, seed).cast("double") < F.lit(share * BUCKETS), "HOLDOUT").otherwise("DEV")


@dataclass(frozen=True)
class SplitCounts:
    dev: int
    holdout: int

    @property
    def underpowered(self) -> bool:
        return 0 < self.holdout < UNDERPOWERED

    def check(self, fraction: float = 0.0) -> None:
        """Both sides must have cases before anything is spent."""
        if not self.dev + self.holdout:
            raise errors.INVALID_INPUT("the source has no cases")
        if not self.holdout:
            raise errors.INVALID_INPUT("no case fell into the holdout", f"add cases, {int(1 / holdout_fraction(fraction)) + 1} or more")
        if not self.dev:
            raise errors.INVALID_INPUT("every case fell into the holdout", "lower the holdout fraction")


def count_splits(cases: DataFrame) -> SplitCounts:
    row = cases.agg(F.count_if(F.col("split") == "HOLDOUT").alias("h"), F.count("*").alias("n")).first()
    return SplitCounts(row["n"] - row["h"], row["h"])


def record_problem(value: Column, record: Column) -> Column:
    """Why a line is no record, or null; strict where from_json is lenient. value: the line, record: from_json of it."""
    keys = F.json_object_keys(value)
    allowed = F.array(*[F.lit(n) for n in schemas.RECORD.names])
    unknown = F.array_except(keys, allowed)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(F.octet_length(value) > MAX_RECORD_BYTES, F.lit(f"a record is larger than {MAX_RECORD_BYTES} bytes"))
        .when(keys.isNull(), F.lit("not a JSON object"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")))
        .when(record.isNull(), F.lit("not a record"))
        .when(empty(record["id"]), F.lit("has no id"))
        .when(empty(record["input"]), F.lit("has no input"))
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """lines (line, value) to line, record fields and problem; blank lines are no records but count as lines."""
    text = F.regexp_replace("value", "\r$", "")
    parsed = lines.select("line", text.alias("value")).filter(F.length(F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))) > 0)
    parsed = parsed.withColumn("record", F.from_json("value", schemas.RECORD.simpleString()))
    return parsed.select("line", record_problem(F.col("value"), F.col("record")).alias("problem"), "record.*")


def first_problem(records: DataFrame) -> tuple[int, str] | None:
    """The lowest line with a problem; a repeated id is one, at its second place."""
    again = Window.partitionBy("id").orderBy("line")
    own = records.filter(F.col("problem").isNotNull()).select("line", "problem")
    repeated = records.filter(F.col("problem").isNull()).withColumn("nth", F.row_number().over(again)).filter("nth > 1").select("line", F.concat(F.lit("duplicate case id "), "id").alias("problem"))
    row = own.unionByName(repeated).orderBy("line").first()
    return (row["line"], row["problem"]) if row else None


class JsonLines:
    """One JSON object on each line of a file: id, input and, if wanted, expected, rubric, tags."""

    def __init__(self, spark: SparkSession, path: str, *, seed: str = "", fraction: float = 0.0) -> None:
        self.spark, self.path, self.seed, self.fraction = spark, path, seed, holdout_fraction(fraction)
        self._kept: DataFrame | None = None

    def lines(self) -> DataFrame:
        """Numbered from 1. Splits of a file follow each other, so lines count on from split to split."""
        raw = self.spark.read.option("lineSep", "\n").text(self.path).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
        sizes = raw.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "first", "before")
        return raw.join(F.broadcast(starts), "part").select((F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")

    def cases(self) -> DataFrame:
        records = parse_records(self.lines())
        if problem := first_problem(records):
            raise errors.INVALID_INPUT(f"{self.path}, line {problem[0]}: {problem[1]}")
        source = F.struct(F.lit("jsonl").alias("source"), F.concat(F.lit(f"{self.path}:"), F.col("line").cast("string")).alias("source_ref"))
        return schemas.conform(records.withColumn("split", split_of(F.col("id"), seed=self.seed, fraction=self.fraction)).withColumn("provenance", provenance(source)), schemas.CASES)

    def content_hash(self) -> str:
        """Of the lines in order, the seed, the exact fraction and the path: what a resumed run must share."""
        whole = hashlib.sha256(tree_hash.root(tree_hash.tree(self.lines(), ["line"], F.col("value"))).encode())
        whole.update(self.seed.encode() + struct.pack("<d", self.fraction) + b"\0" + self.path.encode())
        return whole.hexdigest()


def provenance(source: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(source["source"].alias("source"), source["source_ref"].alias("source_ref"), none.alias("fetched_at"), F.lit(False).alias("derived"))


def from_table(df: DataFrame, *, case_id: Column, text: Column, expected: Column, tags: Column | None = None, source: str = "parquet", seed: str = "", fraction: float = 0.0) -> DataFrame:
    """Cases from any table with a unique id."""
    own = F.struct(F.lit(source).alias("source"), case_id.alias("source_ref"))
    rows = df.select(case_id.alias("id"), text.alias("input"), expected.alias("expected"), (tags if tags is not None else F.array().cast("array<string>")).alias("tags"), provenance(own).alias("provenance"))
    return schemas.conform(rows.withColumn("split", split_of(F.col("id"), seed=seed, fraction=fraction)), schemas.CASES)


def from_csv(spark: SparkSession, path: str, *, seed: str = "", fraction: float = 0.0) -> DataFrame:
    """A header with id, input, expected, rubric, tags (tags parted by |); a bad row fails the read."""
    rows = spark.read.csv(path, header=True, schema="id string, input string, expected string, rubric string, tags string", mode="FAILFAST", multiLine=True, escape='"')
    return schemas.conform(rows.withColumn("tags", F.split("tags", r"\|")).withColumn("split", split_of(F.col("id"), seed=seed, fraction=fraction)), schemas.CASES)


def from_conversations(conversations: DataFrame, *, seed: str = "", fraction: float = 0.0) -> DataFrame:
    """A case from each conversation that ends in an answer: the last user turn is the input, the reply behind it is
    what is expected, and the turns before are its history. Derived, so marked as such."""
    order = F.struct("turn", "role", "text")
    turns = F.array_sort(F.collect_list(order))
    talks = conversations.groupBy("conv_id").agg(turns.alias("turns")).withColumn("n", F.size("turns")).filter(
        (F.col("n") >= 2) & (F.col("turns")[F.col("n") - 1]["role"] == "assistant") & (F.col("turns")[F.col("n") - 2]["role"] == "user")
    )
    own = F.struct(F.lit("transcript").alias("source"), F.col("conv_id").cast("string").alias("source_ref"), F.lit(None).cast("string").alias("fetched_at"), F.lit(True).alias("derived"))
    past = F.transform(F.slice("turns", 1, F.col("n") - 2), lambda t: F.struct(F.upper(t["role"]).alias("role"), t["text"].alias("content"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls")))
    rows = talks.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"), F.col("turns")[F.col("n") - 2]["text"].alias("input"), F.col("turns")[F.col("n") - 1]["text"].alias("expected"), past.alias("history"), own.alias("provenance"),
    )
    return schemas.conform(rows.withColumn("split", split_of(F.col("id"), seed=seed, fraction=fraction)), schemas.CASES)


def duplicate_ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def pool_from_files(spark: SparkSession, path: str, kind: str, pattern: str = "*.md") -> DataFrame:
    """Assets from a folder of files, one each, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return schemas.conform(files.select(F.col("path").alias("id"), F.lit(kind).alias("kind"), "content"), schemas.ASSETS)


def pool_from_table(df: DataFrame, *, asset_id: Column, content: Column, kind: Column, tags: Column, costs: Column) -> DataFrame:
    return schemas.conform(df.select(asset_id.alias("id"), schemas.one_of(kind, schemas.KINDS).alias("kind"), F.encode(content, "UTF-8").alias("content"), tags.alias("tags"), costs.alias("costs")), schemas.ASSETS)
