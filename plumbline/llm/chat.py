"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its text is
under the loss mask. Since a conversation of n turns has examples of n * n / 2 turns in all, contexts are held
once, by reference: ``format_turns`` gives every turn's formatted segment with its position and its place in
its conversation's formatted stream, and ``prefix_examples`` gives one row for each example, whose text is the
stream up to the end of its target. So the output grows with the input, also where one conversation holds a
third of all rows. ``example_texts`` writes the texts out.

The template marks turns by control strings; inside texts and roles, each control string (also those of other
common templates) gets a backslash after its first character, one more if some stand there already, and
``unescape`` takes it away again, so that the marks are read back without doubt.

Defined results: a null text or role is empty; rows of the same turn number stand in order of role and text;
null turn numbers come first; rows without a conversation id form one conversation; a conversation without
assistant turns has no examples; an empty table gives empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, ship

#: The template's control strings, and those of other templates that texts may hold.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TARGET_ROLE = "assistant"

_HEADS = "".join(sorted({"\\" + c[0] for c in CONTROL}))
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = f"([{_HEADS}])(\\\\*)(?={_TAILS})"
_UNESCAPE = re.compile(f"([{_HEADS}])\\\\(\\\\*)(?={_TAILS})")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _ESCAPE, "$1$2\\\\")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, _, text = segment[len(START):-len(END)].partition(SEPARATOR)
    return unescape(head), unescape(text)


def format_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn: conv_id, at (from 0), start (characters of its stream before it), segment, target (is it trained).

    Rows are dealt out by ranges of (conversation, turn), so that a large conversation spans many partitions;
    what the parts hold is added up by part.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    segments = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.concat(F.lit(START), escaped(role), F.lit(SEPARATOR), escaped(text), F.lit(END)).alias("segment"),
    )
    order = ("conv_id", "turn", "role", "text")
    dealt = segments.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part"))
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    local = durable(dealt.select(
        "conv_id", "part", "segment", (F.col("role") == TARGET_ROLE).alias("target"), (F.row_number().over(within) - 1).alias("local_at"),
        (F.sum(F.length("segment")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment")).alias("local_start"),
    ))
    parts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"), (F.sum("n").over(before) - F.col("n")).alias("n_before"), (F.sum("chars").over(before) - F.col("chars")).alias("chars_before"))
    placed = local.join(parts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    return placed.select("conv_id", (F.col("local_at") + F.col("n_before")).alias("at"), (F.col("local_start") + F.col("chars_before")).alias("start"), "segment", "target")


def prefix_examples(turns: DataFrame) -> DataFrame:
    """Every example: conv_id, target_at, context_chars, example_chars, loss_start, loss_end (in the example's text)."""
    header = len(START) + len(TARGET_ROLE) + len(SEPARATOR)
    end = F.col("start") + F.length("segment")
    return turns.filter("target").select(
        "conv_id", F.col("at").alias("target_at"), F.col("start").alias("context_chars"), end.alias("example_chars"), (F.col("start") + header).alias("loss_start"), (end - len(END)).alias("loss_end"),
    )


def example_texts(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples with their texts written out; as large as all contexts together."""
    held = turns.select(F.col("conv_id").alias("of"), "at", "segment")
    pairs = examples.join(held, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") <= F.col("target_at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment"))), lambda x: x["segment"]), "")
    return pairs.groupBy(*examples.columns).agg(text.alias("text"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation of rows sorted by conversation and place; holds one batch at a time.

    Segments are counted as they come, so that what is said of the examples is what was read, not what was written."""
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, state = None, None

    def done() -> list:
        return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    def read(segment: str, chars: int, low: int, high: int) -> None:
        """An example's text is the stream up to here: its parts are read where its references point to."""
        stream = state[5]
        if chars != stream or not stream - len(segment) < low <= high <= stream - len(END):
            raise ValueError("an example's references do not point into its conversation's stream")
        trained = unescape(segment[low - stream + len(segment):high - stream + len(segment)])
        state[2] += len(trained)
        state[3].update(trained.encode("utf-8", "surrogatepass"))
        state[4] += stream

    for batch in batches:
        out = []
        conv_ids, missing = batch["conv_id"].tolist(), batch["conv_id"].isna().tolist()
        spans = zip(batch["segment"], batch["example_chars"].tolist(), batch["loss_start"].tolist(), batch["loss_end"].tolist(), strict=True)
        for conv, null, (segment, chars, low, high) in zip(conv_ids, missing, spans, strict=True):
            conv = None if null else conv
            if state is None or conv != key:
                if state is not None:
                    out.append(done())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = read_segment(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[5] += len(segment)
            if chars == chars and chars is not None:
                read(segment, int(chars), int(low), int(high))
        yield pd.DataFrame(out, columns=fields)
    if state is not None:
        yield pd.DataFrame([done()], columns=fields)


def read_back(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """What the formatted output says, by conversation; formatted_chars adds up its examples' texts."""
    ship(turns.sparkSession)
    spans = examples.select(F.col("conv_id").alias("of"), "target_at", "example_chars", "loss_start", "loss_end")
    both = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("target_at")), "left")
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = both.select("conv_id", "at", "segment", "example_chars", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInPandas(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
