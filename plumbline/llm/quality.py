"""Quality rules as weak supervision (native).

Rules vote good (1) or bad (-1) on a document or abstain (0). Nobody labels anything: expectation-maximisation
over the votes of all documents estimates how often each rule calls a good document bad (its false alarms) and
a bad one bad (its hits), and how many documents are bad. Bad documents are of several kinds that no one rule
sees in full, so there is a class of bad for each rule to lead, and accuracies by class. A document's posterior
probability of being good decides, in place of a rule that every check must pass.

Documents enter the estimation as counts of vote patterns, 3 ** len(RULES) at most whatever the input, so it is
one expression over one bounded row.

Defined results: a null text has no words; a document without words votes nothing and is decided by the prior
alone; repeated rows are judged alike; an empty table gives an empty result; texts of any length are read whole;
columns of the input with our names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_RUN, SPACES, durable, numbered, spare_name, without_rows

#: Where the base checks end: fewest words, largest share of words in repeated windows (percent).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS, KEEP_FROM = 25, 0.5
POSITION_BITS = 24

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letter_words", "n_upper", "n_letters", "n_marks")

#: name: (votes bad where, votes good where), by the features.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "lines": ("n_lines >= 4 and n_dup_lines > 0.4 * n_lines", "n_lines >= 4 and n_dup_lines <= 0.1 * n_lines"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 10 * n_words", "word_chars between 3.5 * n_words and 6.5 * n_words"),
    "capitals": ("n_upper > 0.5 * n_letters", "n_upper <= 0.15 * n_letters"),
    "marks": ("n_marks > 0.2 * n_words", "n_marks <= 0.02 * n_words"),
    "variety": ("n_distinct < 0.1 * n_words and n_words < 5000", "n_distinct > 0.4 * n_words"),
    "letters": ("n_letter_words < 0.6 * n_words", "n_letter_words >= 0.95 * n_words"),
}


def _repeat_words() -> Column:
    """Words in three-word windows found twice or more; from the arrays words and hashes, n_words of each.

    A window is a long: the upper bits of its hash, then its position. After sorting, equal windows are
    neighbours. Neighbours with equal hashes are compared as words, too; where hashes deceive, or a text has
    too many words for the position, the words themselves are sorted.
    """
    n, at, mask = F.col("n_words"), F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), F.lit((1 << POSITION_BITS) - 1).cast("long")
    head = lambda x: F.shiftright(x, POSITION_BITS)
    place = lambda x: x.bitwiseAND(mask).cast("int")
    words = F.col("words")
    same_words = lambda i, j: (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])
    covered = lambda places: F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    h = F.col("hashes")
    keys = F.sort_array(F.transform(at, lambda i: F.shiftleft(head(F.xxhash64(h[i], h[i + 1], h[i + 2])), POSITION_BITS).bitwiseOR(i.cast("long"))))

    def fast(keys: Column) -> Column:
        near = F.filter(keys, lambda k, j: ((j > 0) & (head(F.get(keys, j - 1)) == head(k))) | F.coalesce(head(F.get(keys, j + 1)) == head(k), F.lit(False)))
        return F.transform(F.array(near), lambda d: F.struct(d.alias("near"), F.exists(F.transform(d, lambda k, j: F.struct(k.alias("k"), F.get(d, j + 1).alias("next"))), lambda x: x["next"].isNotNull() & (head(x["k"]) == head(x["next"])) & ~same_words(place(x["k"]), place(x["next"]))).alias("deceived")))[0]

    exact_keys = F.sort_array(F.transform(at, lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    exact = F.transform(F.array(exact_keys), lambda s: covered(F.transform(F.filter(s, lambda x, j: ((j > 0) & same(x, F.get(s, j - 1))) | same(x, F.get(s, j + 1))), lambda x: x["i"])))[0]
    found = F.transform(F.array(keys), fast)[0]
    quick = F.transform(F.array(found), lambda f: F.when(f["deceived"], F.lit(-1)).otherwise(covered(F.transform(f["near"], place))))[0]
    return F.transform(F.array(F.when(n >= 1 << POSITION_BITS, F.lit(-1)).otherwise(quick)), lambda q: F.when(n < 4, F.lit(0)).when(q < 0, exact).otherwise(q))[0]


def features(docs: DataFrame, text_col: str, *carry: Column) -> DataFrame:
    """The columns carry, then FEATURES as long."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    symbols, marks = "#*$%&|<>", "!"
    count = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    names = [f"carried_{i}" for i in range(len(carry))]
    texts = docs.select(*[c.alias(n) for c, n in zip(carry, names, strict=True)], text.alias("whole"), F.btrim(text, F.lit(SPACES)).alias("body"))
    split = texts.select(*names, "whole", F.when(F.length("body") == 0, F.array().cast("array<string>")).otherwise(F.split("body", SPACE_RUN)).alias("words"), F.filter(F.split("whole", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"))
    letters = F.regexp_replace("whole", "[^\\p{L}]+", "")
    lettered = F.btrim(F.regexp_replace("whole", "[^\\p{L}\\x20\\x09-\\x0D]+", ""), F.lit(SPACES))
    counted = split.select(
        *names, "whole", "words", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), letters.alias("letters"), lettered.alias("lettered"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    done = counted.select(
        *names, "n_words", F.length(F.regexp_replace("whole", SPACE_RUN, "")).alias("word_chars"), count(F.col("whole"), symbols).alias("n_symbols"), "n_dup_lines",
        F.when(F.col("n_words") < 4, F.lit(0)).otherwise(_repeat_words()).alias("n_repeat_words"), "n_lines", F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.when(F.length("lettered") == 0, F.lit(0)).otherwise(F.size(F.split("lettered", SPACE_RUN))).alias("n_letter_words"),
        F.length(F.regexp_replace("letters", "[^\\p{Lu}]+", "")).alias("n_upper"), F.length("letters").alias("n_letters"), count(F.col("whole"), marks).alias("n_marks"),
    )
    return done.select(*names, *[F.col(f).cast("long").alias(f) for f in FEATURES])


def votes() -> Column:
    """The rules' votes as an array of 1, -1 or 0, by the columns FEATURES."""
    return F.when(F.col("n_words") == 0, F.array(*[F.lit(0)] * len(RULES))).otherwise(F.array(*[F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)) for bad, good in RULES.values()]))


def _classes() -> Column:
    return F.sequence(F.lit(0), F.lit(len(RULES)))


def _rules() -> Column:
    return F.sequence(F.lit(0), F.lit(len(RULES) - 1))


def _posterior(v: Column, m: Column) -> Column:
    """Each class's probability, given votes and a model; class 0 is good, class k is the kind of bad that rule k leads."""
    def likelihood(c: Column) -> Column:
        rate = m["rates"][c]
        return F.aggregate(_rules(), F.log(m["shares"][c]), lambda a, j: a + F.when(v[j] == -1, F.log(rate[j])).when(v[j] == 1, F.log(1 - rate[j])).otherwise(F.lit(0.0)))

    weigh = lambda logs: F.transform(F.array(F.array_max(logs)), lambda top: F.transform(logs, lambda x: F.exp(x - top)))[0]
    normed = lambda w: F.transform(F.array(F.aggregate(w, F.lit(0.0), lambda a, x: a + x)), lambda t: F.transform(w, lambda x: x / t))[0]
    return F.transform(F.array(F.transform(_classes(), likelihood)), lambda logs: F.transform(F.array(weigh(logs)), normed)[0])[0]


def fit(voted: DataFrame) -> DataFrame:
    """One row with the model: shares (of each class) and rates (of each class, each rule: how often it votes bad if it votes).

    voted: a column votes. The start trusts the rules: a document with bad votes is one of the kinds that the
    rules with those votes lead. Pseudo-counts keep every rate and share off 0 and 1.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def maximise(weighed: Column) -> Column:
        """weighed: (votes, n, probable: by class)."""
        total = lambda f: F.aggregate(weighed, F.lit(0.0), lambda a, x: a + f(x))
        everything = total(lambda x: x["n"])
        shares = F.transform(_classes(), lambda c: (total(lambda x: x["n"] * x["probable"][c]) + F.when(c == 0, 1.0).otherwise(0.05)) / (everything + 1 + 0.05 * len(RULES)))

        def rate(c: Column, j: Column) -> Column:
            bad = total(lambda x: F.when(x["votes"][j] == -1, x["n"] * x["probable"][c]).otherwise(0.0))
            either = total(lambda x: F.when(x["votes"][j] != 0, x["n"] * x["probable"][c]).otherwise(0.0))
            return F.when(c == 0, (bad + 0.05) / (either + 5)).when(c == j + 1, (bad + 4.5) / (either + 5)).otherwise((bad + 0.5) / (either + 5))

        return F.struct(shares.alias("shares"), F.transform(_classes(), lambda c: F.transform(_rules(), lambda j: rate(c, j))).alias("rates"))

    def expect(p: Column, m: Column) -> Column:
        return F.transform(p, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _posterior(x["votes"], m).alias("probable")))

    def trusting(v: Column) -> Column:
        bad = F.size(F.filter(v, lambda y: y == -1))
        return F.transform(_classes(), lambda c: F.when(c == 0, F.when(bad > 0, 0.1).otherwise(1 - 0.01 * len(RULES))).otherwise(F.when(bad == 0, 0.01).when(F.get(v, c - 1) == -1, 0.9 / bad).otherwise(0.0)))

    start = F.transform("p", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), trusting(x["votes"]).alias("probable")))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), maximise(start), lambda m, _: F.transform(F.array(expect(F.col("p"), m)), maximise)[0])
    return patterns.select(model.alias("model")).select("model.*")


def judged(featured: DataFrame, model: DataFrame) -> DataFrame:
    """Adds base_failed, quality (posterior probability) and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    m = model.select(F.struct("shares", "rates").alias("quality_model"))
    quality = _posterior(F.col("quality_votes"), F.col("quality_model"))[0]
    scored = featured.withColumn("quality_votes", votes()).join(F.broadcast(m)).withColumn("quality", quality)
    return scored.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).drop("quality_model", "quality_votes")


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Every row: doc_id, FEATURES, base_failed, quality, kept, row (row_col, else its place in the input)."""
    featured = durable(features(docs, text_col, F.col(id_col), F.col(row_col) if row_col else F.monotonically_increasing_id()).withColumnsRenamed({"carried_0": "doc_id", "carried_1": "row"}))
    return judged(featured, durable(fit(featured.select(votes().alias("votes")))))


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The rows of docs that the base checks and the rules keep, with all their columns. Without row_col, which numbers rows as
    placed() does, docs is written."""
    row = row_col or spare_name(docs, "row_number_here")
    docs = docs if row_col else numbered(docs, row)
    judged_rows = quality_rules(docs, id_col=id_col, text_col=text_col, row_col=row)
    stay = without_rows(docs, row, judged_rows.filter(~F.col("kept")).select("row"))
    return stay if row_col else stay.drop(row)
