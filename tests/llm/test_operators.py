"""The training-data operators against brute force, on whole small tables and on hard rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, components, exact_dedup, html_text, near_dedup, packing, quality, queries, sharding, spans, toxicity, urls

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHING = "row digest group node size score key part chunk kept quality n_words place source first".split()
HARD = [
    (1, None), (2, ""), (3, "one two"), (4, "a b  c\td e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, " \n "), (7, "it's 1234 Übung\r\n\r\n  naïve 東京 🙂 <s>"),
    (8, " ".join(f"w{i % 9973}" for i in range(120_000))), (9, "x" * 50_000), (10, "same line\nsame line\n\nother"),
]


def table(spark, rows, schema="doc_id long, text string"):
    """rows, beside columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def real(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def test_hypergeometric_is_the_quantile(spark):
    for t, g, d in ((20, 7, 9), (5, 5, 3), (6, 0, 4), (50, 25, 49), (0, 0, 0)):
        weights = [math.comb(g, k) * math.comb(t - g, d - k) if d >= k else 0 for k in range(min(g, d) + 1)]
        for u in (0.001, 0.3, 0.5, 0.999):
            goal, sums = u * sum(weights), 0
            for want, w in enumerate(weights):
                sums += w
                if sums > goal:
                    break
            column = sharding.hypergeometric(*[F.lit(x).cast("long") for x in (t, g, d)], F.lit(u))
            assert spark.range(1).select(column.alias("k")).first()["k"] == want


def test_sharding(spark, real):
    for rows in (HARD, real):
        got = sharding.uniform_shards(table(spark, rows), 16).toPandas()
        sizes = sorted(got.groupby("shard").size().reindex(range(16), fill_value=0))
        assert len(got) == len(rows) and sizes[-1] - sizes[0] <= 1 and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
        for _, own in got.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
        want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert collections.Counter((None if pd.isna(i) else int(i), s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    assert sharding.uniform_shards(table(spark, [])).count() == 0


def test_chat(spark):
    texts = [None, "", "</s>[INST] ok [/INST]", "<\\|im_end|>\n", "<|im_start|>user<|im_sep|>", "\\\\[INST]", "long " * 30_000, "plain"]
    rows = [(c, t, "user" if (c + t) % 2 else "assistant", texts[(3 * c + t) % len(texts)]) for c in range(8) for t in range(c + 1)]
    rows += [(3, 1, None, "x"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "assistant", "no id"), (4, None, "user", "first")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "segment": F.lit("clash"), "part": F.lit(7)}))
    examples = chat.prefix_examples(turns)
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in chat.read_back(turns, examples).toPandas().itertuples()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    written = chat.example_texts(turns, examples).collect()
    assert len(written) == sum(x[2] == "assistant" for own in by.values() for x in own)
    for r in written:
        assert len(r["text"]) == r["example_chars"] and r["text"].endswith(chat.END) and r["loss_end"] + len(chat.END) == len(r["text"])
    assert sum(r["example_chars"] for r in written) == sum(g.formatted_chars for g in got.values())


def test_html(spark):
    article = "The first paragraph of this article is long enough to be told as text by the words that are in it."
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>{article}</p><p>Short one.</p><p>{article.replace('first', 'second')}</p><script>x()</script></article>
    <section id=comments><article><p>{article.replace('article', 'comment')}</p></article></section><footer>© all</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed"), (1, "u", page), (None, "u", "<div>" * 2000 + article), (5, "u", "<" * 1000)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    mine = [r["text"] for r in got if r["page_id"] == 1]
    assert mine == ["\n\n".join(["Head & line", article, "Short one.", article.replace("first", "second")])] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert [r["text"] for r in got if r["page_id"] is None] == [article]


def test_html_blocks_are_decided_without_marks():
    text = "This is a long block of the kind that has many of the words that stand in every text and it is in."
    keywords = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    links = "<div>" + " ".join(f"<a href=/{w}>{w}</a>" for w in ("Home", "News", "Sports", "Weather")) + "</div>"
    page = f"{links}<div>Our sections</div>{links}<div>A short headline</div><div>{text}</div><div>Short end.</div><div>© us</div><div>{keywords}</div>{links}"
    assert html_text.main_text(page) == "\n\n".join(["A short headline", text, "Short end."])
    blocks = html_text.blocks_of(page)
    labels = html_text.first_pass(blocks)
    assert None in labels and True in labels and False in labels
    assert html_text.second_pass(blocks, labels) != [bool(x) for x in labels]  # the second pass decides
    assert html_text.second_pass(blocks, [None] * len(blocks)) != html_text.second_pass(blocks, labels)  # and the first one
    assert html_text.main_text(f"<div>{keywords}</div>{links}") == keywords
    assert html_text.main_text(f"<div class=ad>{text}</div><p>Brief.") == "Brief."


def blinded(page):
    """The page without names: no classes, ids or roles, and plain divs for menus, headers, footers and sidebars."""
    page = re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>"']+)""", "", page)
    return re.sub(r"<(/?)(nav|header|footer|aside)\b", r"<\1div", page)


def test_html_of_pages_without_names_and_what_each_pass_gives(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = right = every = first = second = 0
    for page in pages:
        wanted = html_text.main_text(page)
        blind = html_text.blocks_of(blinded(page))
        labels = html_text.first_pass(blind)
        kept = html_text.second_pass(blind, labels)
        same += "\n\n".join(b.text for b, k in zip(blind, kept, strict=True) if k) == wanted
        named = html_text.blocks_of(page)
        assert [b.text for b in named] == [b.text for b in blind]
        labels_named = html_text.first_pass(named)
        own = html_text.second_pass(named, labels_named)
        right += sum(a == b for a, b in zip(own, kept, strict=True))
        every += len(own)
        # What is left of a page where a pass decides nothing: all open to the second, or all that the first left open text, or not.
        first += html_text.second_pass(named, [None] * len(named)) != own
        second += [x is not False for x in labels] != kept and [bool(x) for x in labels_named] != own
    assert same > 0.95 * len(pages) and right > 0.99 * every
    assert first > 0.95 * len(pages) and second > 0.95 * len(pages)


def test_html_second_pass_by_element():
    text = "This is a long block of the kind that has many of the words that stand in every text and it is in."
    page = f"<div><div><a href=x>Home</a></div></div><div>Buy it now</div><section><h1>Head</h1><p>Short.</p><p>{text}</p><p>End.</p></section><div>© us</div>"
    assert html_text.main_text(page) == "\n\n".join(["Head", "Short.", text, "End."])
    assert html_text.main_text("<div><a href=x>Home</a></div><div>Buy it now</div><section><h1>Head</h1><p>Short.</p></section>") == "Head\n\nShort."  # nothing is decided as text
    assert html_text.main_text(f"<p>{text}</p><div class=comments><p>{text}</p></div><p>Last.</p>") == f"{text}\n\nLast."


HOSTILE = [
    "<a " * 350_000, '<a "' * 350_001, '<a "1>2" ' * 150_000 + "'", "<div>" * 200_000 + "</div>" * 200_000, '<a "<' * 300_000, "<p><b>" * 150_000, "<!--" * 200_000, "<script>" * 100_000, "<script>" + "</script " * 100_000,
    "<p><div>" + "<b>" * 100_000 + "<p></p>" * 100_000, "<script></script " * 60_000, "<li><ul>" * 100_000,
]


@pytest.mark.parametrize("page", HOSTILE, ids=range(len(HOSTILE)))
def test_html_of_hostile_pages_is_read_once(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_bpe_equals_the_library(spark, real):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = bpe.encoder_of(path, public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN == bpe.BYTE_LEVEL_PATTERN
    draw = random.Random(8)
    odd = ["a", "É", "é", "<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", " ", "'s", "'S", "'re", "'l", "'ll", "'", "ß", "12", "漢", "🙂", "²", ",", "!!", "\x00", "word", "\r\n"]
    fuzz = [(i, "".join(draw.choice(odd) for _ in range(draw.randint(0, 25)))) for i in range(3000)]
    for rows in (HARD, real, fuzz):
        got = bpe.encode_and_decode(table(spark, rows), path, public_tokenizers.PATTERN).toPandas()
        want = []
        for i, text in rows:
            ids = library.encode_ordinary(text or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        mine = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert bpe.encode_and_decode(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_of_long_texts_and_of_other_patterns(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    text = " ".join(random.Random(1).choices(["foo", "bar", "Baz,", "it's", "é1", "\n"], k=3000))
    for pattern in (bpe.BYTE_LEVEL_PATTERN, r"\w+|\s|\W"):
        chunk = bpe.Chunk(pattern)
        for t in (text, "", "x"):
            chunk.add(t)
        chunk.settle()
        words, flat = list(chunk.numbered), np.concatenate(chunk.codes)
        want = regex.findall(pattern, text)
        assert [words[k] for k in flat] == [*want, "x"] and chunk.sizes == [len(want), 0, 1]


def test_blocks_of_another_reading_are_refused():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one, other = (pd.concat(bpe.explode_words(iter([pd.DataFrame({"doc_id": ["1", "2"], "text": texts})]), 0, bpe.BYTE_LEVEL_PATTERN, 2)) for texts in (["a b", "c"], ["a b", "d"]))
    encoded = pd.concat(bpe.encode_words(iter([other[other["bucket"] >= 0]]), path, bpe.BYTE_LEVEL_PATTERN))
    assert len(bpe.reassemble(other, encoded, path)) == 2
    with pytest.raises(ValueError, match="another order"):
        bpe.reassemble(one, encoded, path)


def test_equal_spans_get_equal_numbers_also_where_hashes_deceive(monkeypatch):
    codes = spans.code_points("ab cd ab é ab cd")
    starts, ends = spans.words_between(codes, spans.class_table(r"\s"))
    for weights in (spans._WEIGHTS, np.zeros(1 << 12, np.uint64)):
        monkeypatch.setattr(spans, "_WEIGHTS", weights)
        numbers, firsts = spans.number_spans(codes, starts, ends)
        assert numbers.tolist() == [0, 1, 0, 2, 0, 1] and firsts.tolist() == [0, 1, 3]


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, real):
    for rows in (HARD, real):
        got = quality.quality_rules(table(spark, rows)).toPandas()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        mine = sorted((repr(None if pd.isna(r["doc_id"]) else int(r["doc_id"])), *[int(r[n]) for n in names]) for _, r in got.iterrows())
        assert mine == sorted((repr(i), *counted(t)) for i, t in rows)
        assert (got["base_failed"] == ((got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"]))).all()
        assert not got["kept"][got["base_failed"]].any() and got["quality"].between(0, 1).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    labels = labels[~labels["base_failed"]]
    assert labels["kept"][labels["quality_x"] == 1].mean() >= 0.98
    assert quality.quality_rules(table(spark, [])).count() == 0
    assert quality.keep_good(table(spark, real)).columns == table(spark, real).columns


def other_counts(text):
    """n_lines, n_distinct, n_letter_words, n_upper, n_letters, n_marks by brute force."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    letters = regex.findall(r"\p{L}", text)
    return (
        sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")), len(set(words)), sum(bool(regex.search(r"\p{L}", w)) for w in words),
        len(regex.findall(r"\p{Lu}", text)), len(letters), text.count("!"),
    )


def em_by_numpy(votes):
    """Class 0 is good, class k the kind of bad that rule k leads; returns the posterior of class 0 for each row."""
    v = np.array(votes, dtype=float)
    n, rules = v.shape
    bad = (v == -1).sum(axis=1)
    q = np.zeros((n, rules + 1))
    q[:, 0] = np.where(bad > 0, 0.1, 1 - 0.01 * rules)
    for k in range(rules):
        q[:, k + 1] = np.where(bad == 0, 0.01, np.where(v[:, k] == -1, 0.9 / np.maximum(bad, 1), 0))
    for _ in range(quality.ROUNDS + 1):
        shares = (q.sum(axis=0) + np.array([1.0] + [0.05] * rules)) / (n + 1 + 0.05 * rules)
        hits, either = q.T @ (v == -1), q.T @ (v != 0)
        prior = np.full((rules + 1, rules), 0.5)
        prior[0] = 0.05
        prior[np.arange(rules) + 1, np.arange(rules)] = 4.5
        rates = (hits + prior) / (either + 5)
        logs = np.log(shares) + (v == -1) @ np.log(rates).T + (v == 1) @ np.log(1 - rates).T
        q = np.exp(logs - logs.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
    return q[:, 0]


def test_quality_features_and_estimation_by_brute_force(spark, real):
    rows = [(k, t) for k, (_, t) in enumerate(HARD + [(0, "12 abc 3"), (0, "1 2"), (0, " a b "), (0, "!!! ÉA É")] + real)]
    featured = quality.features(table(spark, rows), "text", F.col("doc_id")).withColumn("votes", quality.votes()).toPandas().sort_values("carried_0")
    names = ["n_lines", "n_distinct", "n_letter_words", "n_upper", "n_letters", "n_marks"]
    assert [tuple(r) for r in featured[names].to_numpy().tolist()] == [other_counts(t) for _, t in rows]
    got = quality.quality_rules(table(spark, rows)).toPandas().sort_values("doc_id")
    assert np.abs(got["quality"].to_numpy() - em_by_numpy(featured["votes"].tolist())).max() < 1e-6
    assert (got["kept"] == (~got["base_failed"] & (got["quality"] >= quality.KEEP_FROM))).all()


def test_packing(spark, real):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    control = [(20, "a <|endoftext|> b"), (21, "x<|startoftext|>Y<|ENDOFTEXT|>"), (22, "ΑΣ Σ İ é É Å <| |>"), (23, "it's IT'S 12 a\x1cb\x85c")]
    for rows in (HARD + control, real):
        got = packing.pack(table(spark, rows), path).toPandas()
        want = collections.Counter()
        for i, text in rows:
            ids = [*encode(text or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                own = ids[at:at + 2048]
                want[(i, k, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))] += 1
        assert collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own["length"].sum() <= 2048 and own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        least = -(-got["length"].sum() // 2048)
        assert got["sequence_id"].nunique() <= least + 1 + least // 50
    assert packing.pack(table(spark, []), path).count() == 0


def test_plain_words_are_encoded_without_patterns(monkeypatch):
    class Never:
        def __getattr__(self, name):
            raise AssertionError(name)

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a1 don't IT'S we'll x, q' '' 's foo9 9foo a-b, é, naïve. ÀB, İ. Σ, word\x7f ok~ !~ A, aB. ab\x1c.", *(f"{chr(c)} a{chr(c)} {chr(c)}a aB{chr(c)}" for c in range(1, 700))]
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    for texts in (["some words, then more. and (others) more; words"] * 3, odd, odd):
        assert encoder.encode(texts) == [encoder._whole(t) for t in texts]
    monkeypatch.setattr(packing, "_PLAIN", Never())
    monkeypatch.setattr(packing, "_PARTS", Never())
    plain = ["Fresh syllables, zubaro. mirkeda! tolufe; ganipo?"]
    assert encoder.encode(plain) == [encoder._whole(t) for t in plain]
    assert "zubaro" not in encoder.known


def gaining_steps(bins, lengths, capacity):
    """By brute force: is there a step that increases the squared fill?"""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for s, own in enumerate(bins):
        gives = [lengths[i] for i in own] + [lengths[i] + lengths[j] for k, i in enumerate(own) for j in own[:k]]
        singles = {lengths[i] for i in own}
        for b, others in enumerate(bins):
            if b != s:
                backs = [(0, 0), *((lengths[i], 1) for i in others), *((lengths[i] + lengths[j], 2) for k, i in enumerate(others) for j in others[:k])]
                for n, give in enumerate(gives):
                    for back, many in backs:
                        if n >= len(own) and many != 1 or many == 2 and give not in singles:
                            continue  # two pieces go for one alone
                        d = give - back
                        if 0 < d <= capacity - fill[b] and fill[b] - fill[s] + d > 0:
                            return True
    return False


def test_swaps_empty_bins():
    lengths = [6, 6, 4, 4, 4, 3, 3]
    search = packing.Search([[0, 5], [1, 6], [2, 3], [4]], lengths, 10)
    bins = search.run()
    assert len(bins) == 3 and search.steps and sorted(i for b in bins for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= 10 for b in bins)
    two_for_one = packing.Search([[0, 1], [2, 3]], [30, 30, 50, 40], 100)
    assert two_for_one._step(0) and two_for_one.bins == [[2], [3, 0, 1]] and not two_for_one._step(0)
    draw = random.Random(1)
    for turn in range(40):
        many = 14 if turn % 2 else 4
        lengths = [draw.randint(1, 60) if many == 4 else draw.randint(1, 14) for _ in range(80)]
        first = packing.best_fit(lengths, 100, range(80))
        search = packing.Search([list(b) for b in first], lengths, 100)
        after = search.run()
        assert len(after) <= len(first) and sorted(i for b in after for i in b) == list(range(80)) and all(sum(lengths[i] for i in b) <= 100 for b in after)
        assert len(after) == -(-sum(lengths) // 100) or not gaining_steps(after, lengths, 100)
        assert search.fill.tolist() == [sum(lengths[i] for i in b) for b in search.bins]


def test_the_search_packs_and_not_its_start():
    draw = random.Random(5)
    lengths = [draw.randint(512, 1400) for _ in range(1000)]
    bins, steps = packing.packed(lengths, 2048)
    falling = packing.best_fit(lengths, 2048, sorted(range(1000), key=lambda i: -lengths[i]))
    assert steps and len(bins) < len(falling) and sorted(i for b in bins for i in b) == list(range(1000))


def test_exact_dedup(spark, real):
    hot = HARD + [(100 + i, "copy  me" if i % 2 else "copy\nme") for i in range(400)]
    for rows, share in ((hot, 0.1), (hot, 1 / 256), (real, 1 / 256)):
        got = exact_dedup.exact_groups(table(spark, rows), share=share).toPandas()
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        assert len(got) == len(rows) and set(got["text_sha256"]) == by_digest.keys()
        for digest, own in got.groupby("text_sha256"):
            ids = [i for i in by_digest[digest] if i is not None]
            assert (own["group_size"] == len(by_digest[digest])).all() and own["kept"].sum() == 1
            assert (own["keep_id"] == min(ids)).all() if ids else own["keep_id"].isna().all()
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(table(spark, hot)).count() == len({re.sub(r"\s+", " ", t or "") for _, t in hot})


def near_by_brute_force(a, b):
    def shingled(t):
        w = (t or "").lower().split()
        return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    a, b = shingled(a), shingled(b)
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return a == b or 9 * row[-1] >= 4 * (len(a) + len(b)) and row[-1] > 0


def edited(text, draw, edits):
    words = text.split()
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at:at + 1] = draw.choice([[], ["new"], [words[at], "extra"]])
    return " ".join(words)


def planted(n_groups=12, seed=3):
    draw = random.Random(seed)
    texts = []
    for g in range(n_groups):
        base = " ".join(f"g{draw.randrange(400)}" for _ in range(120))
        texts += [base] + [edited(base, draw, draw.choice([1, 2, 4])) for _ in range(g % 5)]
        texts.append(" ".join(base.split()[60:] + base.split()[:60]))  # the same words in another order
    return texts


@pytest.mark.parametrize("local, part", [(1024, 256), (2, 2)])
def test_near_dedup(spark, monkeypatch, local, part):
    monkeypatch.setattr(near_dedup, "LOCAL", local)
    monkeypatch.setattr(near_dedup, "PART", part)
    rows = [(i, t) for i, t in enumerate(planted(6 if local < 10 else 12))] + [(None, None), (900, ""), (901, " \n"), (902, "Two words"), (903, "two  WORDS"), (904, "two other words"), (904, "two other words")]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and near_by_brute_force(rows[i][1], rows[j][1]):
                root = [root[j] if r == root[i] else r for r in root]
    got = near_dedup.near_groups(table(spark, rows)).toPandas()
    assert len(got) == len(rows) and got["kept"].sum() == len(set(root))
    members = collections.defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        members[r].append(i)
    want = sorted((repr(i), repr(min((x for x in own if x is not None), default=None)), len(own)) for own in members.values() for i in own)
    plain = lambda x: repr(None if pd.isna(x) else int(x))
    assert sorted((plain(r.doc_id), plain(r.group_id), r.group_size) for r in got.itertuples()) == want


def drifting(n, *, seed=11, words=60):
    """Versions of a text, each near its neighbours and no others but a few."""
    draw = random.Random(seed)
    text, out = [f"s{draw.randrange(10**9)}" for _ in range(words)], []
    for i in range(n):
        out.append((i, " ".join(text)))
        text = text[1:] + [f"s{draw.randrange(10**9)}"]
    draw.shuffle(out)
    return out


def test_near_dedup_bridges_groups_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LOCAL", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rows = drifting(40) + [(100 + i, t) for i, t in drifting(12, seed=12)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and near_by_brute_force(rows[i][1], rows[j][1]):
                root = [root[j] if r == root[i] else r for r in root]
    assert len(set(root)) == 2
    got = near_dedup.near_groups(table(spark, rows)).toPandas().set_index("doc_id")["group_id"]
    assert len({(got[rows[i][0]], root[i]) for i in range(len(rows))}) == len(set(got)) == 2


def test_texts_linked_in_one_round_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LOCAL", 2)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    rows = [(k, 0, 100, 9 if k in (0, 3) else 1, bytearray(b"".join(i.to_bytes(4, "little") for i in range(8 * k, 8 * k + 100)))) for k in range(4)]
    links = near_dedup.settle_large(spark.createDataFrame(rows, "node long, group long, size long, weight long, body binary"))
    assert {r["label"] for r in near_dedup.components(links).collect()} == {0}


def test_near_texts_of_few_shingles_are_never_missed(spark):
    draw, rows = random.Random(5), []
    for n in range(5, 25):
        for _ in range(30):
            words = [f"k{draw.randrange(10**9)}" for _ in range(n)]
            cut = draw.randrange(1 + n // 8)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[cut:], "more"]))]
    near = [(a, b) for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True) if near_by_brute_force(s, t)]
    got = near_dedup.near_groups(table(spark, rows)).toPandas().set_index("doc_id")["group_id"]
    assert len(near) > 300 and all(got[a] == got[b] for a, b in near)
    assert got.nunique() == len(rows) - len(near)


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_groups(table(spark, [])).count() == 0
    assert near_dedup.keep_one_of_each(table(spark, [(1, "a"), (2, "a"), (3, None)])).count() == 2


def test_copies_are_dropped_by_numbers_of_one_scan(spark):
    def in_another_order(batches):
        for batch in batches:
            yield batch.sample(frac=1)

    texts = [f"{name} one two three four five six" for name in "abcdefgh"]
    docs = spark.createDataFrame([(i, texts[i % 8]) for i in range(24)], "doc_id long, text string").coalesce(1).mapInPandas(in_another_order, "doc_id long, text string")
    for drop in (exact_dedup.drop_exact_copies, near_dedup.keep_one_of_each):
        assert sorted(map(tuple, drop(docs).collect())) == list(enumerate(texts))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    judged = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, other = judged["score"][judged["toxic"] == 1], judged["score"][judged["toxic"] == 0]
    assert (toxic.to_numpy()[:, None] > other.to_numpy()[None, :]).mean() > 0.9


def test_toxicity_of_hard_rows(spark):
    rows = table(spark, HARD[:8])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(rows, none).collect()} == {0.0}
    assert toxicity.toxicity(table(spark, []), none).count() == 0
    assert toxicity.drop_toxic(rows, none).count() == 8


def test_scores_are_those_of_the_worst_window():
    net, texts = toxicity.Network(3), [toxicity.words_of(t) for _, t in HARD if t is None or len(t) < 60_000] + [[f"w{i % 37}" for i in range(n)] for n in (1, 31, 32, 33, 56, 57, 100)]
    best, of, logits = net.text_logits(texts)
    for k, words in enumerate(texts):
        firsts = [] if not words else [0] if len(words) <= toxicity.WINDOW else sorted({*range(0, len(words) - toxicity.WINDOW + 1, toxicity.STEP), len(words) - toxicity.WINDOW})
        want = []
        for first in firsts:
            own = words[first:first + toxicity.WINDOW]
            want.append(float(net.logits(net.inputs(toxicity.word_hashes(own))[0], np.arange(len(own))[None, :], None)[0]))
        assert np.allclose(logits[of == k], want, atol=1e-4) and (best[k] == max(logits[of == k]) if want else np.isneginf(best[k]))
    scores = net.scores(texts)
    assert ((scores >= 0) & (scores <= 1)).all() and (scores[[not t for t in texts]] == 0).all()


def test_trained_scores_of_hard_rows(spark):
    taught = [(1000 + i, ("you vile rotten scum " if i % 2 else "a kind and gentle day ") * (3 + i % 5)) for i in range(160)]
    rows = HARD + taught + [(1000, "another text of that id")]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(160)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    by = got.groupby("doc_id")["score"].agg(["min", "max", "size"])
    assert by.loc[5, "size"] == 2 and by.loc[5, "min"] == by.loc[5, "max"] and (by.loc[[1, 2, 6], "max"] == 0).all()
    assert by.loc[1001::2, "min"].mean() > by.loc[1002::2, "max"].mean()
    again = toxicity.toxicity(table(spark, rows[::-1]), labels).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["score"].round(6))) == sorted(zip(again["doc_id"].fillna(-1), again["score"].round(6)))
    assert toxicity.drop_toxic(table(spark, rows), labels).count() == int((got["predicted"] == 0).sum())


def test_gradients_match_differences():
    net = toxicity.Network(2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, index, mask = ["bad", "good", "fine"], np.array([[0, 1, 2], [2, 1, 0]]), np.array([[True, True, True], [True, True, False]])
    target = np.array([1.0, 0.0])

    def loss():
        p = toxicity.sigmoid(net.logits(net.inputs(toxicity.word_hashes(words))[0].astype(np.float64), index, mask))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    g, _ = net.gradients(words, index, mask, target)
    for name in ("out", "att", "own_f", "own_b", "in_f", "bias_b"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept = net.w[name][at]
        sides = []
        for step in (1e-3, -1e-3):
            net.w[name][at] = kept + step
            sides.append(loss())
        net.w[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - g[name][at]) < 1e-3 + 0.02 * abs(g[name][at])


_MODELS = {}


def likelihood_difference(given, asked):
    """Mean log-likelihood difference of a url under two Witten-Bell models, counted in dictionaries."""
    if not given[asked]:
        return 0.0
    if not _MODELS:
        for url, says, held in _TAUGHT:
            if says and not held:
                own = b"\2" * 4 + url.lower().encode() + b"\3"
                for i in range(4, len(own)):
                    for order in range(5):
                        _MODELS.setdefault((says, own[i - order:i]), collections.Counter())[own[i]] += 1

    def probability(says, before, char):
        p = 1 / 257
        for order in range(5):
            followers = _MODELS.get((says, before[4 - order:]))
            if followers:
                p = (followers[char] + len(followers) * p) / (sum(followers.values()) + len(followers))
        return p

    own = b"\2" * 4 + given[asked].lower().encode() + b"\3"
    logs = [math.log(probability("block", own[i - 4:i], own[i])) - math.log(probability("allow", own[i - 4:i], own[i])) for i in range(4, len(own))]
    return sum(logs) / len(logs)


_TAUGHT = []


def test_urls(spark):
    given = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    given += [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y", "https://a.com/fr/#z", "x://y.com/de/1", "http://notexample.org/es/", "http://com", "http://org?/es/", "a://b://c.org/", "http://é.net/" + "long" * 5000]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")}), queries.URL_RULES).toPandas().set_index("page_id")
    assert len(got) == len(given) and set(got["verdict"]) <= {"allow", "block"}
    folds = spark.createDataFrame([(i, u or "") for i, u in enumerate(given)], "i int, u string").select("i", (F.pmod(F.xxhash64("u"), F.lit(urls.CALIBRATION_FOLDS)) == 0).alias("held")).collect()
    held = {r["i"]: r["held"] for r in folds}
    _TAUGHT[:] = [(u, got["verdict"][i] if isinstance(got["rule"][i], str) else None, held[i]) for i, u in enumerate(given)]
    for i, url in enumerate(given):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in queries.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        row = got.loc[i]
        assert (row["host"], row["path"]) == (host, path) and (row["rule"] == best[1] + best[2] and row["verdict"] == best[0] if best else pd.isna(row["rule"]))
    scored = got[got["rule"].isna()]
    want = [likelihood_difference(given, i) for i in scored.index]
    assert np.abs(scored["url_score"].to_numpy() - want).max() < 1e-9 and scored["url_score"].nunique() > 10
    assert [scored["verdict"][i] for i in scored.index if not given[i]] == ["allow"] * 2
    assert (scored["verdict"] == "block").any() and scored["url_score"][scored["verdict"] == "block"].min() > scored["url_score"][(scored["verdict"] == "allow") & np.array([bool(given[i]) for i in scored.index])].max()
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty, queries.URL_RULES).count() == 0


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 3)
    rows = [(0, i) for i in range(50)] + [(1, i) for i in range(49)] + [(k, 0) for k in range(2, 20)] + [(None, 1), (99, 1)]
    facts = [(k, n, f"f{k}") for k, n in [(0, 50), (1, 49), *((k, 1) for k in range(2, 20))]]
    got = components.with_facts(spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(facts, "k long, n long, f string"), ["k"], "n").collect()
    assert sorted((r["k"], r["i"], r["n"], r["f"]) for r in got) == sorted((k, i, n, f) for k, i in rows for kk, n, f in facts if k == kk)
    assert components.with_facts(spark.createDataFrame([], "k long"), spark.createDataFrame([], "k long, n long"), ["k"], "n").count() == 0
