"""The Merkle manifest and the source audit against brute force and SQL; boosted trees by labels kept out and by plain loops."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import boosting, divergence, merkle, queries

SF = "/root/testdata/sf0.001"
CLASHING = "id group tree digest claim place level path root leaf term n docs rows rank value item part label x score key block a b".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    (1, "a\nb", "en", "s", 3), (2, None, "en", "s", None), (3, "", None, "s", 0), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (4, "x", "en", None, 1), (5, "x", "en", "", 1), (6, "Ä\n\nö", "de", "ü", 4), (7, "x" * 70_000 + "\n", "de", "t", 70_001),
    *[(8, "same", "de", "t", 4)] * 5, *[(i, f"word{i % 7}\nand\n{i}", "en", "hot", 9) for i in range(100, 900)],
]


def table(spark, rows, schema=SCHEMA):
    """rows, beside columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_source_divergence"])
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert plain(got) == sorted(want, key=repr)


# The manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tampered(doc_id, text):
    return text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


def manifest_by_hand(rows):
    leaf = lambda *values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, tampered(doc_id, text)), doc_id))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    order = sorted(groups, key=lambda s: b"" if s is None else b"g" + s.encode())
    own = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels([own[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for i, (_, _, leaf_now, claim, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof = ""
            for tree, at in ((own[s], i), (top, number)):
                for nodes in tree[:-1]:
                    run = nodes[at // 3 * 3:at // 3 * 3 + 3]
                    proof += "".join(run[:at % 3] + run[at % 3 + 1:])
                    claim = sha("".join(run[:at % 3] + [claim] + run[at % 3 + 1:]))
                    at //= 3
            out.append((doc_id, leaf_now, own[s][-1][0], top[-1][0], sha(proof), claim, claim == top[-1][0]))
    return sorted(out, key=repr)


def made(docs):
    even = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(2)) == 0
    return merkle.manifest(docs, found={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("depth", [1, 5])
def test_manifest_by_hand(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "WIDTH", 3**depth)
    rows = HARD if depth == 5 else HARD[:60]
    got = plain(made(table(spark, rows)))
    assert got == manifest_by_hand(rows) and {True, False} == {r[-1] for r in got}


def test_manifest_of_one_row_and_of_none(spark):
    one = made(table(spark, [(1, "a", "en", "s", 1)])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("") and one["verified"]
    assert made(table(spark, [])).count() == 0


def test_preimages_are_those_of_the_parents(spark):
    """What is stored for a leaf holds its digest in its slot, and each preimage's digest stands in the slot of the next."""
    rows = merkle.manifest(table(spark, HARD)).collect()
    for r in rows:
        digest = r["leaf"]
        for step in r["path"]:
            assert step["preimage"][64 * step["slot"]:64 * step["slot"] + 64] == digest
            digest = sha(step["preimage"])
        assert digest == r["root"] and r["verified"]


# The audit


def audit_by_hand(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, sources = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        sources[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in own}
        q = share(sum((counts[lang, s] for s in own), collections.Counter()))
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[u][t]) for t in kept), u.encode()) for u in own if u != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


TEXTS = [
    ("en", "a", "The cat, the Dog; it's ÉCOLE école"), ("en", "b", "the cat the cat THE"), ("en", "c", "dog dog the école"), ("en", "c", None), ("en", "d", ""), ("en", "e", "1234 !?"), (None, None, "the the"), ("", None, "the cat"), ("", "x", "the"),
    ("de", "only", "ein ein ein"), ("de", "only", "ein"), ("de", "only", "ein"), ("fr", "a", "un"), ("fr", "b", "deux"), ("en", "a", "the cat " * 3000), ("en", "b", "x" * 9000 + " the dog"), ("en", "f", "日本 the_the\u00a0the"), *[("en", "a", "copy of the cat")] * 4,
]


@pytest.mark.parametrize("bucket,block", [(50_000, 512), (2, 2), (3, 1)])
def test_audit_by_hand(spark, bucket, block):
    got = divergence.audit(table(spark, TEXTS, "lang string, source string, text string"), bucket_size=bucket, block_size=block)
    assert plain(got) == audit_by_hand(TEXTS)


def test_audit_to_a_rank_and_of_nothing(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, source string, text string")
    assert plain(divergence.audit(docs, top=1, min_docs=1)) == audit_by_hand(TEXTS, 1, 1)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_texts_are_counted_in_parts_that_cut_no_term():
    text = ("alpha Beta " * 50 + "g" * 300 + " " + "delta").encode()
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "en"], "source": ["s", "s", "t"], "text": [text.decode(), "", "beta"]})
    for limit in (7, 40, 10_000):
        sums = collections.Counter()
        for out in divergence.count_terms(iter([batch]), limit):
            for r in out.to_pylist():
                sums[r["source"], r["term"], "n"] += r["n"]
                sums[r["source"], r["term"], "docs"] += r["docs"]
        assert sums == collections.Counter({("s", b"alpha", "n"): 50, ("s", b"alpha", "docs"): 1, ("s", b"beta", "n"): 50, ("s", b"beta", "docs"): 1, ("s", b"g" * 300, "n"): 1, ("s", b"g" * 300, "docs"): 1, ("s", b"delta", "n"): 1, ("s", b"delta", "docs"): 1, ("t", b"beta", "n"): 1, ("t", b"beta", "docs"): 1})


def test_terms_keep_their_numbers_where_hashes_deceive():
    data = np.frombuffer(b"ab cd ab ef cd", dtype=np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    for digest in (lambda b: 7, divergence.xxhash.xxh3_64_intdigest, lambda b: b[0] % 2):
        numbers, firsts = divergence.number_slices(data, starts, ends, digest)
        assert numbers.tolist() == [0, 1, 0, 2, 1] and firsts.tolist() == [0, 1, 3]


def test_proportions_are_exact_where_products_pass_64_bits():
    for count, total in ((0, 1), (5, 7), (10**12, 3 * 10**12), (10**15, 10**15 + 1), (123_456_789_012, 987_654_321_098_765)):
        assert divergence.proportions(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


# Boosted trees


def test_quality_of_labels_kept_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = boosting.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    good, bad = (held["score"][held["quality"] == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert held["predicted"][held["quality"] == 1].mean() > 0.97 and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))


def test_quality_of_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "x" * 60_000), (6, "many words " * 60_000), (6, "other"), (None, "no id"), (7, "日本 🙂 é"), (8, "same"), (9, "same"), *[(i, f"text {i} of some words") for i in range(10, 60)]]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    got = boosting.quality(table(spark, rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2] and scores[8] == scores[9]
    for given, want in ((labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0), (labels.limit(0), 0.5)):
        assert {r["score"] for r in boosting.quality(table(spark, rows[:4], "doc_id long, text string"), given).collect()} == {want}
    assert boosting.quality(table(spark, [], "doc_id long, text string"), labels).count() == 0


def statistics_of(text):
    return boosting.statistics(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))[0]


def test_statistics_by_hand(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()] + ["", "a a a a b", "A\nA\n\nb c\nb c", "x! y? #z# *", "Éa B"]
    together = [t.encode() for t in texts]
    whole = boosting.statistics(np.frombuffer(b"".join(together), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in together])]))
    at = {name: i for i, name in enumerate(boosting.FEATURES)}
    for text, row in zip(texts, whole, strict=True):
        assert np.allclose(row, statistics_of(text), atol=1e-12)  # whatever stands beside it
        words = re.findall("[^\x20\x09-\x0D]+", text)
        runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        lines = [tuple(re.findall("[^\x20\x09-\x0D]+", x)) for x in text.split("\n")]
        lines = [x for x in lines if x]
        n, times = max(1, len(words)), collections.Counter(words)
        want = {
            "log_words": np.log1p(len(words)), "distinct": len(times) / n, "commonest": max(times.values(), default=0) / n, "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / n, "lines": len(lines) / n,
            "repeated_runs": sum(c for c in collections.Counter(runs).values() if c > 1) / n, "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "bangs": text.count("!") / n, "word_bytes": sum(len(w.encode()) for w in words) / n,
            "symbol_ends": sum(w[-1] in "#*$%&|<>{}[]\\^~=_@+" for w in words) / n, "short_words": sum(len(w.encode()) <= 2 for w in words) / n,
        }
        for name, value in want.items():
            assert abs(row[at[name]] - value) < 1e-9, name


def test_flattened_trees_answer_like_nested_ones():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.train(x, y, np.ones(600), trees=40, depth=3)
    own = trees.scores(x)
    assert ((own > 0.5) == (y == 1)).mean() > 0.95
    for i in range(0, 600, 37):
        total = trees.base
        for node in trees.roots.tolist():
            while trees.child[node] != node:
                node = int(trees.child[node]) + int(x[i, trees.feature[node]] > trees.limit[node])
            total += trees.value[node]
        assert abs(own[i] - 1 / (1 + np.exp(-total))) < 1e-12


def test_the_first_cut_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(200, 4)), 1), rng.integers(0, 2, 200).astype(float)
    y[x[:, 2] > 0.4] = 1
    weight = np.ones(200)
    tree = boosting.train(x, y, weight, trees=1, depth=1, bins=1000)
    p = y.mean()
    grad, hess, best = p - y, np.full(200, p * (1 - p)), (0, None)
    for f in range(4):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(hess[left].sum(), hess[~left].sum()) < boosting.LEAST_WEIGHT / 4:
                continue
            gain = grad[left].sum() ** 2 / (hess[left].sum() + boosting.PULL) + grad[~left].sum() ** 2 / (hess[~left].sum() + boosting.PULL)
            best = max(best, (gain, f, tuple(left)), key=lambda b: b[0])
    assert tree.feature[0] == best[1] and tuple(x[:, best[1]] <= tree.limit[0]) == best[2]
