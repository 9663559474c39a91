"""The operators as registered queries, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.boosting import quality
from plumbline.llm.bpe import encode_and_decode
from plumbline.llm.chat import format_turns, prefix_examples, read_back
from plumbline.llm.common import placed, table
from plumbline.llm.divergence import audit
from plumbline.llm.exact_dedup import exact_groups
from plumbline.llm.html_text import extract_text
from plumbline.llm.merkle import manifest
from plumbline.llm.near_dedup import near_groups
from plumbline.llm.packing import pack
from plumbline.llm.quality import quality_rules
from plumbline.llm.sharding import uniform_shards
from plumbline.llm.toxicity import toxicity
from plumbline.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards(table(spark, sf_dir, "documents"), 16)


#: A conversation whose texts hold another template's control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = format_turns(rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")))
    return read_back(turns, prefix_examples(turns))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(placed(table(spark, sf_dir, "documents"), "row"), row_col="row").select("doc_id", "group_id", "group_size", "kept")


#: Verdict, host and path of the url rules.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(2)) == 0
    found = {"text": F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    return manifest(table(spark, sf_dir, "documents"), found=found).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_toxicity, op2_sharding, op3_chat_formatting, op4_html_extraction, op5_byte_bpe, op6_quality_rules, op7_best_fit_packing, op8_exact_dedup, op9_near_dedup, op10_url_filter, op11_quality_classifier, op12_merkle_manifest,
    op13_source_divergence,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        # Control strings get a backslash behind their first character, one more if there are some; then each turn is marked.
        "op3_chat_formatting": r"""
            WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e AS (SELECT *, length('<|im_start|>' || regexp_replace(role, '(<|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g') || '<|im_sep|>'
                || regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g') || '<|im_end|>' || chr(10)) AS chars FROM r),
            p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stream FROM e)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                CAST(coalesce(sum(stream) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
            FROM p GROUP BY conv_id""",
        "op8_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
        # The walk: each leaf with its siblings level by level, to its group's root and on to the root; crc32 bit by bit.
        "op12_merkle_manifest": r"""
            WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 'g' || source END AS tree, text,
                    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                        lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END) % 2 = 1 AS even,
                    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
            leaves AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS now, head FROM d),
            l AS (SELECT doc_id, tree, leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
            nodes AS (SELECT tree, 0 AS level, place, leaf AS h, n FROM l
                UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3),
            sub AS (SELECT tree, max_by(h, level) AS subroot, max(level) AS height, row_number() OVER (ORDER BY tree) - 1 AS rank FROM nodes WHERE n = 1 GROUP BY tree),
            tops AS (SELECT 0 AS level, rank AS place, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
                UNION ALL SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3),
            every AS (SELECT tree, level, place, h, n FROM nodes UNION ALL SELECT NULL, level, place, h, n FROM tops),
            sib AS (SELECT tree, level, place, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS l, coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r
                FROM every WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, place // 3 ORDER BY place)),
            walk AS (SELECT doc_id, leaf, tree, 0 AS level, place, claim AS h, '' AS proof, l.tree AS own FROM l
                UNION ALL SELECT doc_id, leaf, x.tree, level + 1, place // 3, sha256(sl || h || sr), proof || sl || sr, own
                FROM (SELECT w.*, s.l AS sl, s.r AS sr FROM walk w JOIN sib s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place) x),
            low AS (SELECT w.*, s.rank, s.subroot FROM walk w JOIN sub s ON s.tree = w.tree AND s.height = w.level),
            up AS (SELECT doc_id, leaf, own, subroot, 0 AS level, rank AS place, h, proof FROM low
                UNION ALL SELECT doc_id, leaf, own, subroot, level + 1, place // 3, sha256(sl || h || sr), proof || sl || sr
                FROM (SELECT u.*, s.l AS sl, s.r AS sr FROM up u JOIN sib s ON s.tree IS NULL AND s.level = u.level AND s.place = u.place) x),
            root AS (SELECT max_by(h, level) AS root, max(level) AS height FROM tops WHERE n = 1)
            SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM up, root WHERE level = height""",
        "op13_source_divergence": r"""
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
            groups AS (SELECT DISTINCT lang, source FROM d),
            kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
            c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
            v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
            g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
            p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (coalesce(sum(n), 0) + 1)) // (any_value(total) + any_value(v.v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
            pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
            terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
            r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
                UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    }
