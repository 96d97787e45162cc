"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, html_blocks, importance, mixing, ngram_join, ordinal_quality, packing, perspectives, repetition, sharding, toxicity, warc
from .runtime import read


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file that the box holds for all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but thin (fewer than 100 words, or a line again), 2 good.  Kept: 1 or better is likelier
    than not."""
    docs = read(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    thin = (F.regexp_count("text", F.lit(mixing.WORD)) < 100) | (F.size(F.array_distinct(lines)) < F.size(lines))
    ratings = docs.select("doc_id", F.when(thin, 1).otherwise(2).alias("good")).join(read(spark, sf_dir, "labels"), "doc_id")
    return ordinal_quality.ordinal_quality(docs, ratings.select("doc_id", (F.col("quality") * F.col("good")).alias("grade")), grades=3, select_grade=1, least_tail=0.5)


def op2_html_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(read(spark, sf_dir, "pages"))


def op3_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir, "documents"), least_words=5, most_covered=20, most_longest=50)


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(16)
    rows = sharding.hash_tree_shards(read(spark, sf_dir, "documents"), tree, sharding.grown_tree(tree, 16))
    return rows.withColumn("law", F.lit("key"))


def op5_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"), cap=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents"), width=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(read(spark, sf_dir, "conversations"))


def op10_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_html_block_tree": op2_html_block_tree,
    "op3_suffix_array_repetition": op3_suffix_array_repetition,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_patricia_exact_dedup": op5_patricia_exact_dedup,
    "op6_water_filling_mix": op6_water_filling_mix,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_perspective_rotation": op9_perspective_rotation,
    "op10_linear_grouping_packing": op10_linear_grouping_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_warc_salvage": op12_warc_salvage,
    "op13_source_divergence": op13_source_divergence,
}

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_suffix_array_repetition": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        word AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
        gram AS (SELECT r, pos, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS g
                 FROM word WINDOW w AS (PARTITION BY r ORDER BY pos)),
        five AS (SELECT r, pos, g, count(*) OVER (PARTITION BY r, g) AS c FROM gram WHERE g IS NOT NULL),
        again AS (SELECT r, pos, g FROM five WHERE c > 1),
        inside AS (SELECT DISTINCT r, unnest(range(pos, pos + 5)) AS pos FROM again),
        repeats AS (SELECT i.r, count(*) AS n_repeat_words, sum(length(w.word)) AS repeat_chars FROM inside i JOIN word w ON w.r = i.r AND w.pos = i.pos GROUP BY i.r),
        -- two equal places of m words are m - 4 equal windows on one diagonal
        pairs AS (SELECT x.r, x.pos, y.pos - x.pos AS gap FROM again x JOIN again y ON x.r = y.r AND x.g = y.g AND x.pos < y.pos),
        runs AS (SELECT r, gap, pos - row_number() OVER (PARTITION BY r, gap ORDER BY pos) AS run FROM pairs),
        lengths AS (SELECT r, max(n) + 4 AS longest_repeat FROM (SELECT r, count(*) AS n FROM runs GROUP BY r, gap, run) GROUP BY r),
        lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        m AS (
            SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(d.words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(repeat_chars, 0)::BIGINT AS repeat_chars,
                   coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
            FROM docs d LEFT JOIN repeats x ON x.r = d.r LEFT JOIN lengths l ON l.r = d.r LEFT JOIN dup p ON p.r = d.r
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * repeat_chars <= 20 * word_chars AND longest_repeat <= 50 AS kept
        FROM m""",
    "op5_patricia_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
        g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(text) DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY plain) AS group_size, sha256(plain) AS text_sha256 FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op6_water_filling_mix": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                          ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS draw FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s),
        l AS (SELECT k, 3 * source_size AS cap, w, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
                     / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM o),
        t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * (SELECT arg_min(level, k) FROM l WHERE cap > level * w)) AS target FROM s),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
        p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target, epochs, greatest(0, least(size, rest - before))::BIGINT AS part,
               (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p""",
    "op9_perspective_rotation": r"""
        WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS k
                   FROM conversations),
        s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
        v AS (SELECT t.conv_id, s.speaker, k, k // 256 AS run, coalesce(t.role = s.speaker, false) AS own, t.text,
                     CASE WHEN t.role = 'system' THEN '<|system|>' WHEN t.role = s.speaker THEN '<|assistant|>'
                          ELSE '<|user name=' || coalesce(t.role, 'unknown') || '|>' END || chr(10) AS head
              FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        p AS (SELECT *, length(head) + length(text) + 1 AS n,
                     coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a FROM v),
        r AS (SELECT conv_id, speaker, run::INTEGER AS run, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
                     string_agg(head || text || chr(10), '' ORDER BY k) AS text,
                     coalesce(string_agg(a || '-' || (a + length(text)), ',' ORDER BY k) FILTER (WHERE own), '') AS mask, sum(n) AS n FROM p GROUP BY ALL)
        SELECT conv_id, speaker, run, n_turns, n_own, text, mask,
               coalesce(sum(n) OVER (PARTITION BY conv_id, speaker ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r""",
    "op11_importance_resampling": rf"""
        WITH RECURSIVE poly AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
                      UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS tab FROM poly WHERE k = 8),
        words AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
                  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        feature AS (SELECT side, r, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2]))) AS f FROM words),
        known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)),
        slot AS (SELECT f, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT),
                               4294967295) % 10000 AS bucket FROM known, crc),
        placed AS (SELECT side, r, bucket FROM feature JOIN slot USING (f)),
        n AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM placed GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS g FROM n),
        mean AS (SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
        scored AS (SELECT d.id AS doc_id, d.r, len(d.w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                   FROM words d LEFT JOIN mean USING (r) WHERE d.side = 0),
        placed_all AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
        SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM placed_all""",
    "op12_warc_salvage": r"""
        WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM p)
        SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o""",
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_SMALL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        word AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        n AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS docs FROM word GROUP BY ALL),
        kept AS (SELECT lang, term FROM n GROUP BY ALL HAVING sum(docs) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT lang, source FROM d),
        cell AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0)::HUGEINT AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
        p AS (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p FROM cell JOIN v USING (lang)),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM cell GROUP BY ALL) JOIN v USING (lang)),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
                 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
        term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= 200""",
}
