"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from depweave.llm import ann, bpe, html_extract, langid, line_dedup, ngram_join, packing, quality, sharding, spelling, stream_packing, suffix_dedup, token_align
from depweave.session import table


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_string_kernel_languages(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_small_world_search(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_wrapper_extraction(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_similar_line_removal(spark, sf_dir):
    return line_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op5_sparse_product_jaccard(spark, sf_dir):
    return ngram_join.link_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_bounded_ring_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_sum_of_squares_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_merged_transform_dedup(spark, sf_dir):
    return suffix_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op9_tree_bpe(spark, sf_dir):
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_risk_controlled_rules(spark, sf_dir):
    return quality.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ordered_rules(spark, sf_dir):
    return quality.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ordered=True)


def op11_frequency_trie_variants(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_bounded_space_packing(spark, sf_dir):
    return stream_packing.pack_stream(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_span_alignment(spark, sf_dir):
    return token_align.align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def queries():
    return {f.__name__: f for f in (
        op1_string_kernel_languages, op2_small_world_search, op3_wrapper_extraction,
        op4_similar_line_removal, op5_sparse_product_jaccard, op6_bounded_ring_shards, op7_sum_of_squares_packing,
        op8_merged_transform_dedup, op9_tree_bpe, op10_risk_controlled_rules, op10_ordered_rules,
        op11_frequency_trie_variants, op12_bounded_space_packing, op13_span_alignment,
    )}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    walk(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(walk.b) AS component_id FROM documents d JOIN walk ON walk.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    win AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(n - 49)) AS s FROM t WHERE n >= 50)),
    elder AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
    gone AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
        FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM win JOIN elder USING (g) WHERE first < doc_id)),
    spans AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM gone GROUP BY doc_id, run)),
    kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM spans JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT t.doc_id, CAST(t.n AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""


def _rules_sql() -> str:
    """The base features, the exact binomial tests and the verdict."""
    rules = list(quality.CUTOFFS)
    values = ", ".join(f"('{r}', {c})" for r in rules for c in quality.CUTOFFS[r])
    tests = sum(map(len, quality.CUTOFFS.values()))
    ratio = {"symbols": "n_symbols / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)", "long_words": "word_chars / nullif(n_words, 0)"}
    over = " OR ".join(f"coalesce(v_{r} > cutoff_{r}, false)" for r in rules)
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
    r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
    f AS (SELECT t.doc_id, stratum, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS bigint) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS bigint) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"coalesce({x}, 0.0) AS v_{r}" for r, x in ratio.items())} FROM f),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    held AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
    cut(rule, cutoff) AS (VALUES {values}),
    k AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (CASE rule {" ".join(f"WHEN '{r}' THEN v_{r}" for r in rules)} END > cutoff) AS k FROM held, cut GROUP BY ALL),
    strata AS (SELECT count(DISTINCT stratum) AS m FROM held), a AS (SELECT {0.02 / len(rules)!r} AS p),
    ok AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM k, strata, a WHERE k <= n * p
        AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) <= 0.05 / ({tests} * m) GROUP BY stratum, rule),
    used AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}')::DOUBLE AS cutoff_{r}" for r in rules)} FROM ok GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept, {", ".join(f"cutoff_{r}" for r in rules)} FROM v LEFT JOIN used USING (stratum)"""


def oracle_sql():
    return {"op5_sparse_product_jaccard": _JACCARD, "op8_merged_transform_dedup": _REPEATS, "op10_risk_controlled_rules": _rules_sql()}
