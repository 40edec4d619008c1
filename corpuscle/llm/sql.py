"""SQL twins of the corpus operators that SQL can express, for the tables' own engine."""

from __future__ import annotations

from . import mixing, quality_rules

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _unit(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"


_ESCAPES = r"'\\|<\||</?s>|<</?SYS>>|</?(?:start|end)_of_turn>|</?think>|\[/?INST\]'"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
    n AS (SELECT *, 8 + length(role) + len(regexp_extract_all(role, {_ESCAPES})) + 8 + length(text) + len(regexp_extract_all(text, {_ESCAPES})) + 7 AS size FROM c),
    s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY conv_id) AS total FROM n)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) + any_value(total) - coalesce(max(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""

_CRC = """CAST(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT) AS BIGINT)"""

SHARDS = f"""WITH k AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
    d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_unit(17)} AS u FROM documents), r AS (SELECT doc_id, source, octet_length(encode(t)) + 16 AS size, {_CRC} AS text_crc32, u FROM d, k),
    f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS pos FROM r),
    g AS (SELECT *, row_number() OVER (ORDER BY pos, source NULLS LAST) - 1 AS p, count(*) OVER () AS n FROM f)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p * 40 // n AS INTEGER) AS shard, CAST(p - ((p * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, NULL::INTEGER AS grown_shard FROM g"""


def quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)}))
    tests = []
    for rule in quality_rules.RULES:
        figure = f"({rule.figure.replace('/ nullif', '::DOUBLE / nullif')})"
        bad = " OR ".join([f"{figure} < {rule.low}"] * (rule.low is not None) + [f"{figure} > {rule.high}"] * (rule.high is not None))
        tests.append(f"CASE WHEN coalesce({bad}, false) THEN '{rule.name}' END")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_WORDS})) AS l FROM t),
    x AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i:i + 7], ' '))) AS g, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM w),
    y AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), z AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM y), r AS (SELECT doc_id, sum(k) AS k FROM z GROUP BY doc_id),
    b AS (SELECT w.doc_id, len(w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(w, lambda v: v IN ({stop}))) AS n_stop, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(list_filter(l, lambda v: regexp_matches(v, '^\\s*[-*•]'))) AS n_bullet_lines FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_filter([{', '.join(tests)}], lambda f: f IS NOT NULL) AS f FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(f) = 0 AS kept, array_to_string(f, ',') AS failed_rules FROM v"""


def mixture() -> str:
    walks, before = [], "w0"
    for k in range(1, mixing.WALKS + 1):
        walks.append(
            f"""s{k} AS (SELECT *, sum(CASE WHEN NOT taken AND size > 0 AND size <= due THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q) AS c FROM {before}),
    n{k} AS (SELECT * EXCLUDE (c), NOT taken AND size > 0 AND size <= due AND c <= due AS fresh FROM s{k}),
    w{k} AS (SELECT * EXCLUDE (fresh) REPLACE (taken OR fresh AS taken, due - coalesce(sum(size) FILTER (fresh) OVER (PARTITION BY source), 0) AS due) FROM n{k})"""
        )
        before = f"w{k}"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS size, {_unit(29)} AS u FROM documents),
    a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, greatest(count(*) FILTER (size > 0), 1) AS docs, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
    o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER v, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER v, 0) AS weight FROM a WINDOW v AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max(room / weight) FILTER (room / weight * w <= cap) AS x FROM o), t AS (SELECT source, source_size, source_size / docs AS mean, CASE WHEN x IS NULL THEN cap ELSE least(cap, x * w) END AS target FROM o, l),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t), f0 AS (SELECT *, greatest(0, target - whole * source_size) AS due, least(greatest(greatest(0, target - whole * source_size) / source_size, 1e-12), 1 - 1e-12) AS f FROM p),
    o0 AS (SELECT d.*, source_size, target, whole, due, f / (1 - f) * sqrt(greatest(mean, 1) / greatest(size, 1)) AS odds FROM d JOIN f0 ON d.source IS NOT DISTINCT FROM f0.source),
    q0 AS (SELECT *, least(greatest(odds / (1 + odds), 1e-12), 1 - 1e-12) AS p FROM o0), w0 AS (SELECT * EXCLUDE (odds, p), u / (1 - u) / (p / (1 - p)) AS q, false AS taken FROM q0),
    {', '.join(walks)}
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST((whole + CAST(taken AS INTEGER)) * size AS BIGINT) AS taken FROM {before}"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM g), reps AS (SELECT min(doc_id) AS rep, h, any_value(n) AS n FROM n WHERE n > 0 GROUP BY h),
    x AS MATERIALIZED (SELECT rep, n, unnest(s) AS t FROM reps JOIN g ON rep = doc_id), c AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * k >= 90 * (na + nb - k)), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT rep AS node, rep AS root FROM reps UNION SELECT s.b, r.root FROM reach r JOIN s ON s.a = r.node)
    , roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(rep, n.doc_id) AS class_id, coalesce(root, n.doc_id) AS component_id FROM n LEFT JOIN reps ON n.h = reps.h AND n.n > 0 LEFT JOIN roots ON node = rep"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3"""

ORACLE_SQL = {
    "op1_prefix_target_chat": CHAT,
    "op3_ngram_jaccard_join": JACCARD,
    "op4_stratified_interleave": SHARDS,
    "op5_threshold_rules": quality(),
    "op8_pareto_mix": mixture(),
    "op13_summa_negatives": NEGATIVES,
}
