"""DuckDB SQL for the queries of this subpackage that SQL can express.

The near-dedup's SQL is the definition itself: every pair of texts that share a
shingle, and the closure of the similar ones.
"""

from __future__ import annotations

from dialogprep.llm.license_scan import NOT_WORD, PHRASES, TEMPLATES, compile_template, tokens_of
from dialogprep.llm.quality_rules import CHAR_CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, SYMBOLS

_SPACE = r"\x20\x09-\x0D"

ORACLE = {
    "op1_url_filter": """
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                       ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT p.n, max(struct_pack(len := length(r.host || r.path), host_len := length(r.host), rule := r.host || r.path, verdict := r.verdict)) AS v
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n)
SELECT page_id, host, path, v.rule AS rule, coalesce(v.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)""",
    "op2_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS w,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos FROM s),
b AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS s0, coalesce(sum(w) OVER o, 0) AS w0 FROM w
      WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST((SELECT sum(source_size) FROM w) - 3 * s0 AS DOUBLE) / CAST((SELECT sum(w) FROM w) - w0 AS DOUBLE)) AS level FROM b),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.rate,
             CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u,
             CAST(('0x' || substr(md5('mix-1|source|' || coalesce(d.source, '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS border
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
k AS (SELECT source, max(u) AS cut FROM o WHERE CAST(before AS DOUBLE) + size * border < target - floor(rate) * source_size GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * (floor(c.rate) + CASE WHEN c.u <= k.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op11_hard_negatives": """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, a.label AS la, c.vec_id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.n <> c.n WHERE a.vec_id % 100 = 0),
p AS (SELECT n, anchor_id, la, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS nth
      FROM s WHERE label = la QUALIFY nth <= 5),
h AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.n, p.nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.n = s.n AND s.label <> p.la AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5""",
    "op13_top_k": """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _near() -> str:
    return rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^{_SPACE}]+') AS w FROM documents),
n AS (SELECT min(doc_id) AS node, w FROM d GROUP BY w),
s AS (SELECT DISTINCT node, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh
      FROM n WHERE len(w) > 0),
z AS (SELECT node, count(*) AS size FROM s GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.node < b.node GROUP BY a.node, b.node),
e AS (SELECT p.a, p.b FROM p JOIN z x ON x.node = p.a JOIN z y ON y.node = p.b WHERE shared >= 0.8 * (x.size + y.size - shared)),
l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT node, node FROM n UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
m AS (SELECT d.doc_id, c.class_id FROM d JOIN n ON d.w = n.w JOIN c ON c.node = n.node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM m"""


def _license() -> str:
    def pattern(templates) -> str:
        return "|".join(f"(?:{compile_template(t, ' ')})" for t in templates)

    # Every token has a blank of its own on either side.
    every = "|".join(pattern(ts) for ts in TEMPLATES.values())
    hits = ", ".join(f"CASE WHEN regexp_matches(norm, {_q(pattern(ts))}) THEN {_q(label)} END" for label, ts in TEMPLATES.items())
    places, labels = [], []
    for phrase, label in PHRASES:
        words = tokens_of(phrase)
        at = "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = {_q(t)}" for k, t in enumerate(words)) + ")"
        places.append(at)
        labels.append(f"CASE WHEN len({at}) > 0 THEN {_q(label)} END")
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS norm,
             list_concat({", ".join(f"({p})" for p in places)}) AS places,
             list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS base, list_filter([{hits}], lambda x: x IS NOT NULL) AS hit FROM d),
r AS (SELECT *, regexp_replace(norm, {_q(every)}, '', 'g') AS rest FROM n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, hit))), ','), '') AS labels,
       CASE WHEN len(w) > 0 THEN (len(w) - (length(rest) - length(replace(rest, ' ', ''))) // 2)::DOUBLE / len(w) ELSE 0.0 END AS score
FROM r"""


def _quality() -> str:
    classes = ", ".join(f"length(regexp_replace(t, {_q(c)}, '', 'g'))" for c in CHAR_CLASSES)
    hits = ", ".join(f"len(list_filter(low, lambda x: x = {_q(c)}))" for c in COMMON_WORDS)

    def rest(counts: str, total: str) -> str:
        return f"list_append({counts}, greatest({total} - list_sum({counts}), 0))"

    def pooled(name: str, n: int) -> str:
        return "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"

    def distance(p: str, q: str) -> str:
        # Terms of a / (2 m) where a is one side's share and m twice the mean.
        a, b = f"list_sum({p})", f"list_sum({q})"
        x, y = f"({p}[i]::DOUBLE / {a})", f"({q}[i]::DOUBLE / {b})"
        part = lambda s: f"CASE WHEN {s} > 0 THEN {s} * log2(2 * {s} / ({x} + {y})) ELSE 0 END"
        return f"CASE WHEN {a} > 0 AND {b} > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(x)} + {part(y)}) / 2)))) END"

    k, m = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    return rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines,
             list_filter(string_split_regex(lower(t), '[{_SPACE}]+'), lambda x: x <> '') AS low, [{classes}] AS classes,
             length(regexp_replace(t, {_q(SYMBOLS)}, '', 'g')) AS n_symbols FROM d),
win AS (SELECT n, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT n, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT n, count(DISTINCT pos) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY n),
f AS (SELECT w.n, doc_id, lang, length(t) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, classes, [{hits}] AS hits
      FROM w LEFT JOIN cov USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             {rest("classes", "n_chars")} AS c, {rest("hits", "n_words")} AS h FROM f),
r AS (SELECT lang, {pooled("c", k)} AS rc, {pooled("h", m)} AS rh FROM b WHERE NOT base_failed GROUP BY lang),
a AS (SELECT lang, rc, rh FROM r WHERE lang IS NOT NULL
      UNION ALL SELECT NULL, {pooled("rc", k)}, {pooled("rh", m)} FROM r),
x AS (SELECT b.*, CASE WHEN n_chars >= {MIN_CHARS} THEN {distance("c", "rc")} END AS cd, CASE WHEN n_words >= {MIN_WORDS} THEN {distance("h", "rh")} END AS wd
      FROM b LEFT JOIN a ON b.lang IS NOT DISTINCT FROM a.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(cd, 0) > {MAX_CHAR_DISTANCE} OR coalesce(wd, 0) > {MAX_WORD_DISTANCE}) AS kept FROM x"""


ORACLE |= {"op3_near_dedup": _near(), "op6_license_scan": _license(), "op9_quality_rules": _quality()}
