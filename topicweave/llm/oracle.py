"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most FROM r
), steps AS (  -- the sources with the smallest caps per weight are capped first
  SELECT most / weight AS t,
         sum(most) OVER p AS capped, sum(weight) OVER p AS gone,
         lead(most / weight) OVER (ORDER BY most / weight, k) AS next_t
  FROM w WINDOW p AS (ORDER BY most / weight, k ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT 1.5::DOUBLE * sum(source_size) AS words, sum(weight) AS weights, min(most / weight) AS least FROM w
), levels AS (
  SELECT 0.0::DOUBLE AS capped, weights AS rest, least AS next_t, words FROM whole
  UNION ALL
  SELECT capped, weights - gone, next_t, words FROM steps, whole WHERE weights > gone
), level AS (
  SELECT words - capped AS remaining, rest FROM levels
  WHERE next_t IS NULL OR NOT (next_t * rest < words - capped)
  ORDER BY capped, rest DESC LIMIT 1
), t AS (
  SELECT source, k, source_size,
         CASE WHEN most < remaining * weight / rest THEN most ELSE remaining * weight / rest END AS target
  FROM w, level
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('7:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u0
  FROM t
), n AS (
  SELECT d.doc_id, size, source_size, target, floor(rate) AS whole, rate - floor(rate) AS part, u0,
         (row_number() OVER (PARTITION BY d.source ORDER BY size, d.doc_id NULLS LAST) - 1)::DOUBLE AS i
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + floor(part * (i + 1) + u0) - floor(part * i + u0)))::BIGINT AS taken
FROM n
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), x AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
), r AS (
  SELECT key, max(doc_id) AS holder FROM x WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), k AS (
  SELECT x.doc_id, count(*) AS n_lines,
         count(*) FILTER (holder IS NOT NULL AND holder <> x.doc_id) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i)
                  FILTER (holder IS NULL OR holder = x.doc_id), '') AS kept
  FROM x LEFT JOIN r USING (key) GROUP BY x.doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM k
"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _js(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of a list of counts to a list of shares."""
    c, r = f"({counts})[i] / list_sum({counts})", f"({reference})[i]"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({c} + {r}) / 2)) ELSE 0.0::DOUBLE END"
    both = f"({part.format(x=c, c=c, r=r)} + {part.format(x=r, c=c, r=r)}) / 2"
    return (
        f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(0.0::DOUBLE, list_sum(list_transform("
        f"range(1, len({counts}) + 1), lambda i: {both})))) END"
    )


def rules_sql() -> str:
    from topicweave.llm import rules as r

    rules = r.Rules()
    listed = rules.listed
    languages = sorted(rules.words)
    strip = r"[\x20\x09-\x0D]+"
    lose = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))::DOUBLE"
    punctuation = r.PUNCTUATION.replace("'", "''")
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    nearest = lambda own, ref: "list_min([" + ", ".join(
        _js(own, f"{ref}_{x}") for x in languages
    ) + "])"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), h AS (
  SELECT *, list_concat(c, [length(t) - list_sum(c)]) AS classes,
         list_concat(f, [len(w) - list_sum(f)]) AS common
  FROM (
    SELECT *, [{lose(strip)}, {lose(r.SYMBOLS)}, {lose(punctuation)}, {lose(r.UPPER)}, {lose(r.DIGITS)}] AS c,
           list_transform({_quoted(listed)}, lambda k:
             len(list_filter(w, lambda x: lower(x) = k))::DOUBLE) AS f
    FROM d)
), refs AS MATERIALIZED (
  SELECT lang, list_transform(a, lambda x: x / list_sum(a)) AS ca,
         list_transform(b, lambda x: x / list_sum(b)) AS wb
  FROM (SELECT lang, {sums("classes", len(r.CLASSES))} AS a, {sums("common", len(listed) + 1)} AS b
        FROM h WHERE lang IN ({", ".join(f"'{x}'" for x in languages)}) GROUP BY lang)
), wide AS MATERIALIZED (
  SELECT {", ".join(f"any_value({c}) FILTER (lang = '{x}') AS {c}_{x}" for c in ("ca", "wb") for x in languages)}
  FROM refs
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM tri WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT h.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (classes[2])::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars,
         {nearest("classes", "ca")} AS cd, {nearest("common", "wb")} AS wd
  FROM h CROSS JOIN wide LEFT JOIN rep ON rep.doc_id = h.doc_id
), v AS (
  SELECT *, n_words < {rules.min_words}
            OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
         coalesce(n_chars >= {rules.class_guard} AND round(cd, 9) > {rules.max_class_distance}, false)
         OR coalesce(n_words >= {rules.word_guard} AND round(wd, 9) > {rules.max_word_distance}, false) AS stray
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT stray AS kept FROM v
"""

NEAR = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{WORD}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id,
       d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""

TOPK = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), part AS (
  SELECT r, vec_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM v
), score AS (
  SELECT q.r AS qa, c.r AS ca, sum(q.x * c.x) AS s
  FROM part q JOIN part c ON q.i = c.i WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(s, 0)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY coalesce(s, 0) DESC, c.vec_id NULLS LAST)::INTEGER AS rank
  FROM v q JOIN v c ON q.r <> c.r LEFT JOIN score ON qa = q.r AND ca = c.r
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

PHRASES = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang
), occurrence AS (
  SELECT lang, w[i : i + s - 1] AS g
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM piece, (VALUES (1), (2), (3)) AS v(s))
), f AS MATERIALIZED (
  SELECT lang, g, count(*) AS f FROM occurrence GROUP BY lang, g HAVING count(*) >= 10
), candidate AS MATERIALIZED (
  SELECT lang, g, f AS a FROM f WHERE len(g) > 1
), cut AS (
  SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidate) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM cut
), inside AS (
  SELECT lang, g, max(a) AS longer
  FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM candidate WHERE len(g) = 3) GROUP BY lang, g
), ranked AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, l, r, score,
         row_number() OVER (PARTITION BY c.lang
                            ORDER BY score DESC, c.a DESC, encode(array_to_string(c.g, ' '))) AS rank
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * c.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
