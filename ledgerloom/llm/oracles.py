"""SQL of the numbered queries that SQL can state, over whole tables."""

from __future__ import annotations

from ledgerloom.llm.license_rules import all_rules, known_sentences
from ledgerloom.llm.quality_sketch import LEAST, MEASURES

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _op3() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    double = lambda s: "  ".join(["", *s.split(), ""])
    known = ", ".join(f"({quote(double(text))}, {quote(name)}, {len(double(text))})" for text, name in known_sentences().items())
    first = "|".join(sorted({text.split()[0] for text in known_sentences()}))
    rules = ", ".join(f"({i}, {quote(licence)}, [{', '.join(map(quote, own))}])" for i, (licence, own) in enumerate(all_rules()))
    return f"""
WITH RECURSIVE known(plain, name, size) AS (VALUES {known}
), rules(rule, licence, own) AS (VALUES {rules}
), texts AS (
  SELECT doc_id, '  ' || replace(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || '  ' AS t FROM documents
), likely AS MATERIALIZED (
  SELECT * FROM texts WHERE regexp_matches(t, '  ({first})  ')
), cut AS (
  SELECT doc_id, name, size, string_split(t, plain) AS parts FROM likely JOIN known ON contains(t, plain)
), ends AS (
  SELECT doc_id, name, size, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * size AS start
  FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM cut)
), found AS (
  SELECT doc_id, name, start FROM ends a WHERE NOT EXISTS (
    SELECT 1 FROM ends b WHERE b.doc_id = a.doc_id AND b.size > a.size AND b.start <= a.start AND b.start + b.size >= a.start + a.size)
), listed AS (
  SELECT doc_id, list(name ORDER BY start) AS names FROM found GROUP BY doc_id
), steps(doc_id, rule, k, place) AS (
  SELECT doc_id, rule, 0, -1::DOUBLE FROM listed, rules WHERE list_has_any(names, own)
  UNION ALL
  SELECT s.doc_id, s.rule, s.k + 1, min(f.start)::DOUBLE
  FROM steps s JOIN rules r ON r.rule = s.rule JOIN found f ON f.doc_id = s.doc_id AND f.name = r.own[s.k + 1] AND f.start > s.place
  GROUP BY s.doc_id, s.rule, s.k
), hits AS (
  SELECT doc_id, s.rule, licence, own FROM steps s JOIN rules r ON r.rule = s.rule AND s.k = len(own)
), reported AS (
  SELECT DISTINCT doc_id, licence FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits w WHERE w.doc_id = h.doc_id AND w.licence <> h.licence AND len(w.own) > len(h.own)
      AND list_filter(w.own, lambda x: list_contains(h.own, x)) = h.own)
), joined AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM reported GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(names), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(names, ','), '') AS sentences, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN joined USING (doc_id)
"""


OP4 = """
WITH facts AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), digits AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS INT), 5) AS INT)) AS v,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a
  FROM facts
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr(a, 1 + ((x >> 15) & 31), 1) || substr(a, 1 + ((x >> 10) & 31), 1)
    || substr(a, 1 + ((x >> 5) & 31), 1) || substr(a, 1 + (x & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _op6() -> str:
    cells = ", ".join(f"('{m}', {m})" for m in MEASURES)
    cuts = ", ".join(
        f"max(CASE WHEN measure = '{m}' THEN q3 + 3 * (q3 - q1) + {high} END) AS {m}_high, "
        + (f"max(CASE WHEN measure = '{m}' THEN q1 - 3 * (q3 - q1) - {low} END)" if low else "NULL") + f" AS {m}_low"
        for m, (low, high) in MEASURES.items()
    )
    inside = " AND ".join([f"r.{m} <= f.{m}_high" for m in MEASURES] + [f"r.{m} >= f.{m}_low" for m, (low, _) in MEASURES.items() if low])
    symbols = r"regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')"
    return f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w, length({symbols}) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), '\n'), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), rows AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_share, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share, 100 * word_chars // greatest(n_words, 1) AS word_length
  FROM rows
), cells AS (
  SELECT lang, source, c.measure, c.v, CASE WHEN c.v < 32 THEN 31 ELSE length(bin(c.v)) END AS bits
  FROM judged, LATERAL (VALUES {cells}) c(measure, v) WHERE NOT base_failed
), finest AS (
  SELECT lang, source, measure, CASE WHEN v < 32 THEN v ELSE 32 * (bits - 6) + (v >> (bits - 6)) END AS bin, count(*) AS n FROM cells GROUP BY ALL
), sketch AS (
  SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, measure, bin, sum(n) AS n
  FROM finest, (VALUES (0), (1), (2)) l(level) GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
    CASE WHEN bin < 32 THEN bin ELSE ((bin - 32 * (bin // 32 - 1) + 1) << CAST(bin // 32 - 1 AS INT)) - 1 END AS top
  FROM sketch
), quartiles AS (
  SELECT level, lang, source, measure, max(total) AS n, min(CASE WHEN 4 * upto >= total THEN top END) AS q1,
    min(CASE WHEN 4 * upto >= 3 * total THEN top END) AS q3
  FROM ranked GROUP BY 1, 2, 3, 4
), fences AS (
  SELECT level, lang, source, max(n) AS n, {cuts} FROM quartiles GROUP BY 1, 2, 3
), chosen AS (
  SELECT g.lang AS l, g.source AS s, CASE WHEN g.n >= {LEAST} THEN 0 WHEN h.n >= {LEAST} THEN 1 ELSE 2 END AS level
  FROM fences g JOIN fences h ON g.level = 0 AND h.level = 1 AND g.lang IS NOT DISTINCT FROM h.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({inside}, true) AS kept
FROM judged r LEFT JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.l AND r.source IS NOT DISTINCT FROM c.s
LEFT JOIN fences f ON f.level = c.level AND (c.level = 2 OR f.lang IS NOT DISTINCT FROM r.lang) AND (c.level > 0 OR f.source IS NOT DISTINCT FROM r.source)
"""


OP10 = f"""
WITH words AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM later
), marked AS (
  SELECT a.doc_id, a.p, a.word, g.p IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words) a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p
), counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""

OP3, OP6 = _op3(), _op6()


#: CRC-32 of an ASCII expression, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1),
  lambda i: [ascii(substr({0}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))))"""

# edits as walks through the states start, system, user, assistant; insertions follow the turn they stand behind
_STEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
_INSERTIONS = "(0, 0, ''), (1, 0, ''), (2, 0, ''), (3, 0, ''), (0, 1, 'u'), (0, 2, 'ua'), (1, 1, 'u'), (1, 2, 'ua'), (2, 1, 'a'), (3, 1, 'u')"

OP11 = f"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), marked AS (
  SELECT *, {_CRC.format("k")} % 20 AS m FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE m WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN m = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE m <> 0
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM turns
), steps(s, r, t) AS (VALUES {_STEPS}
), inserted(s, n, roles) AS (VALUES {_INSERTIONS}
), edits AS (
  SELECT j.conv_id, j.i, e.*, text
  FROM judged j, LATERAL (
    SELECT 4 AS cost, 'D' AS edit, s, s AS t, '' AS out FROM range(4) q(s)
    UNION ALL
    SELECT CASE WHEN r = initial THEN 0 ELSE 3 END + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END,
      CASE WHEN r = initial THEN 'K' ELSE 'R' END, s, t, CASE WHEN r = initial THEN role WHEN r = 'u' THEN 'user' ELSE 'assistant' END
    FROM steps WHERE fault NOT IN ('blank', 'duplicate') AND (r = initial OR r <> 's')
  ) e
), moves AS (
  SELECT conv_id, i, e.s, e.cost + 3 * n AS cost, edit || repeat('I', CAST(n AS INT)) AS audit,
    CASE roles WHEN 'u' THEN 2 WHEN 'ua' THEN 3 WHEN 'a' THEN 3 ELSE t END AS t,
    list_concat(CASE WHEN edit = 'D' THEN [] ELSE [out || ':' || text] END,
      CASE roles WHEN 'u' THEN ['user:'] WHEN 'ua' THEN ['user:', 'assistant:'] WHEN 'a' THEN ['assistant:'] ELSE [] END) AS lines
  FROM edits e JOIN inserted x ON x.s = e.t
), walks(conv_id, i, t, best) AS (
  SELECT conv_id, 0::BIGINT, CASE roles WHEN 'u' THEN 2 WHEN 'ua' THEN 3 ELSE 0 END,
    {{'cost': (3 * n)::BIGINT, 'audit': repeat('I', CAST(n AS INT)),
      'lines': CASE roles WHEN 'u' THEN ['user:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END}}
  FROM (SELECT DISTINCT conv_id FROM turns), inserted WHERE s = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({{'cost': (w.best.cost + m.cost)::BIGINT, 'audit': w.best.audit || m.audit, 'lines': list_concat(w.best.lines, m.lines)}})
  FROM walks w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.s = w.t GROUP BY w.conv_id, w.i, m.t
), found AS (
  SELECT w.conv_id, min(best) AS best
  FROM walks w JOIN (SELECT conv_id, max(i) AS n FROM turns GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i
  WHERE t IN (0, 3) GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(f.best.cost, 0) AS cost, coalesce(f.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(f.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.v FROM reached r JOIN links l ON l.u = r.other
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) USING (vec_id)
LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u) USING (vec_id)
"""

OP13 = f"""
WITH plain AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), parted AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS r, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM plain
), texts AS (
  SELECT doc_id, n, CASE WHEN r THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w
  FROM parted
), places AS (
  SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), grams AS (
  SELECT doc_id, n, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS g, w[i + 1:i + 6] AS s
  FROM (SELECT doc_id, n, w, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12)
), twice AS (
  SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), pairs AS (
  SELECT a.doc_id, a.i, b.i - a.i AS p, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
  FROM twice a JOIN twice b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i AND a.s = b.s WHERE 2 * (b.i - a.i) <= a.n
), spans AS (
  SELECT doc_id, p, min(i) AS start, max(i) - min(i) + 6 + p AS length FROM pairs GROUP BY doc_id, p, island
), runs AS (
  SELECT doc_id, start, length, min(p) AS period FROM spans WHERE length >= 2 * p AND length >= 12 GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM places ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), best AS (
  SELECT doc_id, count(*) AS n_runs, min({{'less': -length, 'start': start, 'period': period}}) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, -b.less AS length, b.period AS period, 1000 * -b.less // b.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
