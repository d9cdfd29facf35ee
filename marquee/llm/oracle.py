"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from marquee.llm.urls import LONG_SUFFIXES

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
g AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS goal, sum(weight) AS weights FROM w),
o AS (SELECT 2.0::DOUBLE * source_size AS most, weight,
             row_number() OVER (ORDER BY source_size / weight, place) AS k,
             coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, place
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             coalesce(sum(weight) OVER (ORDER BY source_size / weight, place
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_weight
      FROM w),
l AS (SELECT (goal - below) / (weights - below_weight) AS level FROM o, g
      WHERE NOT most <= weight * ((goal - below) / (weights - below_weight)) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size,
             least(2.0::DOUBLE * source_size, weight * coalesce((SELECT level FROM l), 0)) AS target FROM w),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             count(*) OVER (PARTITION BY d.source, doc_id, coalesce(text, '')) AS n,
             row_number() OVER (PARTITION BY d.source, doc_id, coalesce(text, '')) - 1 AS j,
             ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT
             / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(rate * n)::BIGINT + (draw < rate * n - floor(rate * n))::BIGINT AS dealt FROM r),
c AS (SELECT *, dealt // n + (j < dealt % n)::BIGINT AS copies FROM e)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""

# What op3 compares lines by; the lines of a text in order.
OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
m AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS mark FROM l),
n AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
h AS (SELECT source, mark, count(DISTINCT r) AS held FROM m WHERE mark <> '' GROUP BY source, mark),
b AS (SELECT h.source, h.mark FROM h JOIN n ON h.source IS NOT DISTINCT FROM n.source
      WHERE held >= 2 AND held > pages * 0.1::DOUBLE),
k AS (SELECT r, count(*) AS n_lines, count(b.mark) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.mark IS NULL), '') AS text
      FROM m LEFT JOIN b ON m.source IS NOT DISTINCT FROM b.source AND m.mark = b.mark GROUP BY r)
SELECT doc_id, k.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN k USING (r)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS original FROM p),
t AS (SELECT *, original IS NULL OR page_id IS NOT DISTINCT FROM original AS first FROM f)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
           AS payload_digest,
       CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT first THEN original END AS refers_to
FROM t
"""

_TWO = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)


def _level(name: str, groups: str) -> str:
    """Common table expressions that shrink the counts in ``groups`` (key columns, n, good, prior)."""
    return f"""
{name}_m AS (SELECT sum(CASE WHEN n > 0 THEN n * pow(good / n - prior, 2) END) AS seen,
        sum(CASE WHEN n > 0 THEN prior * (1 - prior) END) AS binomial,
        sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) END) AS room FROM {groups}),
{name}_s AS (SELECT CASE WHEN room > 0 AND seen > binomial
        THEN greatest(1.0, least(1e4, room / (seen - binomial) - 1)) ELSE 1e4 END AS strength FROM {name}_m),
{name} AS (SELECT *, good + strength * prior AS a, n - good + strength * (1 - prior) AS b,
        (good + strength * prior) / (n + strength) AS mean FROM {groups}, {name}_s)"""


OP8 = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
e AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 1 AND toxic = 0)::INT) AS good FROM labels
      WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id),
hc AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good, regexp_replace(host, ':[0-9]*$', '') AS name
      FROM u LEFT JOIN e USING (page_id) GROUP BY host),
hp AS (SELECT *, string_split(name, '.') AS parts, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM hc),
hs AS (SELECT *, CASE WHEN two IN ({_TWO}) THEN two ELSE parts[-1] END AS suffix,
           CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN name
                WHEN two IN ({_TWO}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM hp),
top AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS prior FROM hs),
sg AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(prior) AS prior FROM hs, top GROUP BY suffix),
{_level("sl", "sg")},
dg AS (SELECT domain, suffix, sum(hs.n) AS n, sum(hs.good) AS good, any_value(sl.mean) AS prior
       FROM hs JOIN sl USING (suffix) GROUP BY domain, suffix),
{_level("dl", "dg")},
hg AS (SELECT host, hs.n, hs.good, dl.mean AS prior FROM hs JOIN dl USING (domain, suffix)),
{_level("hl", "hg")},
r(of, start, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
       ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT u.*, says, of || start AS rule,
             row_number() OVER (PARTITION BY u.rowid ORDER BY length(of || start) DESC NULLS LAST) AS k
      FROM (SELECT *, row_number() OVER () AS rowid FROM u) u
      LEFT JOIN r ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start))
SELECT page_id, f.host, path, rule,
       coalesce(says, CASE WHEN mean + 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) < 0.5 THEN 'block' ELSE 'allow' END)
           AS verdict
FROM f JOIN hl USING (host) WHERE k = 1
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c
      ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

LEVELS = 40  # of a tree, enough for any number of rows

# CRC-32 by a table of 256 numbers, made from the polynomial.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || list_transform(range(8), lambda _: 0::BIGINT),
        lambda c, _: xor(c >> 1, ((c & 1) * 3988292384)::BIGINT))) AS t)"""


def _crc(text: str) -> str:
    """CRC-32 of a text, unsigned; the table is the column ``t``."""
    numbers = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {numbers}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, key: str, leaves: str) -> str:
    """Nodes of all levels: (key, level, pos, total, h), from ``leaves`` (key, pos, total, h); parents by pairs."""
    levels = [f"{name}0 AS (SELECT {key}, 0 AS level, pos, total, h FROM {leaves})"]
    for level in range(1, LEVELS):
        levels.append(
            f"{name}{level} AS (SELECT {key}, {level} AS level, pos // 2 AS pos, (any_value(total) + 1) // 2 AS total, "
            f"CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h "
            f"FROM {name}{level - 1} GROUP BY {key}, pos // 2)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM {name}{level}" for level in range(LEVELS))
    return ", ".join(levels) + f", {name} AS ({every})"


def _way(name: str, key: str, leaves: str, asked: str) -> str:
    """Per leaf of ``leaves`` (key, asked, pos) the siblings from below: L or R for their side, and their digest."""
    same = f"n.{key} IS NOT DISTINCT FROM l.{key} AND n.level = g.level AND n.pos = xor(l.pos >> g.level, 1)"
    return f"""SELECT {asked}, list((CASE WHEN n.pos < (l.pos >> g.level) THEN 'L' WHEN n.pos IS NULL THEN 'N' ELSE 'R' END)
        || coalesce(n.h, '') ORDER BY g.level) FILTER (WHERE l.total > (1::BIGINT << g.level)) AS way
        FROM {leaves} l CROSS JOIN (SELECT unnest(range({LEVELS}))::INT AS level) g LEFT JOIN {name} n ON {same} GROUP BY {asked}"""


OP11 = f"""
WITH c AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('n_chars')} AS h, {_leaf('(n_chars::HUGEINT + 1)')} AS other,
             coalesce({_crc('doc_id::VARCHAR')} % 7 = 0, false) AS bad FROM documents, c),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, r) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS total FROM d),
{_tree("a", "lang", "l")},
s AS (SELECT 0 AS k, lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
      FROM a WHERE level = {LEVELS - 1}),
{_tree("b", "k", "s")},
w AS ({_way("a", "lang", "l", "r")}),
v AS ({_way("b", "k", "s", "lang")}),
p AS (SELECT l.*, s.h AS subroot, (SELECT h FROM b WHERE level = {LEVELS - 1}) AS root,
             coalesce(w.way, []) || coalesce(v.way, []) AS way
      FROM l JOIN w USING (r) JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN v ON v.lang IS NOT DISTINCT FROM l.lang),
f AS (SELECT *, list_reduce([CASE WHEN bad THEN other ELSE h END] || way, lambda x, y: sha256(
        CASE y[1] WHEN 'L' THEN y[2:] || x WHEN 'R' THEN x || y[2:] ELSE x END)) AS folded_root FROM p)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda y: y[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM f
"""

OP12 = rf"""
WITH c AS {_CRC_TABLE},
x AS (SELECT row_number() OVER () AS r, 's' AS side, doc_id, text FROM documents
      UNION ALL SELECT NULL, 't', NULL, text FROM benchmark),
w AS (SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS (SELECT r, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM w),
e AS (SELECT feature, {_crc("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM g), c),
b AS (SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t
      FROM g JOIN e USING (feature) GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
k AS (SELECT bucket, floor(1000 * ln(((b.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE) / ((b.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT
      AS gain FROM b, z),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM g JOIN e USING (feature) JOIN k USING (bucket) WHERE side = 's' GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_words,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w WHERE side = 's'),
q AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM h LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features, weight) AS place,
             count(*) FILTER (WHERE n_words >= 20) OVER () * 25 // 100 AS drawn FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM o
"""

ORACLE = {"op1_mixing": OP1, "op3_line_dedup": OP3, "op4_jaccard": OP4, "op5_top_k": OP5, "op6_warc": OP6, "op8_url_filter": OP8}
ORACLE |= {"op11_merkle": OP11, "op12_importance": OP12}
