"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE["op3_mix_sources"] = """
WITH RECURSIVE docs AS (
  SELECT *, coalesce('s' || source, 'n') AS k FROM documents),
sized AS (
  SELECT k, sum(greatest(coalesce(length(text), 0), 1))::BIGINT AS size FROM docs GROUP BY k),
weighed AS (SELECT *, floor(sqrt(size::DOUBLE) * 1000) AS w FROM sized),
rated AS (
  SELECT k, w / sum(w) OVER () * (sum(size) OVER ()::DOUBLE / size::DOUBLE) AS rate
  FROM weighed),
parts AS (SELECT *, greatest(ceil(rate / 8.0), 1)::INTEGER AS n FROM rated),
steps AS (
  SELECT k, n, rate / n AS mean, 0 AS i, exp(-rate / n) AS p, exp(-rate / n) AS c FROM parts
  UNION ALL
  SELECT k, n, mean, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM steps WHERE i < 63),
draws AS (
  SELECT doc_id, d.k, part,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 13))::BIGINT
      ::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT doc_id, k FROM docs) d JOIN parts USING (k), range(0, n) AS r(part)),
counts AS (
  SELECT doc_id, k, count(*) AS times FROM draws JOIN steps USING (k) WHERE c <= u GROUP BY ALL)
SELECT d.* EXCLUDE (k), copy::INTEGER AS copy,
  md5('mix-order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || copy) AS order_key
FROM docs d JOIN counts n ON d.k = n.k AND d.doc_id IS NOT DISTINCT FROM n.doc_id,
  range(0, times) AS r(copy)
"""

_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

ORACLE["op10_dedup_lines"] = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, n, lines[n] AS line FROM cut, range(1, len(lines) + 1) AS r(n)),
keyed AS (SELECT doc_id, n, line, {_KEY} AS key FROM lines),
repeated AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE r.key IS NULL), ''))
    AS kept_sha256
FROM keyed LEFT JOIN repeated r USING (key) GROUP BY doc_id
"""

ORACLE["op4_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b USING (token)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(b) AS component_id
FROM sets s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id
"""


#: One row with the crc32 of each single byte, for ``_crc32``.
_CRC_TABLE = """crc AS (
  SELECT list(t ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) r(b)))"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a SQL text, with the column ``tab`` in reach."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform("
            f"range(strlen({text})), lambda i: "
            f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)), "
            f"lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


ORACLE["op11_spelling"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
named AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS name FROM counted),
hashed AS (SELECT run, n, {_crc32("name")} AS h FROM named, crc),
damaged AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) ||
    substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word
  HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y
    ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.a || c.b),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
chosen AS (
  SELECT word, any_value(n_near) AS n_near, any_value(top) AS top, min(other) AS other
  FROM near JOIN best USING (word) WHERE other_n = top GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top >= 2 * w.n THEN other END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN chosen c ON c.word = w.word),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root
  WHERE f.form IS NOT NULL),
ends AS (
  SELECT chain.word, chain.root FROM chain JOIN formed f ON f.word = chain.root
  WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def _edit(cost: str, letters: str, rest: str) -> str:
    """A cost in nine digits and an audit, with an edit in front of it."""
    return (f"lpad((substr({rest}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || '{letters}' || "
            f"substr({rest}, 10)")


# States: nothing yet, after s, after u, after a; and the state after a row that alternates.
_NEXT = (2, 2, 3, 2)
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ACT = ", ".join(
    "least({}) AS a{}".format(", ".join(
        [_edit("2", "D", f"v{s}"),
         f"CASE WHEN NOT gone THEN {_edit('1 + late', 'R', f'v{_NEXT[s]}')} END"]
        + [f"CASE WHEN NOT gone AND initial = '{c}' THEN {_edit('late', 'K', f'v{to}')} END"
           for c, to in _KEPT[s].items()]), s)
    for s in range(4))
_BEFORE = ", ".join(
    f"least(a{s}, {_edit('5', 'I', f'a{_NEXT[s]}')}, {_edit('10', 'II', f'a{_NEXT[_NEXT[s]]}')}) AS v{s}"
    for s in range(4))
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op13_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
hashed AS (SELECT *, {_crc32("name")} % 20 AS h FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k,
    rtrim(text, {_SPACES}) AS said, substr(role, 1, 1) AS initial FROM damaged),
seen AS (
  SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (
    PARTITION BY conv_id, role, text ORDER BY k) > 1 AS duplicate FROM ordered),
faults AS (
  SELECT *, blank OR duplicate AS gone,
    NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN lag(k) OVER w IS NOT NULL AND (lag(initial) OVER w) || initial NOT IN ('su', 'ua', 'au')
      THEN 1 ELSE 0 END AS illegal,
    CASE WHEN NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END
      AS late
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, sum(illegal)::BIGINT AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
paths AS (
  SELECT conv_id, n + 1 AS k, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2,
    '000000000' AS v3 FROM figures
  UNION ALL
  SELECT conv_id, k, {_BEFORE} FROM (
    SELECT p.conv_id, f.k, {_ACT}
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k - 1)),
best AS (
  SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM paths WHERE k = 1),
letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS letter, count(*) FILTER (WHERE substr(audit, i, 1) <> 'I')
    OVER (PARTITION BY conv_id ORDER BY i) AS k
  FROM best, range(1, length(audit) + 1) r(i)),
staying AS (
  SELECT l.conv_id, i, letter, f.role, f.text, f.initial,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY i) AS e
  FROM letters l LEFT JOIN faults f
    ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.k = l.k AND letter <> 'I'
  WHERE letter <> 'D'),
led AS (
  SELECT *, e - max(CASE WHEN e = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id) AS place FROM staying),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY e) AS body
  FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
