"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from skein.llm import licenses, secrets, variants, warc


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _places(name: str, kind: str, order: int, pattern: str, keep: str, source: str = "t") -> str:
    """CTE ``name``: kept matches of one kind with code-point offsets."""
    p = _quote(pattern)
    return f"""{name}_z AS (
  SELECT rid, regexp_extract_all(x, {p}) AS ms, regexp_split_to_array(x, {p}) AS gaps FROM {source}),
{name}_u AS (
  SELECT rid, unnest(range(1, len(ms) + 1)) AS i, ms, gaps FROM {name}_z WHERE len(ms) > 0),
{name}_l AS (
  SELECT rid, i, ms[i] AS m, length(gaps[i]) + length(ms[i]) AS step FROM {name}_u),
{name} AS (
  SELECT rid, {order} AS ord, '{kind}' AS kind, e - length(m) AS s, e
  FROM (SELECT rid, m, (sum(step) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS e FROM {name}_l)
  WHERE {keep})"""


def secret_scan() -> str:
    # the plain forms of the rules' patterns (possessive marks dropped)
    plain = {
        "assign": (secrets.ASSIGN, f"length(regexp_extract(m, {_quote(secrets.ASSIGN)}, 2)) >= 8"),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
        "hex": ("[0-9a-f]+", "length(m) >= 32"),
        "pem": ("-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
        "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
        "slack": ("xox[baprs]-[A-Za-z0-9-]{10,}", "true"),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    }
    parts = [_places(kind, kind, k, *plain[kind])
             for k, kind in enumerate(r.kind for r in secrets.RULES)]
    union = " UNION ALL ".join(f"SELECT * FROM {r.kind}" for r in secrets.RULES)
    base = ", ".join(_quote(k) for k in secrets.BASE_KINDS)
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{k}'), 0) AS n_{k}"
                       for k in secrets.BASE_KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
{", ".join(parts)},
a AS ({union})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)
                  FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord), '') AS spans
FROM t LEFT JOIN a USING (rid) GROUP BY rid, doc_id"""


def license_scan() -> str:
    facts = ", ".join(
        f"({i}, {_quote(t.label)}, {str(t.base).lower()}, {t.slack}, {t.least}, {t.seed}, "
        f"{len(t.text.split())})" for i, t in enumerate(licenses.TEMPLATES))
    grams = ", ".join(f"({t}, {at}, {_quote(a)}, {_quote(b)})"
                      for t, at, a, b in licenses.template_grams())
    return rf"""
WITH tf(t, label, base, slack, least, seed, size) AS (VALUES {facts}),
tg(t, tp, a, b) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, unnest(range(0, len(w) - 1)) AS pos, w FROM d WHERE len(w) > 1),
h AS (SELECT rid, t, pos - tp AS diag, pos, tp
      FROM (SELECT rid, pos, w[pos + 1] AS x, w[pos + 2] AS y FROM g) JOIN tg ON x = a AND y = b),
v AS (SELECT rid, t, diag, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT v.rid, v.t, v.diag, CASE WHEN v.diag - lag(v.diag) OVER o <= slack THEN 0 ELSE 1 END AS opens
      FROM v JOIN tf USING (t) WHERE n >= seed WINDOW o AS (PARTITION BY v.rid, v.t ORDER BY v.diag)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY rid, t ORDER BY diag) AS island FROM s),
m AS (SELECT rid, t, island, count(DISTINCT tp) AS hit, min(pos) AS start, max(pos) + 2 AS stop
      FROM i JOIN h USING (rid, t, diag) GROUP BY rid, t, island),
k AS (SELECT rid, label, base, start, hit / (size - 1)::DOUBLE AS share FROM m JOIN tf USING (t)
      WHERE hit / (size - 1)::DOUBLE >= least AND stop - start <= ceil(size * 1.5))
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (WHERE base) AS n_base,
  min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN k USING (rid) GROUP BY rid, doc_id"""


def warc_archive() -> str:
    symbols = " || ".join(
        f"substr('{warc.BASE32}', 1 + (('0x' || substr(sha1(b), {at}, 5))::BIGINT >> {s} & 31)::INT, 1)"
        for at in range(1, 41, 5) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
k AS (SELECT b, max(page_id) AS top FROM p GROUP BY b)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, {symbols} AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN k USING (b)"""


def jaccard_join() -> str:
    return r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY rid),
e AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v
  FROM (SELECT x.rid AS r1, y.rid AS r2, count(*) AS k FROM s x JOIN s y USING (g)
        WHERE x.rid <> y.rid GROUP BY ALL) p
  JOIN n a ON a.rid = r1 JOIN n b ON b.rid = r2
  WHERE 100 * k >= 75 * (a.n + b.n - k) AND a.doc_id <> b.doc_id),
r(doc_id, o) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.v FROM r JOIN e ON r.o = e.u),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c ON c.doc_id = d.doc_id"""


def spelling_variants() -> str:
    # crc32 by its table of 256 remainders; neighbours by patterns with one hole
    v = variants
    return rf"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) AS t),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[{v.LETTERS}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {v.LEAST} GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM c),
h AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, y: xor(a // 256, t[(xor(a % 256, y) + 1)::INT]))) AS h FROM b, k),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {v.SPOIL} = 0 THEN substr(run, 1, (h % length(run))::INT)
      || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {v.LEAST} GROUP BY word HAVING sum(n) >= {v.SEEN}),
p AS (
  SELECT word, n, 0 AS kind, unnest(range(0, length(word) + 1)) AS i FROM w
  UNION ALL SELECT word, n, 1, unnest(range(0, length(word))) FROM w),
q AS (
  SELECT word, n, kind, substr(word, 1, i::INT) || '*' || substr(word, (i + 1 + kind)::INT) AS pattern FROM p),
e AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m
  FROM q a JOIN q b USING (pattern) WHERE a.word <> b.word AND a.kind + b.kind > 0),
s AS (
  SELECT word, count(*) AS n_near, max(m) AS top FROM e GROUP BY word),
f AS (
  SELECT s.word, min(e.other) AS form, any_value(top) AS form_n
  FROM s JOIN e ON e.word = s.word AND e.m = s.top JOIN w ON w.word = s.word
  WHERE top >= {v.RATIO} * n GROUP BY s.word),
g(word, root) AS (
  SELECT word, word FROM w UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root)
SELECT w.word, f.form, g.root, w.n, coalesce(s.n_near, 0)::BIGINT AS n_near, f.form_n
FROM w LEFT JOIN s USING (word) LEFT JOIN f USING (word)
JOIN g ON g.word = w.word AND NOT EXISTS (SELECT 1 FROM f z WHERE z.word = g.root)"""
