"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from varlens.llm import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS words FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) x),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, words) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
m AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.r = cov.r),
f AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_words <= word_chars AND word_chars <= 20 * n_words
    AND 10 * n_dup_lines <= 4 * len(lines) AND 5 * n_stutters <= n_words AND 10 * n_upper <= 3 * (n_upper + n_lower) AS kept
FROM f"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of a pattern's matches: the text before each, match by match."""
    p = _quoted(pattern)
    return f"""SELECT r, {kind} AS kind, start, start + length(hit) AS stop, hit FROM (
  SELECT r, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit) AS start FROM (
    SELECT r, i, regexp_extract_all(text, '{p}', 0)[i] AS hit, regexp_extract_all(text, '{p}', {group})[i] AS value,
      string_split_regex(text, '{p}')[i] AS gap
    FROM (SELECT * FROM d WHERE regexp_matches(text, '{p}')) h, LATERAL (SELECT unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) AS i) x))
  WHERE length(value) >= {least}"""


def _any_of(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{_quoted(p)}')" for p in patterns) + ")"


def _bound() -> str:
    import math
    out = ""
    for pattern, bits in secrets.BOUNDS:
        most = math.floor(secrets.WINDOW * (math.log2(secrets.WINDOW) - bits) * secrets._SCALE)
        out += f" WHEN regexp_matches(hit, '{pattern}') THEN {most}" if pattern else f" ELSE {most}"
    return f"CASE{out} END"


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found(0, secrets.ASSIGN, 2, secrets.MIN_VALUE)} UNION ALL {_found(1, secrets.ACCESS, 0, 0)} UNION ALL {_found(2, secrets.HEX, 0, 0)}),
cand AS (SELECT *, row_number() OVER () AS c FROM ({_found(3, "[A-Za-z0-9+/_=-]{20,}", 0, 0)}) k WHERE regexp_matches(hit, '[0-9]')),
blank AS (SELECT c, hit, array_to_string(list_transform(range(1, length(hit) + 1), lambda i:
    CASE WHEN len(list_filter(covers, lambda s: s[1] < start + i AND start + i <= s[2])) > 0 THEN ' ' ELSE substr(hit, i, 1) END), '') AS text
  FROM cand LEFT JOIN (SELECT r AS br, list([start, stop]) AS covers FROM base GROUP BY r) b ON cand.r = b.br),
parts AS (SELECT c, hit, unnest(string_split(regexp_replace(text, '{_quoted(secrets.ALLOW[-1])}', ' ', 'g'), ' ')) AS part FROM blank),
judged AS (SELECT row_number() OVER () AS p, c, part AS hit FROM parts WHERE length(part) >= {secrets.WINDOW} AND regexp_matches(part, '[0-9]')
  AND NOT CASE WHEN part = hit THEN {_any_of("part", secrets.WHOLE)} ELSE {_any_of("part", secrets.ENDS)} END),
win AS (SELECT p, pos, ch, count(*) AS n FROM (
  SELECT p, pos, substr(hit, CAST(pos + o AS BIGINT), 1) AS ch FROM judged, LATERAL (SELECT unnest(range(1, length(hit) - {secrets.WINDOW - 2})) AS pos) x,
    range(0, {secrets.WINDOW}) y(o)) GROUP BY p, pos, ch),
low AS (SELECT p, min(s) AS least FROM (SELECT p, pos, sum({secrets._F}[CAST(n + 1 AS BIGINT)]) AS s FROM win GROUP BY p, pos) GROUP BY p),
spans AS (SELECT r, kind, start, stop FROM base UNION ALL
  SELECT r, kind, start, stop FROM cand WHERE c IN (SELECT c FROM judged JOIN low ON judged.p = low.p WHERE least <= {_bound()})),
text AS (SELECT *, {list(secrets.KINDS)}[kind + 1] || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS t FROM spans),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans FROM text GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""

OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN low ON s.doc_id = low.a"""


#: The 256 remainders of the reversed polynomial of crc32, from its rule.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS remainders)"""


def _crc32(text: str) -> str:
    byte = f"CAST(('0x' || substr(hex(encode({text})), 2 * i - 1, 2)) AS BIGINT)"
    return f"""xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte}),
  lambda a, b: xor(a >> 8, remainders[xor(a & 255, b) + 1]), 4294967295))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _levels(name: str, first: str) -> str:
    """All nodes of the trees whose leaves (g, pos, h, n) are in ``first``."""
    return f"""{name} AS (SELECT g, 0 AS lvl, pos, h, n FROM {first} UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2)"""


def _folds(name: str, first: str, nodes: str) -> str:
    """Rows (r, g, pos, n, acc, proof) of ``first`` carried up the trees ``nodes``."""
    return f"""{name} AS (SELECT r, g, 0 AS lvl, pos, n, acc, proof FROM {first} UNION ALL
  SELECT f.r, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.acc ELSE f.acc || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1)"""


OP11 = f"""WITH RECURSIVE crc AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
  CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS tampered FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
leaves AS (SELECT g, pos, leaf AS h, n FROM o),
{_levels("inner_nodes", "leaves")},
subs AS (SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
{_levels("top_nodes", "subs")},
starts AS (SELECT r, g, pos, n, coalesce(tampered, leaf) AS acc, '' AS proof FROM o),
{_folds("inner_folds", "starts", "inner_nodes")},
middles AS (SELECT f.r, s.g, s.pos, s.n, f.acc, f.proof FROM inner_folds f JOIN subs s ON f.g = s.name WHERE f.n = 1),
{_folds("top_folds", "middles", "top_nodes")}
SELECT o.doc_id, o.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = t.h AS verified
FROM o JOIN subs s ON o.g = s.name JOIN (SELECT h FROM top_nodes WHERE n = 1) t ON true JOIN (SELECT * FROM top_folds WHERE n = 1) f ON o.r = f.r"""

OP12 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM k WHERE place <= 5"""

OP13 = f"""WITH RECURSIVE crc AS {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
  unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32("(doc_id || ':' || run)")} AS h FROM runs, crc),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c,
  CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i) x),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT cuts.word, w.word, w.n FROM cuts JOIN w ON cuts.part = w.word UNION SELECT w.word, cuts.word, cuts.n FROM cuts JOIN w ON cuts.part = w.word),
near AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs GROUP BY a),
f AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN near ON w.word = near.a),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.next = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word AND up.next IS NULL"""

SQL = {"op2_quality_rules": OP2, "op6_secret_scans": OP6, "op10_ngram_jaccard": OP10, "op11_merkle_manifest": OP11, "op12_exact_topk": OP12,
       "op13_spelling_variants": OP13}
