"""SQL counterparts of the registered queries."""

from __future__ import annotations

from .quality import WORDS
from .sharding import PRIME, round_keys

_WORD = r"[^\x20\x09-\x0D]+"


def _divergence(name: str, bins: int) -> str:
    """Distance of list column ``name`` from ``ref_name``, both with ``bins`` entries."""
    total, ref = f"list_sum({name})", f"list_sum(ref_{name})"

    def half(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"

    p, q = f"({name}[i] / {total})", f"(ref_{name}[i] / {ref})"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {bins + 1}), lambda i: ({half(p, q)} + {half(q, p)}) / 2))))"


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLASSES = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t-\r]", r"[.,;:!?'\"()-]", r"[\x00-\x08\x0E-\x1F#-&*+/<=>@\[\\\]^_`{-\x7F]", r"[\x{80}-\x{3FF}]", r"[\x{400}-\x{10FFFF}]"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1() -> str:
    classes = ", ".join(f"length(t) - length(regexp_replace(t, {_quoted(c)}, '', 'g'))" for c in _CLASSES)
    listed = ", ".join(_quoted(w) for w in WORDS)
    refs = {name: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]" for name, n in (("classes", 8), ("common", len(WORDS) + 1))}
    return f"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
three AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM three) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
hits AS (
  SELECT doc_id, list_position([{listed}], u) AS p, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWERED}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS u FROM base) GROUP BY ALL),
bins AS (SELECT doc_id, map_from_entries(list((coalesce(p, {len(WORDS) + 1}), n))) AS m FROM hits GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, [{classes}] AS classes,
    list_transform(range(1, {len(WORDS) + 2}), lambda i: coalesce(m[i], 0)) AS common
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN bins USING (doc_id)),
refs AS (SELECT lang, {refs["classes"]} AS ref_classes, {refs["common"]} AS ref_common FROM counted GROUP BY lang),
judged AS (
  SELECT counted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {_divergence("classes", 8)} AS far_class, {_divergence("common", len(WORDS) + 1)} AS far_words
  FROM counted JOIN refs ON counted.lang IS NOT DISTINCT FROM refs.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= 200 AND coalesce(far_class, 0) > 0.3)
    AND NOT (n_words >= 100 AND coalesce(far_words, 0) > 0.2 + 1.7 / sqrt(n_words)) AS kept
FROM judged
"""


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_SEGMENT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)"
_OP5 = f"""
WITH captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 365)::INT AS day, nullif({_HOST}, '') AS host, nullif({_SEGMENT}, '') AS segment FROM pages),
keys AS (
  SELECT 'host' AS kind, host AS key FROM captures WHERE host IS NOT NULL
  UNION SELECT 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') FROM captures WHERE host IS NOT NULL
  UNION SELECT 'path', host || '/' || segment FROM captures WHERE host IS NOT NULL AND segment IS NOT NULL),
drawn AS (SELECT kind, key, ('0x' || substr(md5(key), 1, 6))::INT AS h FROM keys),
dated AS (
  SELECT key, h % 150 AS d, 'block' AS action FROM drawn WHERE kind = 'host' AND h % 5 = 0
  UNION ALL SELECT key, h % 150 + 30 + h % 100, 'remove' FROM drawn WHERE kind = 'host' AND h % 5 = 0
  UNION ALL SELECT key, h % 150 + 160, 'block' FROM drawn WHERE kind = 'host' AND h % 10 = 0
  UNION ALL SELECT key, h % 200, 'block' FROM drawn WHERE kind = 'domain'
  UNION ALL SELECT key, h % 200 + 40, 'remove' FROM drawn WHERE kind = 'domain'
  UNION ALL SELECT key, h % 300, 'allow' FROM drawn WHERE kind = 'path' AND h % 7 = 0),
daily AS (SELECT key, DATE '2024-01-01' + d::INT AS day, max(action) AS action FROM dated GROUP BY ALL),
valid AS (SELECT key, action, day AS start, lead(day) OVER (PARTITION BY key ORDER BY day) AS stop FROM daily),
asked AS (
  SELECT page_id, url, day, unnest(k) AS key, generate_subscripts(k, 1) AS rank FROM (
    SELECT page_id, url, day, list_concat(CASE WHEN segment IS NULL THEN [] ELSE [host || '/' || segment] END,
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, -1), '.'))) AS k
    FROM captures WHERE host IS NOT NULL)),
met AS (
  SELECT page_id, count(*) AS n_active, arg_min(asked.key, rank) AS entry, arg_min(action, rank) AS action
  FROM asked JOIN valid ON asked.key = valid.key AND valid.start <= day AND (stop IS NULL OR day < stop) AND action <> 'remove' GROUP BY page_id)
SELECT page_id, url, day, coalesce(n_active, 0)::BIGINT AS n_active, entry, action, coalesce(action <> 'block', TRUE) AS kept
FROM captures LEFT JOIN met USING (page_id)
"""


def _rounds(rows: str, seed: int) -> str:
    """One pass of the permutation over ``rows`` (id, v, side, n)."""
    source = f"SELECT id, v // side AS l, v % side AS r, side, n FROM {rows}"
    for add, factor, shift in round_keys(seed):
        square = f"(((r + {add}) % {PRIME}) * ((r + {add}) % {PRIME}) % {PRIME})"
        x = f"(({square} * {factor} + {shift}) % {PRIME})"
        source = f"SELECT id, r AS l, (l + ({x} * {x} % {PRIME})) % side AS r, side, n FROM ({source})"
    return f"SELECT id, l * side + r AS v, side, n FROM ({source})"


def _op6(seed: int = 20, shards: int = 8) -> str:
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id, count(*) OVER () AS n FROM sized),
start AS (SELECT id, id::BIGINT AS v, (floor(sqrt(n - 1)) + 1)::BIGINT AS side, n FROM placed),
todo AS ({_rounds("start", seed)} UNION ALL {_rounds("todo WHERE v >= n", seed)}),
done AS (SELECT id, v FROM todo WHERE v < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, (v // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed JOIN done USING (id)
"""


_OP8 = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""

def _near(n: int, percent: int, extra: str = "") -> str:
    """Components of documents by the Jaccard similarity of their shingles of ``n`` words; for small tables."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '{_WORD}') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{extra} FROM named LEFT JOIN sizes USING (doc_id)
"""


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _op13(least: int = 30, smoothing: int = 5, ranks: int = 50) -> str:
    def share(count: str, total: str) -> str:
        return f"1 + 1000000000::HUGEINT * ({count} + {smoothing}) // ({total} + {smoothing} * v)"

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '{_TERM}') AS w FROM documents),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM (SELECT d, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS everywhere FROM counts GROUP BY ALL HAVING sum(docs) >= {least}),
langs AS (SELECT lang, count(*) AS v, sum(everywhere) AS lang_total FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, v, lang_total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts JOIN kept USING (lang, term) GROUP BY ALL) USING (lang, source) LEFT JOIN langs USING (lang)),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "total")} AS p, {share("everywhere", "lang_total")} AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (
    SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) far
  ON far.lang = x.lang AND far.a = x.source AND far.b = y.source),
entries AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM entries)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {ranks}
"""


ORACLE = {"op1_distribution_divergence": _op1(), "op5_temporal_lists": _OP5, "op6_feistel_shards": _op6(), "op8_warc_ranges": _OP8,
          "op9_vertical_jaccard": _near(4, 85), "op11_min_max_hashing": _near(5, 85, ", doc_id = component_id AS kept"),
          "op13_source_divergence": _op13()}
