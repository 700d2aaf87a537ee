"""SQL of the queries that SQL can express, for the given tables as views."""

from __future__ import annotations

_ESCAPED = """replace(replace(replace(replace(replace({0}, chr(92), chr(92) || '0'),
  '<s>', chr(92) || '1s>'), '</s>', chr(92) || '1/s>'), '[INST]', chr(92) || '2INST]'), '[/INST]', chr(92) || '2/INST]')"""

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + length(replace({_ESCAPED.format('role')}, chr(10), chr(92) || '3')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: Lower-cased words of a text, and its 5-word shingles in order: the whole sequence if it is shorter.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
_SHINGLES = """CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""

#: Of `links` (a, b in both directions): everything that can be reached.
_REACH = """reach(a, b) AS (SELECT {0}, {0} FROM {1} UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct({_SHINGLES}) AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{_REACH.format('doc_id', 'documents')}
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sets.doc_id) AS component_id,
  (SELECT count(*) FROM links WHERE links.a = sets.doc_id) AS n_links FROM sets
"""

EMBEDDINGS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH.format('vec_id', 'embeddings')},
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id
"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
places AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle, unnest(range(len(s))) AS p FROM d),
bags AS (SELECT item_id, size, shingle, count(*) AS c FROM (SELECT item_id, len(s) AS size, unnest(s) AS shingle FROM i) GROUP BY ALL),
shared AS (SELECT doc_id, item_id, n, size, least(n, size) AS own, p, shingle, c FROM places JOIN bags USING (shingle)),
windows AS (SELECT DISTINCT doc_id, item_id, size, own, unnest(range(greatest(0, p - own + 1), least(p, n - own) + 1)) AS start FROM shared),
counted AS (
  SELECT w.doc_id, w.item_id, w.size, w.own, w.start, least(count(*), any_value(s.c)) AS m
  FROM windows w JOIN shared s ON s.doc_id = w.doc_id AND s.item_id = w.item_id AND s.p BETWEEN w.start AND w.start + w.own - 1
  GROUP BY w.doc_id, w.item_id, w.size, w.own, w.start, s.shingle),
judged AS (SELECT doc_id, item_id, start, size + own AS both_sizes, sum(m) AS m FROM counted GROUP BY ALL)
SELECT doc_id, item_id, CAST(m AS DOUBLE) / CAST(both_sizes - m AS DOUBLE) AS similarity, start
FROM judged WHERE 4 * m >= 3 * (both_sizes - m)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(m AS DOUBLE) / CAST(both_sizes - m AS DOUBLE) DESC, start) = 1
"""

#: A field of a row with its length in bytes; crc32 of an id as text; levels of a tree, from a list of its leaves.
_TOLD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
_UP = "[sha256(array_to_string(h[8 * i + 1:8 * i + 8], '')) FOR i IN range(CAST(ceil(len(h) / 8.0) AS BIGINT))]"
_STEP = """array_to_string(h[8 * (p // 8) + 1:p], '') || '|' || array_to_string(h[p + 2:8 * (p // 8) + 8], '')"""

MERKLE = f"""
WITH RECURSIVE read AS (
  SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256({' || '.join(_TOLD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
    sha256({' || '.join(_TOLD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'found'))}) AS found_leaf,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM read),
levels(lang, level, h) AS (
  SELECT lang, 0, list(leaf ORDER BY doc_id) FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_UP} FROM levels WHERE len(h) > 1),
subs AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(h) = 1),
top(level, h) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subs
  UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(h) > 1),
steps AS (
  SELECT doc_id, level, {_STEP} AS step FROM (
    SELECT doc_id, level, h, leaves.place // CAST(pow(8, level) AS BIGINT) AS p
    FROM leaves JOIN levels ON leaves.lang IS NOT DISTINCT FROM levels.lang WHERE len(h) > 1)
  UNION ALL SELECT doc_id, 1000 + level, {_STEP} FROM (
    SELECT doc_id, level, h, subs.place // CAST(pow(8, level) AS BIGINT) AS p
    FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN top WHERE len(h) > 1)),
proofs AS (SELECT doc_id, list(step ORDER BY level) AS proof FROM steps GROUP BY doc_id),
folded AS (
  SELECT leaves.*, sha256(replace(array_to_string(coalesce(proof, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(found_leaf, coalesce(proof, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM leaves LEFT JOIN proofs USING (doc_id))
SELECT doc_id, leaf, subroot, h[1] AS root, proof_sha256, folded_root, folded_root = h[1] AS verified
FROM folded JOIN subs ON folded.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN top WHERE len(h) = 1
"""

REPEATS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS s FROM words),
least AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM windows JOIN least USING (s) WHERE m < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": LEAKS,
    "op3_embedding_near_dedup": EMBEDDINGS,
    "op6_ngram_jaccard_join": JACCARD,
    "op8_chat_formatting": CHAT,
    "op12_merkle_manifest": MERKLE,
    "op13_substring_dedup": REPEATS,
}
