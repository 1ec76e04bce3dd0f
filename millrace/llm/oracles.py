"""SQL counterparts of the corpus queries that SQL can express, for a plain SQL database.

They share constants with the operators (rules, word lists, limits) and nothing else: sets are compared
pair by pair, prefixes and windows are written out in full.
"""

from __future__ import annotations

from millrace.llm.chat import CLOSE, OPEN
from millrace.llm.columns import LOWER, UPPER
from millrace.llm.line_dedup import MIN_SITES
from millrace.llm.quality import MAX_REPEATED, MIN_WORDS, PUNCTUATION, RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- quality rules -------------------------------------------------------------------------------

_STOP = ", ".join(_quoted(w) for w in sorted({w for words in STOP_WORDS.values() for w in words}))


def _broken() -> str:
    parts = []
    for name, (measure, base, least, most) in RULES.items():
        share = f"({measure} / greatest({base}, 1))"
        limits = [f"{share} < {least}"] * (least is not None) + [f"{share} > {most}"] * (most is not None)
        parts.append(f"CASE WHEN {' OR '.join(limits) or 'false'} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_QUALITY = f"""WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
often AS (SELECT doc_id, a, b, c FROM grams GROUP BY ALL HAVING count(*) > 1),
marked AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN often USING (doc_id, a, b, c))
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len([x for x in ws if ends_with(x, '!')]) AS n_exclaimed,
    len([x for x in ws if rtrim(lower(x), '{PUNCTUATION}') IN ({_STOP})]) AS n_stop_words,
    len([x for x in ws if regexp_matches(x, '\\p{{L}}')]) AS n_lettered,
    len([x for x in ls if regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')]) AS n_bullets,
    len([x for x in ls if regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')]) AS n_ellipses
  FROM w LEFT JOIN marked USING (doc_id)),
judged AS (
  SELECT *, {_broken()} AS names,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed
  FROM measured)
SELECT * EXCLUDE (names), array_to_string(names, ',') AS broken, NOT base_failed AND len(names) = 0 AS kept FROM judged"""

# --- duplicates ----------------------------------------------------------------------------------

_EXACT = f"""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

_LINES = f"""WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
bad AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (bad.key IS NULL), '') AS text,
    count(*) FILTER (keyed.key <> '') AS n_lines, count(bad.key) AS n_removed
  FROM keyed LEFT JOIN bad ON bad.key = keyed.key GROUP BY doc_id)
SELECT doc_id, cleaned.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN cleaned USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(doc_id, coalesce(least.y, doc_id)) AS component_id,
  doc_id <= coalesce(least.y, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

_SPAN = 100
_REPEATS = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
pieces AS (
  SELECT doc_id, base, substr(hx, 2 * base + 1, {2 * (500 + _SPAN - 1)}) AS hx
  FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - {_SPAN - 1}, 500)) AS base FROM d)),
windows AS (
  SELECT doc_id, base + i AS i, md5(substr(hx, 2 * i + 1, {2 * _SPAN})) AS s
  FROM (SELECT doc_id, base, hx, unnest(range(0, length(hx) // 2 - {_SPAN - 1})) AS i FROM pieces)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
begun AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {_SPAN}, true) AS new FROM later),
numbered AS (
  SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begun),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + {_SPAN} AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last,
    sum(b - a) AS removed, count(*) AS n
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(hx) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(hx, 2 * last + 1), hx))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

# --- archives ------------------------------------------------------------------------------------

_WARC = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q"""

# --- conversations -------------------------------------------------------------------------------


def _escape(text: str) -> str:
    return f"replace(replace({text}, '&', '&amp;'), '<', '&lt;')"


_ROLE = f"replace(replace({_escape('role')}, '>', '&gt;'), chr(10), '&nl;')"
_CHAT = f"""WITH control AS (
  SELECT -7 AS conv_id, i AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
    '\\### Assistant: </turn> ok' AS text FROM range(2) r(i)),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM control)),
shown AS (
  SELECT *, contains(text, '{CLOSE}') AS escape, CASE WHEN escape THEN {_escape('text')} ELSE text END AS body,
    length({_ROLE}) + length(body) + {len(OPEN) + 4 + 2 + len(CLOSE)} AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (escape) AS escaped_turns, true AS identical
FROM shown GROUP BY conv_id"""

_BIT = "lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"[CAST(ascii(x) AS UBIGINT) for x in string_split({text}, '')]"
    step = f"lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], {_BIT})"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), {step}), 4294967295::UBIGINT)"


_TRIE = f"""WITH seqs AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations GROUP BY conv_id),
hashed AS (SELECT conv_id, s, CAST({_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS BIGINT) AS h FROM seqs),
rebuilt AS (
  SELECT a.conv_id, list_concat(b.s[1:h], a.s[h + 1:]) AS s
  FROM hashed a LEFT JOIN seqs b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
families AS MATERIALIZED (
  SELECT c.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = c.d + 1 AND k.p[1:c.d] = c.p) AS n_children
  FROM nodes c LEFT JOIN nodes u ON u.d = c.d - 1 AND c.p[1:c.d - 1] = u.p)
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children,
  count(*) FILTER (b.n_children = 0) AS n_leaves,
  CAST(sum((b.n_convs - 1) * coalesce(octet_length(encode(b.p[b.d].t)), 0)) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM families a JOIN families b ON b.d >= a.d AND b.p[1:a.d] = a.p
GROUP BY a.p, a.d, a.conv_id, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256"""

# Damaged rows; then, row by row and state by state of the pattern, the least (cost, audit) and its turns.
_PLACE = "CAST(conv_id AS VARCHAR) || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_REPAIR = f"""WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_PLACE)} % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    left(role, 1) AS own, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
judged AS MATERIALIZED (
  SELECT *, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
faulty AS MATERIALIZED (
  SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
inserted(st, st2, k, turns) AS (VALUES
  ('', '', 0, []::VARCHAR[]), ('', 'u', 1, ['user:']), ('', 'a', 2, ['user:', 'assistant:']),
  ('s', 's', 0, []), ('s', 'u', 1, ['user:']), ('s', 'a', 2, ['user:', 'assistant:']),
  ('u', 'u', 0, []), ('u', 'a', 1, ['assistant:']), ('u', 'u', 2, ['assistant:', 'user:']),
  ('a', 'a', 0, []), ('a', 'u', 1, ['user:']), ('a', 'a', 2, ['user:', 'assistant:'])),
follows(st2, own, renamed) AS (VALUES ('', ['s', 'u'], 'user'), ('s', ['u'], 'user'), ('u', ['a'], 'assistant'), ('a', ['u'], 'user')),
edits(letter) AS (VALUES ('D'), ('K'), ('R')),
dp(conv_id, i, st, least, turns) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': ''}}, []::VARCHAR[] FROM conversations
  UNION ALL
  SELECT conv_id, i, st, min(least), arg_min(turns, least)
  FROM (
    SELECT dp.conv_id, r.i, CASE letter WHEN 'D' THEN st2 WHEN 'K' THEN r.own ELSE left(renamed, 1) END AS st,
      {{'cost': dp.least.cost + 2 * k + CASE letter WHEN 'D' THEN 3 ELSE CASE letter WHEN 'R' THEN 2 ELSE 0 END
          + CASE WHEN truncated THEN 1 ELSE 0 END END, 'audit': dp.least.audit || repeat('I', k) || letter}} AS least,
      list_concat(dp.turns, inserted.turns, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
        ELSE [renamed || ':' || r.text] END) AS turns
    FROM dp JOIN faulty r ON r.conv_id = dp.conv_id AND r.i = dp.i + 1
    JOIN inserted USING (st) JOIN follows USING (st2), edits
    WHERE letter = 'D' OR (NOT blank AND NOT duplicate AND (letter = 'R' OR list_contains(follows.own, r.own))))
  GROUP BY conv_id, i, st),
sizes AS (
  SELECT conv_id, count(i) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN faulty USING (conv_id) GROUP BY conv_id),
ended AS (
  SELECT conv_id, {{'cost': dp.least.cost + 2 * k, 'audit': dp.least.audit || repeat('I', k)}} AS least,
    list_concat(dp.turns, inserted.turns) AS turns
  FROM dp JOIN sizes USING (conv_id) JOIN inserted USING (st) WHERE dp.i = n AND st2 IN ('', 'a')),
best AS (SELECT conv_id, min(least) AS least, arg_min(turns, least) AS turns FROM ended GROUP BY conv_id)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.least.cost AS cost, best.least.audit AS audit,
  sha256(array_to_string(best.turns, chr(10))) AS repaired_sha256
FROM sizes JOIN best USING (conv_id)"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _QUALITY,
    "op3_exact_dedup": _EXACT,
    "op5_warc": _WARC,
    "op7_line_dedup": _LINES,
    "op9_minhash_dedup": _NEAR,
    "op10_chat_format": _CHAT,
    "op11_prefix_trie": _TRIE,
    "op12_structure_repair": _REPAIR,
    "op13_suffix_array_dedup": _REPEATS,
}
