"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from nnprobe.llm.common import LOWER, UPPER
from nnprobe.llm.line_first import BOILERPLATE, INNER_END, LINE_END, LONG_LINE, MAX_LOST, NAV_BARS, NAV_WORDS, NOTICE_SHARE

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' || len(w)
        ELSE array_to_string(w[i:i + 4], ' ') END AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM h JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(q.n_items, 0) AS n_items,
       sha256(coalesce(q.names, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln FROM d),
j AS (SELECT doc_id, ln, length(regexp_replace(ln, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c,
        length(regexp_replace(ln, '\\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(ln, '\\P{{Lu}}+', '', 'g')) AS caps,
        length(regexp_replace(ln, '[^#*$%&|<>]+', '', 'g')) AS syms, length(regexp_replace(ln, '[^|>»·•/]+', '', 'g')) AS bars
      FROM l WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]')),
k AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS dups, sum(c) AS c,
        sum(CASE WHEN NOT (regexp_matches(ln, {_q(LINE_END)}) OR (length(ln) >= {LONG_LINE} AND regexp_matches(ln, {_q(INNER_END)})))
              OR (regexp_matches(ln, {_q(NAV_BARS)}) AND bars * 20 > length(ln))
              OR regexp_matches(ln, {_q(NAV_WORDS)}) OR (length(ln) - length(regexp_replace(ln, {_q(BOILERPLATE)}, '', 'g'))) * {NOTICE_SHARE} >= length(ln)
              OR syms * 10 > length(ln) OR (letters >= 20 AND caps * 10 > letters * 7) THEN 0 ELSE c END) AS good
      FROM j GROUP BY doc_id),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (
        SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (
          SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, t) AS n FROM v) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(k.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.rep, 0) AS BIGINT) AS n_repeat_words,
        CASE WHEN coalesce(k.c, 0) > 0 THEN 1 - CAST(k.good AS DOUBLE) / CAST(k.c AS DOUBLE) ELSE 0 END AS lost
      FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= {MAX_LOST} AS kept
FROM m
"""

_NORM = "lower(trim(regexp_replace({}, '[\\x20\\x09-\\x0D]+', ' ', 'g')))"

OP5 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS nil FROM documents),
l AS (SELECT doc_id, source, t, unnest(ls) AS ln, unnest(range(len(ls))) AS ord FROM d WHERE NOT nil),
k AS (SELECT *, {_NORM.format('ln')} AS u FROM l),
j AS (SELECT *, u <> '' AS judged FROM k),
b AS (SELECT u, min(struct_pack(doc_id := doc_id, ord := ord)) AS f FROM j WHERE judged
      GROUP BY u HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5),
g AS (SELECT j.*, b.u IS NOT NULL AND NOT (b.f.doc_id = j.doc_id AND b.f.ord = j.ord) AS gone
      FROM j LEFT JOIN b ON b.u = j.u AND j.judged),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        coalesce(string_agg(ln, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '') AS left_text FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       length(coalesce(r.left_text, '')) AS n_chars_left, sha256(coalesce(r.left_text, '')) AS text_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

OP1 = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, role, i, ls[i] AS ln,
        length(regexp_replace(regexp_extract(ls[i], '^(?:[ \\t]*>)+[ \\t]?'), '[^>]', '', 'g')) AS level,
        regexp_replace(ls[i], '^(?:[ \\t]*>)+[ \\t]?', '') AS body
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
x AS (SELECT *, lead(level, 1, 0) OVER w AS below, lag(level) OVER w AS above FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
y AS (SELECT *, sum(CASE WHEN above IS NULL OR above <> level THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM x),
o AS (SELECT conv_id, turn, role, coalesce(regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (
          below > 0 AND regexp_matches(body, {_q('(?i)(wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió)[ \\t]*:[ \\t\\r]*$')}))),
          '^[\\x20\\x09-\\x0D]*\\n|[\\x20\\x09-\\x0D]+$', '', 'g'), '') AS own,
        count(DISTINCT run) FILTER (WHERE level > 0) AS n_quotes, max(level) AS max_level
      FROM y GROUP BY conv_id, turn, role),
said AS (SELECT conv_id, u, min(turn) AS origin FROM (
           SELECT conv_id, turn, {_NORM.format('unnest(string_split(own, chr(10)))')} AS u FROM o
           UNION ALL SELECT conv_id, turn, {_NORM.format("replace(own, chr(10), ' ')")} FROM o) WHERE u <> '' GROUP BY 1, 2),
quoted AS (SELECT DISTINCT conv_id, turn, level, u FROM (
           SELECT conv_id, turn, level, {_NORM.format('body')} AS u FROM y WHERE level > 0
           UNION ALL SELECT conv_id, turn, any_value(level), {_NORM.format("string_agg(body, ' ' ORDER BY i)")} FROM y WHERE level > 0 GROUP BY conv_id, turn, run)
           WHERE u <> ''),
votes AS (SELECT q.conv_id, q.turn, q.level, s.origin, sum(length(u)) AS chars, count(*) AS n
          FROM quoted q JOIN said s USING (conv_id, u) WHERE s.origin < q.turn GROUP BY 1, 2, 3, 4),
links AS (SELECT conv_id, turn, arg_min(origin, (level, -chars, -origin)) AS parent, sum(n) AS n_linked FROM votes GROUP BY 1, 2),
up AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM links
       UNION ALL SELECT up.conv_id, up.turn, k.parent, up.depth + 1 FROM up JOIN links k ON k.conv_id = up.conv_id AND k.turn = up.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1, 2)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(root, turn), turn) - 1 AS position, turn, role,
       parent AS parent_turn, coalesce(root, turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth, n_quotes,
       CAST(max_level AS BIGINT) AS max_level, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, own AS text
FROM o LEFT JOIN links USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn)
"""


def _bytes_and_value(col: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({col} AS VARCHAR))) AS VARCHAR) || ':' || CAST({col} AS VARCHAR), '-')"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(r, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda r, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


_LEAF = " || ".join(_bytes_and_value(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))

OP12 = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256({_LEAF.replace('n_chars', '(n_chars + 1)')}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM h),
nodes AS (SELECT t, 0 AS lvl, idx, n, leaf AS d FROM l
          UNION ALL
          SELECT t, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1
          GROUP BY t, lvl, idx // 2, (n + 1) // 2),
sub AS (SELECT t, d FROM nodes WHERE n = 1),
top AS (SELECT 0 AS lvl, t AS idx, (SELECT count(*) FROM sub) AS n, d FROM sub
        UNION ALL
        SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM top WHERE n > 1
        GROUP BY lvl, idx // 2, (n + 1) // 2),
root AS (SELECT d FROM top WHERE n = 1),
sib AS (SELECT l.rid, 0 AS part, o.lvl, o.d FROM l JOIN nodes o ON o.t = l.t AND o.idx = xor(l.idx >> o.lvl, 1)
        UNION ALL
        SELECT l.rid, 1, o.lvl, o.d FROM l JOIN top o ON o.idx = xor(l.t >> o.lvl, 1)),
proof AS (SELECT rid, string_agg(d, '' ORDER BY part, lvl) AS p FROM sib GROUP BY rid),
up AS (SELECT rid, t, 0 AS lvl, idx, n, coalesce(changed, leaf) AS d FROM l
       UNION ALL
       SELECT up.rid, up.t, up.lvl + 1, up.idx // 2, (up.n + 1) // 2,
              sha256(CASE WHEN s.d IS NULL THEN up.d WHEN up.idx % 2 = 0 THEN up.d || s.d ELSE s.d || up.d END)
       FROM up LEFT JOIN sib s ON s.rid = up.rid AND s.part = 0 AND s.lvl = up.lvl WHERE up.n > 1),
across AS (SELECT rid, 0 AS lvl, t AS idx, (SELECT count(*) FROM sub) AS n, d FROM up WHERE n = 1
           UNION ALL
           SELECT a.rid, a.lvl + 1, a.idx // 2, (a.n + 1) // 2,
                  sha256(CASE WHEN s.d IS NULL THEN a.d WHEN a.idx % 2 = 0 THEN a.d || s.d ELSE s.d || a.d END)
           FROM across a LEFT JOIN sib s ON s.rid = a.rid AND s.part = 1 AND s.lvl = a.lvl WHERE a.n > 1)
SELECT l.doc_id, l.leaf, sub.d AS subroot, root.d AS root, sha256(coalesce(proof.p, '')) AS proof_sha256,
       a.d AS folded_root, a.d = root.d AS verified
FROM l JOIN sub USING (t) JOIN across a ON a.rid = l.rid AND a.n = 1 LEFT JOIN proof ON proof.rid = l.rid CROSS JOIN root
"""


_ID_TURN = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_TRIMMED = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

# The cheapest repair from every row and last role on, from the last row backwards;
# before a row at most two insertions help.
OP11 = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_ID_TURN)} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS same, dense_rank() OVER (ORDER BY conv_id) AS c FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, same) AS i, count(*) OVER (PARTITION BY c) AS n,
             {_TRIMMED} AS trimmed FROM o),
s AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen FROM r),
f AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND seen AS duplicate,
             trimmed <> '' AND NOT seen AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS ini,
             coalesce(lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM s),
stats AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                 count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
          FROM f GROUP BY c),
ins(st, ins, cost, mid) AS (VALUES ('', '', 0, ''), ('s', '', 0, 's'), ('u', '', 0, 'u'), ('a', '', 0, 'a'),
  ('', 'u', 2, 'u'), ('s', 'u', 2, 'u'), ('a', 'u', 2, 'u'), ('u', 'a', 2, 'a'),
  ('', 'ua', 4, 'a'), ('s', 'ua', 4, 'a'), ('a', 'ua', 4, 'a'), ('u', 'au', 4, 'u')),
asks AS (SELECT *, CASE WHEN mid = 'u' THEN 'a' ELSE 'u' END AS ask FROM ins),
best AS (
  SELECT c, n AS i, st, min({{'cost': e.cost, 'audit': repeat('I', length(e.ins)), 'steps': e.ins}}) AS b
  FROM (SELECT DISTINCT c, n FROM f) CROSS JOIN asks e WHERE e.mid IN ('', 'a') GROUP BY c, n, st
  UNION ALL
  SELECT f.c, f.i - 1, e.st, min({{'cost': e.cost + op.cost + b.b.cost + CASE WHEN f.truncated AND op.step <> 'D' THEN 1 ELSE 0 END,
                                   'audit': repeat('I', length(e.ins)) || op.edit || b.b.audit, 'steps': e.ins || op.step || b.b.steps}})
  FROM best b JOIN f ON f.c = b.c AND f.i = b.i CROSS JOIN asks e
  JOIN (VALUES ('D', 'D', 3), ('K', 'K', 0), ('U', 'R', 2), ('A', 'R', 2)) AS op(step, edit, cost) ON CASE op.step
    WHEN 'D' THEN b.st = e.mid
    WHEN 'K' THEN NOT f.blank AND NOT f.duplicate AND b.st = f.ini AND (f.ini = e.ask OR f.ini = 's' AND e.mid = '')
    ELSE NOT f.blank AND NOT f.duplicate AND b.st = e.ask AND lower(op.step) = e.ask END
  GROUP BY f.c, f.i - 1, e.st),
found AS (SELECT c, b.cost, b.audit, b.steps FROM best WHERE i = 0 AND st = ''),
tokens AS (SELECT c, regexp_extract_all(steps, '[ua]*[DKUA]') AS t, regexp_extract(steps, '[ua]*$') AS tail FROM found),
put AS (SELECT f.c, f.i, f.role, f.text, right(t[f.i], 1) AS step, left(t[f.i], length(t[f.i]) - 1) AS inserted FROM f JOIN tokens USING (c)),
lines AS (SELECT c, i, j, CASE WHEN ch = 'u' THEN 'user:' WHEN ch = 'a' THEN 'assistant:' WHEN ch = 'K' THEN role || ':' || text
                               WHEN ch = 'U' THEN 'user:' || text ELSE 'assistant:' || text END AS line
          FROM (SELECT c, i, role, text, unnest(string_split(inserted || step, '')) AS ch, unnest(range(1 + length(inserted))) AS j FROM put)
          WHERE ch <> 'D'
          UNION ALL
          SELECT c, 9223372036854775807, j, CASE WHEN ch = 'u' THEN 'user:' ELSE 'assistant:' END
          FROM (SELECT c, unnest(string_split(tail, '')) AS ch, unnest(range(length(tail))) AS j FROM tokens WHERE tail <> '')),
texts AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY i, j)) AS h FROM lines GROUP BY c),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(found.cost, 0) AS BIGINT) AS cost,
       coalesce(found.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN (SELECT DISTINCT conv_id, c FROM o) m ON m.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN stats USING (c) LEFT JOIN found USING (c) LEFT JOIN texts USING (c)
"""
