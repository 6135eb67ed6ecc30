"""DuckDB statements for the corpus queries that SQL can express."""

# the pattern [^\x20\x09-\x0D]+ applied to whole texts
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: smallest id reachable over links (a, b) in both directions; every node has a loop
_REACH = """
reach(id, r) AS (
  SELECT a, a FROM links
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)"""

NEAR_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y USING (s) GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),{_REACH},
parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN parts ON parts.id = d.doc_id
"""

SUBSTRING_SQL = rf"""
WITH words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 34)) AS a, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS b
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT a, b FROM windows GROUP BY a, b HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM windows JOIN again USING (a, b)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at WHERE g.at IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

VECTOR_SQL = rf"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, v, list_dot_product(v, v) AS q FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / sqrt(x.q * y.q) >= 0.98),{_REACH},
parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(coalesce(component_id, e.vec_id), e.vec_id) AS component_id,
  least(coalesce(component_id, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN parts ON parts.id = e.vec_id
"""

CHAT_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
members AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM rows WHERE speaker IS NOT NULL AND speaker <> 'system'),
shown AS (
  SELECT conv_id, perspective, turn, content, coalesce(speaker = perspective, false) AS own,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker = 'system' OR speaker = perspective THEN '' ELSE replace(coalesce(speaker, 'unknown'), '<|', '< |') END AS name
  FROM rows JOIN members ON conv_id IS NOT DISTINCT FROM c),
built AS (
  SELECT *, '<|' || role || '|>' || name || chr(10) AS head FROM shown)
SELECT conv_id, perspective, turn, role, name, head || content || '<|end|>' || chr(10) AS chunk,
  CASE WHEN own THEN length(head) ELSE 0 END AS mask_start,
  CASE WHEN own THEN length(head || content) + 7 ELSE 0 END AS mask_end
FROM built
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = rf"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
docs AS (SELECT row_number() OVER () AS pos, doc_id, {_TERMS} AS w FROM documents),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
counts AS (
  SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2e0 * any_value(n_docs) + 2) / (2e0 * count(*) + 1)))::BIGINT AS w FROM counts, stats GROUP BY term),
lengths AS (SELECT pos, doc_id, 10 + (90 * len(w)::BIGINT * n_docs) // n_terms AS m FROM docs, stats WHERE len(w) > 0),
scores AS (
  SELECT item_id, pos, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (pos) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

#: states (0 nothing, 1 system, 2 user, 3 assistant): which a turn of its role may follow
_FROM = {0: (), 1: (0,), 2: (0, 1, 3), 3: (2,)}


def _reach(state: int) -> str:
    """Cheapest (cost, audit, text) of a state after one turn ``r``, from the best of each state ``b``."""
    part = lambda i, cost, edit, line: f"CASE WHEN b[{i + 1}] IS NOT NULL THEN {{c: b[{i + 1}].c + {cost}, a: b[{i + 1}].a || '{edit}', t: b[{i + 1}].t || {line}}} END"
    ways = [part(state, 2, "D", "''")]
    may, worse = "r.fault NOT IN (1, 2)", "(CASE WHEN r.fault = 3 THEN 5 ELSE 0 END)"
    for i in _FROM[state]:
        letter, name = {1: ("s", ""), 2: ("u", "user"), 3: ("a", "assistant")}[state]
        ways.append(f"CASE WHEN {may} AND left(r.role, 1) = '{letter}' THEN {part(i, worse, 'K', 'chr(10) || r.role || chr(58) || r.text')} END")
        if name:
            ways.append(f"CASE WHEN {may} THEN {part(i, f'1 + {worse}', 'R', f'chr(10) || {chr(39)}{name}{chr(39)} || chr(58) || r.text')} END")
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _widen() -> str:
    """The best of each state when up to three turns may be inserted."""
    add = lambda b, i, name: f"CASE WHEN {b}[{i}] IS NOT NULL THEN {{c: {b}[{i}].c + 5, a: {b}[{i}].a || 'I', t: {b}[{i}].t || chr(10) || '{name}:'}} END"
    best = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda x: x IS NOT NULL))"
    once = lambda b: f"[{b}[1], {b}[2], {best(f'{b}[3]', add(b, 1, 'user'), add(b, 2, 'user'), add(b, 4, 'user'))}, {best(f'{b}[4]', add(b, 3, 'assistant'))}]"
    return once("b")


REPAIR_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS crc FROM range(256) r(b)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)) AS bytes
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role), sha256(text), copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
turns AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM placed),
walk(conv_id, i, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [{{c: 0::BIGINT, a: '', t: ''}}, NULL, NULL, NULL] FROM turns
  UNION ALL
  SELECT w.conv_id, r.i, [{", ".join(_reach(s) for s in range(4))}]
  FROM (SELECT conv_id, i, {_widen()} AS b FROM (SELECT conv_id, i, {_widen()} AS b FROM walk)) w
  JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ends AS (
  SELECT conv_id, list_min(list_filter([b[1], b[4]], lambda x: x IS NOT NULL)) AS e
  FROM (SELECT conv_id, {_widen()} AS b FROM (SELECT conv_id, {_widen()} AS b FROM (SELECT conv_id, max_by(b, i) AS b FROM walk GROUP BY conv_id)))),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""
