"""DuckDB SQL of the queries that SQL can express."""

_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Overheads of the template: opener + blank, blank + closer; a turn whose text
# holds a control string is escaped and marked with one "!".
_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[ANSWER]'
              ELSE '[TURN ' || replace(regexp_replace(role, '[\\<>\[\]/]', '\\\0', 'g'), '\[T', '\[\T') || ']' END AS opener,
         CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>'
              ELSE '[/TURN]' END AS closer
  FROM rows),
sized AS (
  SELECT *, length(opener) + 1 + length(text) + 1 + length(closer)
    + CASE WHEN regexp_matches(text, '<<SYS>>|\[INST\]|\[ANSWER\]|<</SYS>>|\[/INST\]|</s>|\[TURN|\[/TURN\]') THEN 1 + len(regexp_extract_all(text,
        '<<SYS>>|\[INST\]|\[ANSWER\]|<</SYS>>|\[/INST\]|</s>|\[TURN|\[/TURN\]|\\')) ELSE 0 END AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_DECONTAM = rf"""
WITH bench AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, len(p) AS size, array_to_string(p, ' ') AS win FROM (
    SELECT item, unnest(CASE WHEN len(w) < 10 THEN [w]
                        ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p
    FROM bench WHERE len(w) > 0)),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_SMALL.replace('text', "coalesce(text, '')", 1)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
spots AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT rid, s.i, s.size, item FROM spots s JOIN wins ON wins.size = s.size
         AND wins.win = array_to_string(w[s.i:s.i + s.size - 1], ' ')),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_JACCARD = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_SMALL.replace('text', "coalesce(text, '')", 1)}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM docs),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)
  UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (
  SELECT a AS node, a AS r FROM (SELECT DISTINCT a FROM links)
  UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.node)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT node, min(r) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

_URLS = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
                                ('block', 'net/es/'), ('block', 'net/fr/')),
split AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT page_id, host, path, s.rule, s.verdict, row_number() OVER (PARTITION BY r.rid ORDER BY length(s.rule) DESC, length(h) DESC) AS k
  FROM (SELECT row_number() OVER () AS rid, * FROM parsed) r
  LEFT JOIN split s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
WHERE k = 1
"""

_DIVERGENCE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_SMALL.replace('text', "coalesce(text, '')", 1)}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT rid, lang, source, unnest(w) AS term FROM docs),
vocab AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n_lang FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN vocab USING (lang, term) GROUP BY ALL),
pairs AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT p.lang, p.source, v.term, coalesce(f.n, 0) AS n, v.n_lang FROM pairs p JOIN vocab v USING (lang)
           LEFT JOIN found f ON f.lang = p.lang AND f.source = p.source AND f.term = v.term),
langs AS (SELECT lang, sum(n_lang) AS total, count(*) AS v FROM vocab GROUP BY lang),
shares AS MATERIALIZED (
  SELECT c.lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY c.lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (n_lang + 5)) // (total + 5 * v) AS q
  FROM counts c JOIN langs USING (lang)),
over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
apart AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM over UNION ALL SELECT * FROM apart))
WHERE part = 'pair' OR rank <= 50
"""

# Nodes are (key, level, place, n): the place at a level and how many nodes the level has. A source's tree hangs under the
# tree of the sources' roots; a leaf's path is the nodes beside its own at each level of both.
_FIELDS = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
                    for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || {0} END"


def _climb(name: str, base: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, 0 AS level, place, n, digest FROM {base}
  UNION ALL SELECT {key}, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM {name} WHERE n > 1 GROUP BY {key}, level, place // 16, n)"""


_MERKLE = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, sha256(concat({_FIELDS}, {_TEXT.format('text')})) AS leaf,
    sha256(concat({_FIELDS}, {_TEXT.format(_SMALL)})) AS changed FROM documents),
crcs AS MATERIALIZED (
  SELECT doc_id, xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END, 4294967295), 4294967295) % 5 = 0 AS tampered
  FROM (SELECT DISTINCT doc_id::BIGINT AS doc_id FROM documents WHERE doc_id IS NOT NULL)),
placed AS MATERIALIZED (
  SELECT d.*, coalesce(c.tampered, false) AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
    leaf AS digest FROM docs d LEFT JOIN crcs c USING (doc_id)),
{_climb('low', 'placed', 'tree')},
tops AS MATERIALIZED (SELECT 0 AS one, tree AS place, digest, count(*) OVER () AS n FROM low WHERE n = 1),
{_climb('high', 'tops', 'one')},
nodes AS MATERIALIZED (
  SELECT tree, level, place, digest, n FROM low
  UNION ALL SELECT NULL, level, place, digest, n FROM high),
path AS (
  SELECT rid, p.tree, 0 AS step, p.tree AS branch, 0 AS level, p.place, p.n, CASE WHEN tampered THEN changed ELSE leaf END AS digest,
    '' AS proof FROM placed p
  UNION ALL
  SELECT rid, tree, step + 1, branch2, level2, place2, n2, digest2, proof2 FROM (
    SELECT x.rid, x.tree, x.step, x.branch AS branch2, x.level + 1 AS level2, x.place // 16 AS place2, (x.n + 15) // 16 AS n2,
      sha256(string_agg(CASE WHEN s.place = x.place THEN x.digest ELSE s.digest END, '' ORDER BY s.place)) AS digest2,
      x.proof || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place <> x.place), '') AS proof2
    FROM path x JOIN nodes s ON s.tree IS NOT DISTINCT FROM x.branch AND s.level = x.level AND s.place // 16 = x.place // 16
    WHERE x.n > 1 GROUP BY x.rid, x.tree, x.step, x.branch, x.level, x.place, x.n, x.digest, x.proof
    UNION ALL
    SELECT x.rid, x.tree, x.step, NULL, 0, x.tree, (SELECT any_value(n) FROM tops), x.digest, x.proof
    FROM path x WHERE x.n = 1 AND x.branch IS NOT NULL)),
ends AS (SELECT rid, digest, proof FROM path WHERE branch IS NULL AND n = 1)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, e.digest AS folded_root,
  e.digest = r.digest AS verified
FROM placed JOIN tops t ON t.place = placed.tree JOIN ends e USING (rid), (SELECT digest FROM high WHERE n = 1) r
"""

_WARC = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
kept AS (SELECT digest, max(page_id) AS first FROM rows WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, rows.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN kept ON kept.digest = rows.digest AND n >= 1000
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": _CHAT,
    "op4_decontaminate": _DECONTAM,
    "op7_jaccard_join": _JACCARD,
    "op8_url_filter": _URLS,
    "op11_source_divergence": _DIVERGENCE,
    "op12_merkle_manifest": _MERKLE,
    "op13_warc": _WARC,
}
