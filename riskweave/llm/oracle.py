"""DuckDB SQL of the registered queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from riskweave.llm.chat import CONTROL, MARKS, OTHER
from riskweave.llm.quality_rules import MIN_GAIN, RULES, STEPS
from riskweave.llm.url_graph import DAMPING, LINK, MASS, MAX_HOST, ROUNDS, THRESHOLD

RATE = 0.05 / len(RULES)  # the default alpha, shared out among the rules
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, CAST(ceil({r} * {STEPS}) AS INT) AS step FROM s WHERE NOT base_failed" for r in RULES)
RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0 END AS upper_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share FROM b),
m AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS ({_UNPIVOT}),
k AS (SELECT lang, rule, step, m.good FROM x JOIN m ON m.doc_id = x.doc_id),
t AS (SELECT lang, rule, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM k)) AS tests FROM k GROUP BY lang, rule),
j AS (SELECT t.*, cutoff, (SELECT count(*) FROM k WHERE k.lang = t.lang AND k.rule = t.rule AND good AND step >= cutoff) AS kg,
  (SELECT count(*) FROM k WHERE k.lang = t.lang AND k.rule = t.rule AND NOT good AND step >= cutoff) AS kb FROM t, range(1, {STEPS + 1}) c(cutoff)),
p AS (SELECT *, CASE WHEN kg >= n * {RATE} THEN 1 ELSE list_sum(list_transform(range(0, kg + 1), lambda i:
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RATE}) + (n - i) * ln({1 - RATE})))) END <= 0.05 / tests AS ok FROM j),
q AS (SELECT *, kb / greatest(nb, 1) - kg / n AS gain FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS fine FROM p) WHERE fine),
f AS (SELECT lang, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) AS o FROM q) WHERE o = 1 AND gain >= {MIN_GAIN}),
bad AS (SELECT DISTINCT x.doc_id FROM x JOIN f ON f.lang = x.lang AND f.rule = x.rule AND x.step >= f.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM s
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM w, unnest(range(1, len(w))) u(i) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""

_CONTROL = "|".join([r"\\", *("".join("\\" + c if c in "[]/<>" else c for c in x) for x in CONTROL)])
_FRAME = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
TURNS = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role {_FRAME}
  ELSE {sum(map(len, OTHER))} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS size FROM r),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM a
"""

REPEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM w, unnest(range(1, len(w) - 18)) u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS o FROM g) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT w.doc_id, p, w[p] AS word FROM w, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.p = e.p WHERE gone.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def _level(parent: str, above: str, name: str, key: list[str], level: str) -> str:
    """One step of water-filling in SQL: the budget of each node at ``level`` from its parent's."""
    part = f"PARTITION BY {', '.join(key[:-1])}" if key[:-1] else ""
    order = f"({part} ORDER BY CASE WHEN w > 0 THEN supply / w ELSE CAST('inf' AS DOUBLE) END, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    match = " AND ".join(f"{above}.{k} = n.{k}" for k in key[:-1]) or "true"
    return f"""
{name}_n AS (SELECT {', '.join(key)}, sum(supply) AS supply, max(w_{level}) AS w FROM {parent} GROUP BY {', '.join(key)}),
{name}_l AS (SELECT n.*, {above}.budget AS total FROM {name}_n n JOIN {above} ON {match}),
{name}_r AS (SELECT *, total - coalesce(sum(supply) OVER {order}, 0) AS lb, sum(w) OVER ({part}) - coalesce(sum(w) OVER {order}, 0) AS lw FROM {name}_l),
{name}_v AS (SELECT *, max(CASE WHEN w > 0 AND supply * lw >= w * lb THEN lb / lw END) OVER ({part}) AS level FROM {name}_r),
{name} AS (SELECT {', '.join(key)}, CASE WHEN w <= 0 THEN 0 WHEN level IS NULL THEN supply ELSE least(supply, w * level) END AS budget FROM {name}_v)"""


def mix_sql(weights: list[tuple[str, str, float]], fraction: float, epochs: int, seed: str = "mix") -> str:
    w = {level: " ".join(f"WHEN '{n}' THEN {x}" for a, n, x in weights if a == level) for level in ("domain", "lang", "source")}
    case = lambda level: f"CAST(CASE {level} {w[level]} ELSE 1 END AS DOUBLE)"
    number = r"TRY_CAST(regexp_extract(coalesce(source, ''), '^src([0-9]{1,9})$', 1) AS INT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CASE WHEN {number} < 5 THEN 'core' WHEN {number} < 15 THEN 'web' ELSE 'rest' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens, md5(coalesce(text, '')) AS body FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, CAST(sum(tokens) * {epochs} AS DOUBLE) AS supply, {case('domain')} AS w_domain, {case('lang')} AS w_lang, {case('source')} AS w_source FROM d GROUP BY domain, lang, source),
whole AS (SELECT CAST(floor(sum(tokens) * CAST({fraction} AS DOUBLE)) AS DOUBLE) AS budget FROM leaf),
{_level('leaf', 'whole', 'b1', ['domain'], 'domain')},{_level('leaf', 'b1', 'b2', ['domain', 'lang'], 'lang')},{_level('leaf', 'b2', 'b3', ['domain', 'lang', 'source'], 'source')},
o AS (SELECT d.*, e AS mix_epoch, md5(concat_ws(':', '{seed}', e, coalesce(CAST(doc_id AS VARCHAR), ''), body)) AS digest FROM d, range(0, {epochs}) r(e)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY mix_epoch, digest) AS upto FROM o)
SELECT c.doc_id, c.lang, c.source, c.domain AS mix_domain, CAST(mix_epoch AS INT) AS mix_epoch, CAST(tokens AS BIGINT) AS mix_tokens
FROM c JOIN b3 ON b3.domain = c.domain AND b3.lang = c.lang AND b3.source = c.source WHERE floor(budget) > 0 AND upto <= floor(budget)
"""


def urls_sql(rules: list[tuple[str, str, str]], rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    """Rules as a table, and the rounds of the two ranks as one common table each."""
    named = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    step = ", ".join(
        f"""r{i} AS (SELECT host, trusted, CAST(sum(mass) AS BIGINT) AS mass FROM (
  SELECT a.dst AS host, a.trusted, (r.mass * {DAMPING}) // (a.degree * 100) AS mass FROM arc a JOIN r{i - 1} r ON r.host = a.src AND r.trusted = a.trusted
  UNION ALL SELECT host, trusted, (mass * {100 - DAMPING}) // 100 FROM r0) GROUP BY host, trusted)"""
        for i in range(1, rounds + 1)
    )
    link = LINK.replace("'", "''")
    return rf"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rule(verdict, rhost, rpath) AS (VALUES {named}),
hit AS (SELECT DISTINCT host, path, verdict, rhost || rpath AS rule FROM (SELECT DISTINCT host, path FROM p), rule
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
top AS (SELECT host, path, arg_min(rule, o) AS rule, arg_min(verdict, o) AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule, verdict DESC) AS o FROM hit) GROUP BY host, path),
j AS (SELECT page_id, html, p.host, p.path, rule, verdict FROM p LEFT JOIN top ON top.host = p.host AND top.path = p.path),
far AS (SELECT DISTINCT host AS src, unnest(list_append(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')), host)) AS dst FROM p),
link AS (SELECT DISTINCT src, dst FROM far WHERE src <> '' AND dst <> '' AND length(src) <= {MAX_HOST} AND length(dst) <= {MAX_HOST}),
part AS (SELECT string_split(host, '.') AS l FROM (SELECT src AS host FROM link UNION SELECT dst FROM link)),
tree AS (SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high FROM part, unnest(range(1, len(l) - 1)) t(i)),
edge AS (SELECT * FROM (SELECT src, dst FROM link UNION SELECT low, high FROM tree UNION SELECT high, low FROM tree) WHERE src <> dst),
way AS (SELECT src, dst, true AS trusted FROM edge UNION ALL SELECT dst, src, false FROM edge),
arc AS (SELECT src, dst, trusted, count(*) OVER (PARTITION BY src, trusted) AS degree FROM way),
vote AS (SELECT host, sum(CASE verdict WHEN 'allow' THEN 1 ELSE -1 END) AS n FROM j WHERE verdict IS NOT NULL AND host <> '' GROUP BY host HAVING n <> 0),
r0 AS (SELECT host, n > 0 AS trusted, {MASS} // count(*) OVER (PARTITION BY n > 0) AS mass FROM vote),
{step},
bad AS (SELECT host FROM r{rounds} GROUP BY host HAVING coalesce(sum(mass) FILTER (NOT trusted), 0) > {threshold} * coalesce(sum(mass) FILTER (trusted), 0))
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


# crc32 of a text of digits, bit by bit: a byte is folded in, then eight shifts follow (-1).
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"""
TRIE = rf"""
WITH t AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv, conv - conv % 20 AS root, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv FROM t)),
s AS (SELECT c.conv, t.i, 0 AS own, role, text FROM c JOIN t ON t.conv = c.root WHERE t.i <= h
  UNION ALL SELECT c.conv, t.i, 1, role, text FROM c JOIN t ON t.conv = c.conv WHERE t.i > h),
n AS (SELECT c.conv, coalesce(list([role, text] ORDER BY own, i) FILTER (role IS NOT NULL), []) AS p FROM c LEFT JOIN s ON s.conv = c.conv GROUP BY c.conv),
x AS (SELECT conv, d, p[:d] AS k, d = len(p) AS last, p[d][2] AS text FROM n, unnest(range(0, len(p) + 1)) u(d)),
g AS (SELECT d, k, min(conv) AS conv, count(*) AS m,
  sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (last), '')) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(text), '{WORD}')) END AS words FROM x GROUP BY d, k),
kid AS (SELECT k[:d - 1] AS k, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(kid.n, 0) AS kids FROM g LEFT JOIN kid ON kid.d = g.d AND kid.k = g.k),
sub AS (SELECT a.d, a.k, sum(CASE WHEN b.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.m - 1) * b.words) AS saved
  FROM (SELECT unnest(range(0, d + 1)) AS a, d, k, m, words, kids FROM w) b JOIN w a ON a.d = b.a AND a.k = b.k[:b.a] GROUP BY a.d, a.k)
SELECT w.conv AS conv_id, CAST(w.d AS BIGINT) AS depth, up.conv AS parent_conv_id, CAST(w.m AS BIGINT) AS n_convs, CAST(w.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN sub ON sub.d = w.d AND sub.k = w.k LEFT JOIN w up ON up.d = w.d - 1 AND up.k = w.k[:w.d - 1] AND w.d > 0
"""
