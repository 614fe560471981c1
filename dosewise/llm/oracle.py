"""Plain SQL (DuckDB) of the training-data queries that SQL can express."""

from __future__ import annotations

from dosewise.llm.common import LAST_ID
from dosewise.llm.license_scan import BLOCK, STEP, TEMPLATES
from dosewise.llm.quality_rules import ALPHA, DELTA, GRIDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CELLS = ", ".join(f"('{r}', {c})" for r, grid in GRIDS.items() for c in grid)
_RATE = ALPHA / len(GRIDS)
_CHOSEN = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS {r}" for r in GRIDS)
_OVER = " OR ".join(f"coalesce(m.{r} > c.{r}, false)" for r in GRIDS)

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
places AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5),
again AS (SELECT rid, i FROM places QUALIFY count(*) OVER (PARTITION BY rid, array_to_string(ws[i : i + 4], ' ')) > 1),
covered AS (SELECT rid, sum(n) AS n FROM (SELECT rid, least(5, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -9)) AS n FROM again) GROUP BY rid),
counts AS (SELECT d.rid, doc_id, lang, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, len(t) - len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
    len(t) - len(replace(t, '!', '')) AS n_shouts, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered ON d.rid = covered.rid),
m AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls))) / len(ls) ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END AS capital_share,
    CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END AS shout_share FROM counts),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
long AS (UNPIVOT (SELECT lang, good, {", ".join(GRIDS)} FROM m JOIN known USING (doc_id)) ON {", ".join(GRIDS)} INTO NAME rule VALUE share),
tested AS (SELECT lang, rule, cutoff, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (good = 0) AS n_bad,
    count(*) FILTER (good = 1 AND share > cutoff) AS k_good, count(*) FILTER (good = 0 AND share > cutoff) AS k_bad
    FROM long JOIN (VALUES {_CELLS}) AS c(rule, cutoff) USING (rule) GROUP BY lang, rule, cutoff),
strata AS (SELECT lang, any_value(n_good) AS n, count(*) OVER () * {sum(map(len, GRIDS.values()))} AS tests FROM tested WHERE n_good > 0 GROUP BY lang),
terms AS (SELECT lang, n, tests, unnest(generate_series(0, CAST(floor(n * {_RATE!r}) AS BIGINT))) AS i FROM strata),
tails AS (SELECT lang, i, tests, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE!r}) + (n - i) * ln(1 - {_RATE!r}))) OVER (PARTITION BY lang ORDER BY i) AS cdf FROM terms),
allowed AS (SELECT lang, coalesce(max(i) FILTER (cdf <= {DELTA} / tests), -1) AS k FROM tails GROUP BY lang),
best AS (SELECT t.lang, rule, cutoff FROM tested t JOIN allowed a ON t.lang IS NOT DISTINCT FROM a.lang
    WHERE k_good <= k AND k_bad * n_good - k_good * n_bad > 0
    QUALIFY row_number() OVER (PARTITION BY t.lang, rule ORDER BY k_bad * n_good - k_good * n_bad DESC, cutoff DESC) = 1),
chosen AS (SELECT lang, {_CHOSEN} FROM best GROUP BY lang),
judged AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_OVER} AS rejected
    FROM m LEFT JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha, {1 + 10 * chunk}, 10))::UBIGINT >> {35 - 5 * k}) & 31 AS BIGINT), 1)"
    for chunk in range(4) for k in range(8))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha, coalesce(page_id, {LAST_ID}) AS o FROM pages),
f AS (SELECT *, min(o) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN o > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o > first THEN first END AS refers_to FROM f"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST_ID}) AS o, {_WORDS} AS ws FROM documents),
places AS (SELECT rid, o, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50),
windows AS (SELECT rid, o, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM places),
again AS (SELECT rid, i FROM windows QUALIFY min(o) OVER (PARTITION BY h) < o),
gone AS (SELECT DISTINCT rid, i + k AS i FROM again, generate_series(0, 49) AS s(k)),
each AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
rest AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (rid, i) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (rid) LEFT JOIN lost USING (rid)"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
each AS (SELECT *, [1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sums),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM each),
final AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final) * weight), cap) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM plan),
groups AS (SELECT source, doc_id, size, ord, count(*) AS n FROM d GROUP BY ALL),
line AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY ord, coalesce(doc_id, {LAST_ID}), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM groups),
parts AS (SELECT l.source, l.doc_id, l.size, CAST(greatest(0, least(l.size * n, rest - start)) AS BIGINT) // n AS part FROM line l JOIN rests r ON l.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(whole * d.size + part AS BIGINT) AS taken
FROM d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
JOIN parts p ON d.source IS NOT DISTINCT FROM p.source AND d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.size = p.size"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, coalesce(vec_id, {LAST_ID}) AS o, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT rid, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b FROM sound a JOIN sound b ON a.rid < b.rid AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS rid, min(o) AS low FROM reach JOIN v ON reach.b = v.rid GROUP BY a),
n AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, nullif(low, {LAST_ID}) AS component_id, vec_id IS NOT DISTINCT FROM nullif(low, {LAST_ID}) AS kept
FROM v JOIN comp USING (rid) LEFT JOIN n USING (rid)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join(f"('{t.label}', {str(t.phrase).lower()}, {[w.decode() for w in t.words]}, {t.need})" for t in TEMPLATES)

LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
t AS (SELECT label, phrase, seq, list_distinct(seq) AS ds, need FROM (VALUES {_TEMPLATES}) AS v(label, phrase, seq, need)),
blocks AS (SELECT rid, ws[k * {STEP} + 1 : k * {STEP} + {BLOCK}] AS b FROM (SELECT rid, ws, unnest(generate_series(0, (len(ws) - 1) // {STEP})) AS k FROM d WHERE len(ws) > 0)),
met AS (SELECT rid, label, len(list_intersect(b, ds)) / len(ds) AS share FROM blocks JOIN t ON NOT phrase AND len(list_intersect(b, ds)) >= need),
places AS (SELECT rid, label, i - 1 AS p FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM d) JOIN t ON phrase AND ws[i : i + len(seq) - 1] = seq),
base AS (SELECT rid, count(*) AS n, min(p) AS lo, max(p) AS hi FROM places GROUP BY rid),
every AS (SELECT rid, label, 1 AS share, true AS phrase FROM places UNION ALL SELECT rid, label, share, false FROM met),
named AS (SELECT rid, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels FROM every GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)"""

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
n AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, n),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(ws) * n_docs) // n_terms AS m FROM d, n),
items AS (SELECT iid, item_id, unnest(list_distinct(ws)) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS ws FROM benchmark)),
scored AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, coalesce(doc_id, {LAST_ID})) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

# CRC-32 of a decimal number, bit by bit
_CRC = ("list_reduce([CAST(x AS UBIGINT) FOR x IN list_transform(regexp_extract_all(CAST(c AS VARCHAR), '.'), lambda s: ascii(s))], lambda crc, b: "
        "list_reduce([CAST(k AS UBIGINT) FOR k IN range(8)], lambda r, k: xor(r >> 1, (CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)::UBIGINT), xor(crc, b)), 4294967295::UBIGINT)")

TRIE = f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'h': h, 'chars': chars}} ORDER BY turn NULLS FIRST, h) AS ts FROM t GROUP BY c),
h AS (SELECT c, ts, CAST(xor({_CRC}, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM o),
r AS (SELECT a.c, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 :]) AS ts FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 100),
p AS (SELECT c, len(ts) AS n, unnest(generate_series(0, len(ts))) AS d, ts FROM r),
k AS (SELECT c, n, d, md5(array_to_string([x.h FOR x IN ts[1 : d]], ',')) AS id, CASE WHEN d > 0 THEN md5(array_to_string([x.h FOR x IN ts[1 : d - 1]], ',')) END AS up,
    CASE WHEN d > 0 THEN ts[d].chars ELSE 0 END AS chars FROM p),
node AS (SELECT id, d, up, chars, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM k GROUP BY ALL),
kids AS (SELECT up AS id, count(*) AS n FROM node GROUP BY up),
below AS (SELECT DISTINCT a.id AS top, b.id FROM k a JOIN k b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS id, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM below JOIN node USING (id) LEFT JOIN kids USING (id) GROUP BY top)
SELECT node.c AS conv_id, node.d AS depth, u.c AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums USING (id) LEFT JOIN kids ON kids.id = node.id LEFT JOIN node u ON u.id = node.up"""
