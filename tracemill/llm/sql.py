"""SQL answers of the operators' queries, where SQL can state them."""

from tracemill.llm.licenses import NOTICES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
NUMBER = "CAST(('0x' || substr(md5({}), 1, 4)) AS INTEGER)"

OP1 = f"""
WITH hosts AS (SELECT host, {NUMBER.format('host')} AS m FROM (SELECT DISTINCT {HOST} AS host FROM pages WHERE url IS NOT NULL) WHERE host != ''),
domains AS (SELECT value, {NUMBER.format("'d' || value")} AS m FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS value FROM hosts) WHERE value != ''),
prefixes AS (SELECT value, {NUMBER.format("'p' || value")} AS m FROM (SELECT DISTINCT host || '/' || step AS value FROM (
    SELECT {HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS step FROM pages) WHERE host != '' AND step != '')),
valid AS (
    SELECT if(m % 2 = 0, 'malware', 'adult') AS list, 'host' AS kind, host AS value, m % 300 AS since, m % 300 + 60 AS until FROM hosts WHERE m % 3 = 0
    UNION ALL SELECT if(m % 2 = 0, 'malware', 'adult'), 'host', host, m % 300 + 120, 100000 FROM hosts WHERE m % 3 = 0
    UNION ALL SELECT if(m % 2 = 0, 'allow', 'spam'), 'domain', value, m % 200, 100000 FROM domains WHERE m % 5 = 0
    UNION ALL SELECT 'phishing', 'prefix', value, m % 330, m % 330 + 30 FROM prefixes WHERE m % 4 = 0),
captures AS (SELECT page_id, CAST(page_id * 37 % 365 AS INTEGER) AS day, {HOST} AS host,
    host || '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x != ''), '/') || '/' AS place FROM pages),
met AS (SELECT DISTINCT page_id, list, kind, value, since FROM captures JOIN valid ON day >= since AND day < until AND (
    kind = 'host' AND value = host OR kind = 'domain' AND ends_with('.' || host, '.' || value) OR kind = 'prefix' AND starts_with(place, value || '/')))
SELECT page_id, day, any_value(host) AS host, count(list) AS n_active, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists, min(since) AS first_since,
    coalesce(bool_or(list != 'allow') AND NOT bool_or(list = 'allow'), false) AS blocked
FROM captures LEFT JOIN met USING (page_id) GROUP BY page_id, day"""

OP2 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
runs AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM docs)),
later AS (SELECT doc_id, pos FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

OP4 = f"""
WITH docs AS (SELECT doc_id, {PLAIN} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN} AS words FROM benchmark),
wins AS (SELECT item, array_to_string(words[pos:pos + 12], ' ') AS run, least(len(words), 13) AS n FROM (
    SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS pos FROM items WHERE len(words) > 0)),
runs AS (SELECT doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') AS run FROM (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM docs, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT DISTINCT doc_id, pos, n, item FROM runs JOIN wins USING (run, n)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS gram FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS pos FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 90 * (p.n + q.n - n_both)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)"""

_NOTICES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in NOTICES)
OP9 = f"""
WITH docs AS (SELECT doc_id, {PLAIN} AS words FROM documents),
known AS (SELECT license, {PLAIN} AS words FROM (VALUES {_NOTICES}) t(license, text)),
parts AS (SELECT DISTINCT license, len(words) AS n, array_to_string(words[pos:pos + 4], ' ') AS gram FROM (SELECT license, words, unnest(range(1, len(words) - 3)) AS pos FROM known)),
totals AS (SELECT license, count(*) AS items FROM parts GROUP BY license),
grams AS (SELECT doc_id, n_words, pos, array_to_string(words[pos:pos + 4], ' ') AS gram FROM (SELECT doc_id, words, len(words) AS n_words, unnest(range(1, len(words) - 3)) AS pos FROM docs)),
spots AS (SELECT DISTINCT doc_id, license, n, gram, unnest(range(greatest(pos - n + 5, 1), least(pos, n_words - n + 1) + 1)) AS start FROM grams JOIN parts USING (gram)),
wins AS (SELECT doc_id, license, start, count(*) AS shared FROM spots GROUP BY ALL),
good AS (SELECT doc_id, license, start, shared / items AS part FROM wins JOIN totals USING (license) WHERE 5 * shared >= 4 * items)
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, count(license) AS n_windows, CAST(min(start) - 1 AS BIGINT) AS first_start, max(part) AS best_share
FROM docs LEFT JOIN good USING (doc_id) GROUP BY doc_id"""

# The unsigned CRC-32 of a short text of ASCII signs, bit by bit.
CRC32 = ("xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b: xor(crc >> 8, "
         "list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b) & 255)), CAST(4294967295 AS BIGINT)))")
FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP12 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_HEAD} || {FIELD.format('text')}) AS leaf,
        CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({_HEAD} || {FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS shown
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
    SELECT tree, 0 AS level, CAST(pos AS BIGINT) AS pos, leaf AS digest, CAST(n AS BIGINT) AS n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 7) // 8) FROM low WHERE n > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, digest AS subroot, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, pos, subroot AS digest, CAST(n AS BIGINT) AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (SELECT tree, level, pos, digest, n FROM low UNION ALL SELECT '', level, pos, digest, n FROM high),
flanks AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
starts AS (SELECT row_number() OVER () AS k, p.doc_id, p.tree, p.leaf, coalesce(p.shown, p.leaf) AS start, p.pos, s.subroot, s.pos AS place FROM placed p JOIN subroots s USING (tree)),
climb AS (
    SELECT k, tree AS own, tree, 0 AS level, pos, place, start AS fold, '' AS proof FROM starts
    UNION ALL
    SELECT c.k, c.own, CASE WHEN f.l IS NULL THEN '' ELSE c.tree END, CASE WHEN f.l IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN f.l IS NULL THEN place ELSE c.pos // 8 END, place,
        CASE WHEN f.l IS NULL THEN c.fold ELSE sha256(f.l || c.fold || f.r) END, CASE WHEN f.l IS NULL THEN c.proof ELSE c.proof || f.l || f.r END
    FROM climb c LEFT JOIN flanks f ON f.tree = c.tree AND f.level = c.level AND f.pos = c.pos WHERE f.l IS NOT NULL OR c.tree != ''),
ends AS (SELECT k, fold, proof FROM climb WHERE tree = '' AND (level, pos) NOT IN (SELECT (level, pos) FROM flanks WHERE tree = ''))
SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT digest FROM high WHERE n = 1) AS verified
FROM starts JOIN ends USING (k)"""

TURN = "md5(octet_length(encode(role)) || ':' || role || text)"
OP13 = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {TURN} AS t, len({WORDS}) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN}) - 1 AS pos FROM given),
convs AS (SELECT conv_id, {CRC32.format('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
built AS (
    SELECT c.conv_id, 0 AS piece, pos, t, words FROM convs c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
    UNION ALL SELECT conv_id, 1, pos, t, words FROM own JOIN convs USING (conv_id) WHERE pos >= h),
steps AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY piece, pos) AS depth FROM built),
prefixes AS (
    SELECT conv_id, depth, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name, words FROM steps
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
    FROM prefixes JOIN lengths USING (conv_id) GROUP BY name, depth),
kids AS (SELECT substr(name, 1, 32 * (depth - 1)) AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
ups AS (SELECT substr(name, 1, 32 * d) AS name, n_children IS NULL AS childless, (n_convs - 1) * words AS gain
    FROM (SELECT nodes.*, n_children, unnest(range(CAST(depth AS BIGINT) + 1)) AS d FROM nodes LEFT JOIN kids USING (name))),
below AS (SELECT name, count(*) FILTER (childless) AS n_leaves, CAST(sum(gain) AS BIGINT) AS saved_tokens FROM ups GROUP BY name)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN kids USING (name) JOIN below USING (name) LEFT JOIN nodes p ON n.depth > 0 AND p.name = substr(n.name, 1, 32 * (n.depth - 1))"""

ORACLES = {"op1_url_lists": OP1, "op2_substring_dedup": OP2, "op4_benchmark_decontamination": OP4, "op5_ngram_jaccard": OP5, "op9_license_scan": OP9,
           "op12_merkle_manifest": OP12, "op13_conversation_trie": OP13}
