"""DuckDB SQL for the queries of this subpackage that SQL can express.

None for op2 (keyed permutations), op5 and op12 (tokenizers), op9 (edit distances)
and the pipeline: tests hold those against plain Python. Op4 hashes strings of
1, 2, 4 ... 128 and then 200 bytes; op6 spells out xxHash64 of a long and
CRC-32, both of which DuckDB lacks.
"""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTROL = r"/?s>|/?ROLE\]|/?NEXT\]|/?INST\]|\|[a-z_]{1,32}\|>"


def escaped(c: str) -> str:
    return rf"regexp_replace(replace({c}, '\', '\\'), '([<\[])({CONTROL})', '\1\\\2', 'g')"


OP1 = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w <> role, true) AS head FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({escaped("text")}) + CASE WHEN head THEN 17 + length({escaped("role")}) ELSE 6 END))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""

OP3 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

OP8 = f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM w WHERE len(w) >= 20),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again CROSS JOIN range(20) t(j)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w.w) AS n_words, len(w.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def rule(metric: str, value: str, below: bool, above: bool) -> str:
    """A document passes if its value lies within the distance allowed from the median of its group."""
    far = f"greatest(1, 8 * greatest(2 * ({metric}.q[3] - {metric}.q[1]), {metric}.l) // 4, {metric}.q[2] // 20) * sqrt(greatest(1.0, 100 / greatest(n_words, 1)::DOUBLE))"
    sides = ([f"{value} - {metric}.q[2] >= -{far}"] if below else []) + ([f"{value} - {metric}.q[2] <= {far}"] if above else [])
    return " AND ".join(f"coalesce({x}, true)" for x in sides)


VALUES = {"mean_chars": "word_chars * 100 // nullif(n_words, 0)", "marks": "n_marks * 1000 // nullif(n_words, 0)", "variety": "CASE WHEN n_words > 1 THEN floor(1000 * ln(n_distinct::DOUBLE) / ln(n_words::DOUBLE) + 0.000001::DOUBLE)::BIGINT END"}
OP7 = rf"""WITH w AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g FROM w WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again CROSS JOIN range(5) t(j) GROUP BY doc_id),
s AS MATERIALIZED (
  SELECT doc_id, lang, source, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS n_marks, len(list_distinct(w.w)) AS n_distinct
  FROM w LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT lang, source, docs, metric, CASE WHEN x < 10000 THEN x ELSE x - x % (1::BIGINT << length(bin(x // 10000))) END AS x FROM (
    SELECT lang, source, docs, unnest({list(VALUES)}) AS metric, unnest([{", ".join(VALUES.values())}]) AS x
    FROM (SELECT lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_distinct, count(*) AS docs FROM s WHERE n_words > 0 GROUP BY ALL)) WHERE x IS NOT NULL),
u AS (SELECT *, unnest(range(length(bin(docs)))) AS again FROM v),
o AS (SELECT lang, source, metric, sum(docs) FILTER (again = 0) AS n, quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM u GROUP BY ALL),
l AS (SELECT lang, metric, sum(docs) FILTER (again = 0) AS n, quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM u GROUP BY ALL),
a AS (SELECT metric, quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM u GROUP BY ALL),
q AS (
  SELECT o.lang, o.source, o.metric, {{'q': CASE WHEN o.n >= 30 THEN o.q WHEN l.n >= 30 THEN l.q ELSE a.q END, 'l': floor(quantile_cont(o.q[3] - o.q[1], 0.5) FILTER (o.n >= 30) OVER (PARTITION BY o.lang, o.metric))::BIGINT}} AS q
  FROM o JOIN l ON o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang JOIN a ON a.metric = o.metric),
p AS (SELECT lang, source, {", ".join(f"any_value(q) FILTER (metric = '{m}') AS {m}" for m in VALUES)} FROM q GROUP BY ALL),
b AS (SELECT s.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, mean_chars, marks, variety FROM s LEFT JOIN p ON s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {rule("mean_chars", VALUES["mean_chars"], True, True)} AND {rule("marks", VALUES["marks"], False, True)} AND {rule("variety", VALUES["variety"], True, False)} AS kept
FROM b"""

OP10 = f"""WITH d AS (
  SELECT doc_id, source, size, length(bin(size + 1)) AS bits, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 64 AS slot
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS top FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN top <= level * w THEN top ELSE max(CASE WHEN top > level * w THEN level END) OVER () * w END AS target,
    (('0x' || substr(md5('0|' || coalesce('=' || source, '')), 1, 8))::BIGINT % 65536) / 65536.0::DOUBLE AS start FROM l),
x AS (
  SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY bits * 4 + ((size + 1) * 4 >> (bits - 1)), slot, size, doc_id NULLS FIRST) AS at_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, least(floor(at_ * rate + start) - floor((at_ - 1) * rate + start), 2)::BIGINT AS copies FROM x)"""


def pairs(span: int) -> str:
    """Hashes of all strings of twice ``span`` bytes from those of ``span`` bytes."""
    return f"list_transform(range(1, greatest(len(h) - {span - 1}, 1)), lambda i: hash(h[i], h[i + {span}]))"


OP4 = f"""WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h1 AS (SELECT doc_id, regexp_extract_all(x, '..') AS h FROM b WHERE length(x) >= 400),
h2 AS (SELECT doc_id, {pairs(1)} AS h FROM h1),
h4 AS (SELECT doc_id, {pairs(2)} AS h FROM h2),
h8 AS (SELECT doc_id, {pairs(4)} AS h FROM h4),
h16 AS (SELECT doc_id, h AS h8, {pairs(8)} AS h FROM h8),
h32 AS (SELECT doc_id, h8, {pairs(16)} AS h FROM h16),
h64 AS (SELECT doc_id, h8, {pairs(32)} AS h FROM h32),
h128 AS (SELECT doc_id, h8, h AS h64, {pairs(64)} AS h FROM h64),
w AS (SELECT doc_id, unnest(range(0, len(h8) - 192)) AS i, unnest(list_transform(range(1, len(h8) - 191), lambda i: hash(h[i], h64[i + 128], h8[i + 192]))) AS g FROM h128),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM w) WHERE k > 1),
edge AS (SELECT *, coalesce(i > lag(i) OVER o + 200, true) AS head FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, min(i) AS first, max(i) + 200 AS past FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r),
cut AS (SELECT doc_id, first, past FROM run UNION ALL SELECT doc_id, length(x) // 2, length(x) // 2 + 1 FROM b),
gap AS (SELECT doc_id, coalesce(lag(past) OVER o, 0) AS at_, first AS until FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY first, past)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * at_ + 1, 2 * (until - at_)), '' ORDER BY at_, until) AS t, count(*) - 1 AS n FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, (length(x) - length(t)) // 2 AS n_removed, n AS n_spans, sha256(unhex(t)) AS kept_sha256 FROM b JOIN kept USING (doc_id)"""

#: The five primes of xxHash64, and the polynomial of CRC-32.
XX = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
CRC = 3988292384
WHOLE = "18446744073709551616::UHUGEINT"


def times(x: str, factor: int) -> str:
    return f"(({x})::UHUGEINT * {factor}::UHUGEINT % {WHOLE})::UBIGINT"


def plus(x: str, summand: int) -> str:
    return f"((({x})::UHUGEINT + {summand}::UHUGEINT) % {WHOLE})::UBIGINT"


def turned(x: str, bits: int) -> str:
    return f"({times(x, 1 << bits)} | ({x} >> {64 - bits}))"


OP6 = f"""WITH RECURSIVE owner AS (
  SELECT 1 AS n, range AS vslot, 0 AS shard FROM range(4096)
  UNION ALL
  SELECT n + 1, vslot, CASE WHEN row_number() OVER (ORDER BY held - given DESC, shard) <= 4096 // (n + 1) THEN n ELSE shard END
  FROM (SELECT *, count(*) OVER (PARTITION BY shard) AS held, row_number() OVER (PARTITION BY shard ORDER BY vslot DESC) AS given FROM owner WHERE n < 41)),
m AS MATERIALIZED (SELECT vslot, max(shard) FILTER (n = 40)::INT AS shard, max(shard) FILTER (n = 41)::INT AS grown_shard FROM owner GROUP BY vslot),
byte AS (SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC}::UBIGINT) ELSE c >> 1 END, range::UBIGINT) ORDER BY range) AS t FROM range(256)),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::UBIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, byte),
x0 AS (SELECT *, {times("doc_id::UBIGINT", XX[1])} AS k FROM d),
x1 AS (SELECT *, xor({42 + XX[4] + 8}::UBIGINT, {times(turned("k", 31), XX[0])}) AS k1 FROM x0),
x2 AS (SELECT *, {plus(times(turned("k1", 27), XX[0]), XX[3])} AS k2 FROM x1),
x3 AS (SELECT *, {times("xor(k2, k2 >> 33)", XX[1])} AS k3 FROM x2),
x4 AS (SELECT *, {times("xor(k3, k3 >> 29)", XX[2])} AS k4 FROM x3),
x5 AS (SELECT doc_id, size, text_crc32, (xor(k4, k4 >> 32) & 4095)::INT AS virtual_slot FROM x4)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id) - 1 AS slot, grown_shard, virtual_slot
FROM x5 JOIN m ON vslot = virtual_slot"""


def word_buckets(table: str, key: str) -> str:
    """The words of a table's texts with their numbers in a text."""
    return f"""SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}) GROUP BY ALL"""


OP11 = f"""WITH byte AS (SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC}::UBIGINT) ELSE c >> 1 END, range::UBIGINT) ORDER BY range) AS t FROM range(256)),
d AS MATERIALIZED ({word_buckets("documents", "doc_id")}),
b AS MATERIALIZED ({word_buckets("benchmark", "item_id")}),
crc AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda p: ('0x' || p)::UBIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT % 10000 AS bucket
  FROM (SELECT w FROM d UNION SELECT w FROM b), byte),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM d JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM b JOIN crc USING (w) GROUP BY bucket),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
z AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)"""


def nearest(books: str) -> str:
    """Every part of a vector with its nearest entry, ties to the lower index."""
    d = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT rid, part, m.entry AS entry, m.d AS error FROM (SELECT rid, part, min({{'d': {d}, 'entry': entry}}) AS m FROM p JOIN {books} b USING (part) GROUP BY ALL)"


def updated(books: str, found: str) -> str:
    """The books with used entries replaced by floored means."""
    return f"""SELECT part, entry, coalesce(y, x) AS x FROM {books} LEFT JOIN (
  SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY place) AS y FROM (
    SELECT part, entry, place, sum(v)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT a.part, a.entry, unnest(range(len(p.x))) AS place, unnest(p.x) AS v FROM {found} a JOIN p USING (rid, part)) GROUP BY ALL) GROUP BY ALL) USING (part, entry)"""


OP13_ROUNDS = ",\n".join(f"a{k} AS MATERIALIZED ({nearest(f'b{k}')}),\nb{k + 1} AS MATERIALIZED ({updated(f'b{k}', f'a{k}')})" for k in range(4))
OP13 = f"""WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rid
  FROM embeddings WHERE len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM v CROSS JOIN (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 256),
{OP13_ROUNDS},
a4 AS MATERIALIZED ({nearest("b4")}),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM v JOIN c USING (rid)"""

SQL: dict[str, str] = {"op1_chat": OP1, "op3_near_duplicates": OP3, "op4_repeats": OP4, "op6_shards": OP6, "op7_quality": OP7, "op8_substrings": OP8, "op10_mixing": OP10, "op11_resampling": OP11, "op13_vector_codes": OP13}
