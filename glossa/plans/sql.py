"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from glossa.functions.comments import CLITICS_AFTER_SPACE, CLITICS_ANYWHERE, CLITICS_BEFORE_SPACE
from glossa.functions.text import FRENCH_CONTRACTIONS, NOT_APOSTROPHE, PUNCT_CLASS, SPLIT_OFF, URL
from glossa.operators.features import FIRST_PERSON, FUTURE, SECOND_PERSON, SLANG, THIRD_PERSON


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def toks(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def normal(c: str) -> str:
    return f"regexp_replace(lower({c}), {q(SPLIT_OFF)}, ' \\1 ', 'g')"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BORDER = r"(^|[^\p{L}\p{N}_])(" + "|".join(FRENCH_CONTRACTIONS) + ")"


def split_french(c: str) -> str:
    """Twice, as the border takes a character away from a contraction that follows at once."""
    for _ in range(2):
        c = f"regexp_replace({c}, {q('(?i)' + BORDER)}, '\\1 \\2 ', 'g')"
    return c


LINES = f"""docs_lines AS (
  SELECT doc_id, coalesce(lang, '') AS lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
lines AS (
  SELECT doc_id, lang, line_no,
    {toks("'SENTSTART ' || CASE WHEN lang = 'fr' THEN " + normal(split_french(STRIP.format("line"))) + " ELSE " + normal(STRIP.format("line")) + " END || ' SENTEND'")} AS toks
  FROM docs_lines)"""

TRANSCRIPT = toks(r"regexp_replace(lower(text), '[!-/:-@\\^_`{-~]', ' ', 'g')")
TURNS = f"""turns AS (
  SELECT conv_id, turn, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
  FROM (SELECT conv_id, turn, {TRANSCRIPT} AS a FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
PAIRS = f"""{TURNS}, bitext AS (
  SELECT conv_id || ':' || turn AS pid, turn, a AS e_toks, b AS f_toks FROM turns WHERE b IS NOT NULL AND turn % 2 = 0%LIMIT%)"""
BITEXT = f"""{PAIRS},
es AS (SELECT pid, e, count(*) AS ce FROM (SELECT pid, unnest(e_toks) AS e FROM bitext) GROUP BY ALL),
fs AS (SELECT DISTINCT pid, f FROM (SELECT pid, unnest(f_toks) AS f FROM bitext)),
cooc AS (SELECT pid, e, f, ce FROM es JOIN fs USING (pid)),
m0 AS (SELECT e, f, 1.0::DOUBLE / count(*) OVER (PARTITION BY e) AS p FROM (SELECT DISTINCT e, f FROM cooc))"""


WHOLE_BITEXT = BITEXT.replace("%LIMIT%", "")


def em(i: int) -> str:
    return f"""j{i} AS (SELECT pid, e, f, p * ce / sum(p) OVER (PARTITION BY pid, f) AS c FROM cooc JOIN m{i - 1} USING (e, f)),
c{i} AS (SELECT e, f, sum(c) AS c FROM j{i} GROUP BY ALL),
m{i} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS p FROM c{i})"""


def em_steps(n: int, limit: str = "") -> str:
    return ", ".join([BITEXT.replace("%LIMIT%", limit), *(em(i) for i in range(1, n + 1))])


def em_query(n: int) -> str:
    return f"WITH {em_steps(n)} SELECT e, count(*) AS n_f, round(max(p) + 1e-9, 6) AS top_p, round(sum(p * p) + 1e-9, 6) AS sum_p2 FROM m{n} GROUP BY e"


def em_of_first(size: int, n: int) -> str:
    return f"SELECT * FROM (WITH {em_steps(n, f' ORDER BY conv_id, turn LIMIT {size}')} SELECT {size} AS size, e, count(*) AS n_f, round(max(p) + 1e-9, 6) AS top_p, round(sum(p * p) + 1e-9, 6) AS sum_p2 FROM m{n} GROUP BY e UNION ALL SELECT {size}, unnest(['SENTSTART', 'SENTEND']), 1, 1.0, 1.0)"


def grams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: {t}[i:i + {n - 1}])"


def precision(n: int) -> str:
    return f"CASE WHEN len(a) >= {n} THEN len(list_filter({grams('a', n)}, lambda g: list_contains({grams('b', n)}, g) OR list_contains({grams('c', n)}, g)))::DOUBLE / len({grams('a', n)}) END"


BREVITY = """CASE WHEN len(a) = 0 THEN NULL ELSE CASE WHEN q < 1 THEN 1.0 ELSE exp(1 - q) END END"""
BLEU_ROWS = f"""{TURNS}, x AS (
  SELECT conv_id, turn, a, {precision(1)} AS p1, {precision(2)} AS p2, {precision(3)} AS p3,
    (CASE WHEN abs(len(b) - len(a)) <= abs(len(c) - len(a)) THEN len(b) ELSE len(c) END)::DOUBLE / nullif(len(a), 0) AS q
  FROM turns WHERE b IS NOT NULL AND c IS NOT NULL)"""


def bleu(n: int) -> str:
    ps = [f"p{k}" for k in range(1, n + 1)]
    null = " OR ".join(f"{p} IS NULL" for p in ps)
    zero = " OR ".join(f"{p} = 0" for p in ps)
    logs = " + ".join(f"CASE WHEN {p} > 0 THEN ln({p}) END" for p in ps)
    return f"round(CASE WHEN {null} THEN NULL WHEN {zero} THEN 0.0 ELSE ({BREVITY}) * exp(({logs}) / {n}) END, 6) AS bleu{n}"


SCORED = f"""WITH {LINES},
train AS (SELECT lang, toks FROM lines WHERE doc_id % 5 <> 0),
uni AS (SELECT lang, w AS w1, count(*) AS c1 FROM (SELECT lang, unnest(toks) AS w FROM train) GROUP BY ALL),
bi AS (SELECT lang, b[1] AS w1, b[2] AS w2, count(*) AS c12 FROM (SELECT lang, unnest({grams('toks', 2)}) AS b FROM train) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM uni GROUP BY lang),
test AS (SELECT lang, doc_id, line_no, len(toks) AS n_tokens, unnest({grams('toks', 2)}) AS b FROM lines WHERE doc_id % 5 = 0),
hits AS (
  SELECT t.lang, doc_id, line_no, n_tokens, coalesce(c12, 0) AS c12, coalesce(c1, 0) AS c1, v
  FROM test t LEFT JOIN bi ON t.lang = bi.lang AND b[1] = bi.w1 AND b[2] = bi.w2 LEFT JOIN uni ON t.lang = uni.lang AND b[1] = uni.w1 JOIN v ON t.lang = v.lang),
scores AS (
  SELECT lang, doc_id, line_no, delta, n_tokens, bool_or(c12 + delta = 0) AS bad,
    sum(CASE WHEN c12 + delta > 0 THEN log2(c12 + delta) - log2(c1 + delta * v) END) AS logprob
  FROM hits CROSS JOIN (SELECT unnest([%DELTAS%]::DOUBLE[]) AS delta) GROUP BY ALL)"""

TAG = "CASE WHEN ends_with(w, ',') THEN ',' WHEN ends_with(w, '.') THEN '.' WHEN ends_with(w, 'ed') THEN 'VBD' WHEN ends_with(w, 'ly') THEN 'RB' WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' ELSE 'NN' END"


def count_if(cond: str) -> str:
    return f"count_if({cond})::DOUBLE"


FEATURES = f"""WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_sents, unnest(string_split(text, chr(10))) AS s FROM documents),
t AS (SELECT doc_id, n_sents, unnest(string_split({STRIP.format("s")}, ' ')) AS w FROM s),
g AS (SELECT *, {TAG} AS tag FROM t)
SELECT doc_id,
  {count_if(f"lower(w) IN {words(FIRST_PERSON)}")} AS f01_first_person,
  {count_if(f"lower(w) IN {words(SECOND_PERSON)}")} AS f02_second_person,
  {count_if(f"lower(w) IN {words(THIRD_PERSON)}")} AS f03_third_person,
  0.0::DOUBLE AS f04_conjunctions,
  {count_if("tag = 'VBD'")} AS f05_past_verbs,
  {count_if(f"lower(w) IN {words(FUTURE)}")} AS f06_future_verbs,
  {count_if("tag = ','")} AS f07_commas,
  {count_if(f"regexp_full_match(w, '[{PUNCT_CLASS}]{{2,}}')")} AS f08_multi_punctuation,
  {count_if("tag = 'NN'")} AS f09_common_nouns,
  {count_if("tag = 'NNP'")} AS f10_proper_nouns,
  {count_if("tag = 'RB'")} AS f11_adverbs,
  0.0::DOUBLE AS f12_wh_words,
  {count_if(f"lower(w) IN {words(SLANG)}")} AS f13_slang,
  {count_if(r"length(w) >= 3 AND regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')")} AS f14_upper_case,
  round(sum(length(w))::DOUBLE / any_value(n_sents), 6) AS f15_sentence_chars,
  round(coalesce(avg(length(w)) FILTER (regexp_matches(w, '[^{PUNCT_CLASS}]')), 0.0), 6) AS f16_token_chars,
  any_value(n_sents)::DOUBLE AS f17_sentences
FROM g GROUP BY doc_id"""

LEXICON = """lex AS (
  SELECT word, 100.0 + 10 * length(word) AS aoa, ascii(word)::DOUBLE AS img, CASE WHEN length(word) % 2 = 1 THEN length(word)::DOUBLE END AS fam
  FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark))"""

FRAMES = """f AS (SELECT vec_id AS id, label::VARCHAR AS speaker, (vec_id % {parts})::INT AS m, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
model AS (SELECT speaker, m, dim, count(*) AS n, avg(x) AS mu, var_pop(x) + 0.01 AS var FROM f GROUP BY ALL),
weights AS (SELECT speaker, m, any_value(n)::DOUBLE / sum(any_value(n)) OVER (PARTITION BY speaker) AS w FROM model GROUP BY speaker, m)"""
DENSITY = "-0.5 * (sum((f.x - mu) * (f.x - mu) / var + ln(var)) + count(*) * ln(2 * pi()))"
RESP = f"""WITH {FRAMES.format(parts=2)},
b AS (SELECT f.id, f.speaker, k.m, {DENSITY} AS logb FROM f JOIN model k ON f.speaker = k.speaker AND f.dim = k.dim GROUP BY ALL),
j AS (SELECT b.*, ln(w) + logb AS joint FROM b JOIN weights USING (speaker, m)),
t AS (SELECT *, max(joint) OVER p + ln(sum(exp(joint - top)) OVER p) AS loglik FROM (SELECT *, max(joint) OVER (PARTITION BY id) AS top FROM j) WINDOW p AS (PARTITION BY id)),
r AS (SELECT *, exp(joint - loglik) AS p FROM t)"""

HASH = "('0x' || substr(md5('401|' || doc_id), 1, 8))::BIGINT"

COST, LOW = 1 << 42, (1 << 21) - 1
#: The edit table by diagonals: a cell holds cost, substitutions and insertions in one number; place i + 1 of a diagonal is row i.
def word_errors(keys: str, pairs: str) -> str:
    """CTEs up to we: (keys, s, i, d, n_ref, wer) of the rows (keys, a, b) that ``pairs`` selects."""
    return f"""WITH RECURSIVE {TURNS},
pr AS (SELECT {keys}, list_transform(a, lambda x: hash(x)) AS r, list_transform(b, lambda x: hash(x)) AS h FROM ({pairs})),
d AS (
  SELECT {keys}, r, h, 0 AS k, []::BIGINT[] AS older, [0::BIGINT] || list_transform(r, lambda x: NULL::BIGINT) AS cells FROM pr
  UNION ALL
  SELECT {keys}, r, h, k + 1, cells, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN k + 1 - i BETWEEN 0 AND len(h) THEN
    CASE WHEN i > 0 AND coalesce(cells[i] // {COST} <= least(cells[i + 1] // {COST}, older[i] // {COST} + (r[i] <> h[k + 1 - i])::INT - 1), true) THEN cells[i] + {COST}
    WHEN i = 0 OR coalesce(cells[i + 1] // {COST} + 1 <= older[i] // {COST} + (r[i] <> h[k + 1 - i])::INT, false) THEN cells[i + 1] + {COST + 1}
    ELSE older[i] + (r[i] <> h[k + 1 - i])::INT * {COST + LOW + 1} END END)
  FROM d WHERE k < len(r) + len(h)),
e AS (SELECT {keys}, cells[len(r) + 1] AS c, len(r) AS n_ref FROM d WHERE k = len(r) + len(h)),
we AS (
  SELECT {keys}, (c // {LOW + 1}) & {LOW} AS s, c & {LOW} AS i, c // {COST} - ((c // {LOW + 1}) & {LOW}) - (c & {LOW}) AS d, n_ref,
    CASE WHEN n_ref = 0 THEN 'inf'::DOUBLE ELSE (c // {COST}) / n_ref::DOUBLE END AS wer FROM e)"""


WORD_ERRORS = word_errors("conv_id, turn", "SELECT conv_id, turn, a, b FROM turns WHERE b IS NOT NULL")
SYSTEM_ERRORS = word_errors("speaker, line_no, system", "SELECT conv_id AS speaker, turn AS line_no, unnest(['next', 'after']) AS system, a, unnest([b, c]) AS b FROM turns WHERE c IS NOT NULL")
ANOVA = "f AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings)"

CLITICS = "(?i)" + "|".join([f"({'|'.join(CLITICS_BEFORE_SPACE)})" + r"\s+", r"\s+" + f"({'|'.join(CLITICS_AFTER_SPACE)})", f"({'|'.join(CLITICS_ANYWHERE)})" + r"\s*"])

ANOVA_P = """v AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM v GROUP BY ALL),
s AS (SELECT feature, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2, ((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM c GROUP BY feature),
w AS (SELECT *, d2 / (d2 + d1 * f) AS x, d1 * f / (d2 + d1 * f) AS y, d2 / (d2 + d1 * f) <= (d2 / 2 + 1) / (d2 / 2 + d1 / 2 + 2) AS low FROM s),
t AS MATERIALIZED (SELECT feature, f, low, CASE WHEN low THEN d2 ELSE d1 END / 2 AS a, CASE WHEN low THEN d1 ELSE d2 END / 2 AS b, CASE WHEN low THEN x ELSE y END AS x, CASE WHEN low THEN y ELSE x END AS y FROM w),
r AS (
  SELECT feature, a, b, x, 1 AS k, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS g FROM t
  UNION ALL
  SELECT feature, a, b, x, k + 1, 1 + top / c, 1 / (1 + top * d), g * (1 + top / c) / (1 + top * d)
  FROM (SELECT *, CASE WHEN k % 2 = 1 THEN m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) ELSE -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) END AS top FROM (SELECT *, ((k + 1) // 2)::DOUBLE AS m FROM r WHERE k < 1000))),
anova AS (
  SELECT feature, f, CASE WHEN low THEN i ELSE 1 - i END AS p
  FROM (SELECT feature, f, low, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(y)) * g / a AS i FROM t JOIN (SELECT feature, g FROM r WHERE k = 1000) USING (feature)))"""

INFLECTED = f"""counts AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT unnest({TRANSCRIPT}) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE regexp_full_match(word, '[a-z]{{3,}}') GROUP BY word),
forms AS (
  SELECT word || e AS word, t AS tag, word AS lemma FROM counts, (SELECT unnest(['s', 'es', 'ed', 'en', 'er', 't']) AS e, unnest(['NNS', 'NNS', 'VBD', 'VBN', 'JJR', 'VBN']) AS t) WHERE word || e NOT LIKE '%ies' OR word LIKE '%y'
  UNION ALL SELECT left(word, length(word) - 1) || 'ies', 'NNS', word FROM counts WHERE word LIKE '%y'),
inflected AS MATERIALIZED (SELECT word, tag, lemma FROM forms JOIN counts USING (word))"""

#: All endings of up to five letters, and the whole word behind a blank.
ENDINGS = "list_append(list_transform(range(0, least(5, length(word)) + 1), lambda k: right(word, k)), ' ' || word)"


def scripts(rows: str) -> str:
    """The commonest edit script of each ending, without those that say what a shorter one says."""
    same = "len(list_filter(range(1, least(length(word), length(lemma)) + 1), lambda i: left(word, i) = left(lemma, i)))"
    return f"""cuts AS (SELECT word, tag, length(word) - {same} AS cut, substr(lemma, {same} + 1) AS add FROM {rows}),
seen AS (SELECT t AS tag, ending, cut, add, count(*) AS n FROM (SELECT *, unnest({ENDINGS}) AS ending FROM (SELECT *, unnest([tag, '*']) AS t FROM cuts)) WHERE length(ending) >= cut GROUP BY ALL),
top AS MATERIALIZED (SELECT tag, ending, cut, add, n FROM seen QUALIFY row_number() OVER (PARTITION BY tag, ending ORDER BY n DESC, cut, add) = 1),
learned AS MATERIALIZED (
  SELECT a.* FROM top a LEFT JOIN top b ON a.tag = b.tag AND a.ending <> '' AND b.ending = CASE WHEN a.ending LIKE ' %' THEN right(a.ending, least(5, length(a.ending) - 1)) ELSE substr(a.ending, 2) END
  WHERE b.tag IS NULL OR (a.cut, a.add) <> (b.cut, b.add))"""


SQL: dict[str, str] = {
    "text_newline_strip": f"SELECT doc_id, md5({STRIP.format('replace(text, chr(10), chr(32))')}) AS body_md5 FROM documents",
    "text_url_strip": f"SELECT page_id, md5(regexp_replace(html, {q(URL)}, ' ', 'g')) AS body_md5 FROM pages",
    "text_clitic_split": f"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, {q('(?i)(s)' + chr(39) + '[' + chr(92) + 's]*')}, '\\1 ' || chr(1), 'g'), {q(CLITICS)}, ' \\1\\2\\3 ', 'g'), chr(1), chr(39))) AS body_md5 FROM documents",
    "text_punct_split": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^{PUNCT_CLASS}])([{NOT_APOSTROPHE}])', '\\1 \\2', 'g'), '([{NOT_APOSTROPHE}])([^{PUNCT_CLASS}])', '\\1 \\2', 'g')) AS body_md5 FROM documents",
    "sent_normalise": f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, array_to_string(toks, ' ') AS sentence FROM lines",
    "transcript_normalise": f"SELECT conv_id, turn, array_to_string({TRANSCRIPT}, ' ') AS words FROM conversations",
    "ngram_uni_counts": f"WITH {LINES} SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(toks) AS w FROM lines) GROUP BY ALL",
    "ngram_bi_counts": f"WITH {LINES} SELECT lang, b[1] AS w1, b[2] AS w2, count(*) AS n FROM (SELECT lang, unnest({grams('toks', 2)}) AS b FROM lines) GROUP BY ALL",
    "lm_sentence_logprob": SCORED.replace("%DELTAS%", "0.01") + " SELECT lang, doc_id, line_no::INT AS line_no, n_tokens, round(logprob, 6) AS logprob FROM scores",
    "lm_perplexity_sweep": SCORED.replace("%DELTAS%", "0, 0.0001, 0.001, 0.01, 0.1, 1")
    + " SELECT lang, delta, count_if(NOT bad)::BIGINT AS sentences, coalesce(sum(n_tokens) FILTER (NOT bad), 0)::BIGINT AS tokens, round(CASE WHEN count_if(NOT bad) = 0 THEN 0.0 ELSE pow(2, -sum(logprob) FILTER (NOT bad) / sum(n_tokens) FILTER (NOT bad)) END, 4) AS perplexity FROM scores GROUP BY lang, delta",
    "cooc_pairs": f"WITH {WHOLE_BITEXT} SELECT pid, count(*) AS n, sum(ce)::BIGINT AS ce FROM cooc GROUP BY pid",
    "ibm1_init": f"WITH {WHOLE_BITEXT} SELECT e, count(*) AS n_f, round(max(p), 6) AS p FROM m0 GROUP BY e",
    "ibm1_em_step": em_query(1),
    "ibm1_em2": em_query(2),
    "ibm1_train": f"WITH {em_steps(50)} SELECT e, count(*) AS n_f, round(max(p), 6) AS top_p FROM m50 GROUP BY e UNION ALL SELECT unnest(['SENTSTART', 'SENTEND']), 1, 1.0::DOUBLE",
    "ibm1_size_sweep": " UNION ALL ".join(em_of_first(size, 10) for size in (1_000, 10_000, 15_000, 30_000)),
    "decode_score": f"""WITH {WHOLE_BITEXT},
  t AS (SELECT f_toks FROM bitext WHERE turn % 4 = 0), u AS (SELECT w, count(*) AS c FROM (SELECT unnest(f_toks) AS w FROM t) GROUP BY w),
  g AS (SELECT b[1] AS w1, b[2] AS w2, count(*) AS c12 FROM (SELECT unnest({grams('f_toks', 2)}) AS b FROM t WHERE len(f_toks) > 1) GROUP BY ALL),
  x AS (SELECT pid AS sid, unnest(f_toks) AS w, generate_subscripts(f_toks, 1) AS at_ FROM bitext),
  y AS (SELECT *, lag(w) OVER (PARTITION BY sid ORDER BY at_) AS v FROM x)
  SELECT sid, round(coalesce(sum(CASE WHEN c IS NULL OR c12 IS NULL THEN '-inf'::DOUBLE ELSE log2(1.0 / length(y.w)) + log2(c12) + log2(c) END) FILTER (at_ > 1), 0.0), 6) AS score
  FROM y LEFT JOIN u ON u.w = y.w LEFT JOIN g ON g.w1 = y.v AND g.w2 = y.w GROUP BY sid""",
    "bleu_report": f"WITH {BLEU_ROWS}, s AS (SELECT turn % 3 AS model, {bleu(1)}, {bleu(2)}, {bleu(3)} FROM x), u AS (SELECT model, unnest([1, 2, 3]) AS n, unnest([bleu1, bleu2, bleu3]) AS b FROM s) SELECT model, n, count(b) AS lines, round(avg(b), 6) AS mean_bleu FROM u GROUP BY ALL".replace("round(CASE", "(CASE").replace("END, 6) AS bleu", "END) AS bleu"),
    "wer_by_system": f"{SYSTEM_ERRORS} SELECT speaker, line_no, system, s, i, d, n_ref, round(wer, 6) AS wer FROM we",
    "wer_system_summary": f"{SYSTEM_ERRORS} SELECT system, count(*) AS n_lines, round(avg(wer), 6) AS mean_wer, round(stddev_pop(wer), 6) AS std_wer FROM we GROUP BY ALL",
    "matrix_join": "SELECT vec_id % 97 AS id, round(arg_max(embedding[1]::DOUBLE, k), 6) AS first, round(arg_max(list_sum(embedding::DOUBLE[]), k), 6) AS total FROM (SELECT *, ([2, 1, 3, 0]::BIGINT[])[vec_id % 4 + 1] * 1000000000 + vec_id AS k FROM embeddings) GROUP BY ALL",
    "metrics_row": "WITH l AS (SELECT DISTINCT unnest([quality, toxic]) AS v FROM labels), c AS (SELECT a.v AS label, b.v AS pred, (SELECT count(*) FROM labels WHERE quality = a.v AND toxic = b.v) AS n FROM l a CROSS JOIN l b), m AS (SELECT *, sum(n) OVER (PARTITION BY label) AS r, sum(n) OVER (PARTITION BY pred) AS q FROM c) SELECT round(sum(n) FILTER (label = pred) / sum(n)::DOUBLE, 6) AS accuracy, string_agg(printf('%.4f', n / r::DOUBLE), ',' ORDER BY label) FILTER (label = pred) AS recall, string_agg(printf('%.4f', n / q::DOUBLE), ',' ORDER BY label) FILTER (label = pred) AS precision, string_agg(n, ',' ORDER BY label, pred) AS confusion FROM m",
    "accuracy_gains": "WITH s AS (SELECT unnest([3, 5, 7, 11]) AS size, unnest([(quality + doc_id % 3) % 2, (quality + doc_id % 5) % 2, (quality + doc_id % 7) % 2, (quality + doc_id % 11) % 2])::DOUBLE AS hit FROM labels), a AS (SELECT size, avg(hit) AS a FROM s GROUP BY size) SELECT size, round(a, 6) AS accuracy, round(a - lag(a) OVER (ORDER BY size), 6) AS gain FROM a",
    "decode_candidates_top5": f"WITH {WHOLE_BITEXT} SELECT f, rank, e, round(p, 6) AS p FROM (SELECT f, e, p, row_number() OVER (PARTITION BY f ORDER BY p DESC, e)::INT AS rank FROM m0) WHERE rank <= 5",
    "bleu_precision": f"WITH {BLEU_ROWS} SELECT conv_id, turn, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM x",
    "bleu_brevity": f"WITH {BLEU_ROWS} SELECT conv_id, turn, round({BREVITY}, 6) AS bp FROM x",
    "bleu_combined": f"WITH {BLEU_ROWS} SELECT conv_id, turn, {bleu(1)}, {bleu(2)}, {bleu(3)} FROM x",
    "wer_lines": f"{WORD_ERRORS} SELECT conv_id, turn, s, i, d, n_ref, round(wer, 6) AS wer FROM we",
    "wer_summary": f"{WORD_ERRORS} SELECT turn = 0 AS first_turn, count(*) AS n_lines, round(avg(wer), 6) AS mean_wer, round(stddev_pop(wer), 6) AS std_wer FROM we GROUP BY ALL",
    "feat_native": FEATURES,
    "feat_lexicon_stats": f"WITH {LEXICON}, t AS (SELECT doc_id AS id, lower(unnest({toks('text')})) AS word FROM documents) SELECT id, "
    + ", ".join(f"round(coalesce(avg({c}), 0.0), 6) AS mean_{c}, round(coalesce(stddev_pop({c}), 0.0), 6) AS std_{c}" for c in ("aoa", "img", "fam"))
    + " FROM t JOIN lex USING (word) GROUP BY id",
    "feat_lexicon_case": f"WITH {LEXICON}, t AS (SELECT doc_id AS id, unnest({toks('text')}) AS word FROM documents) SELECT id, "
    + ", ".join(f"round(coalesce(avg({c}), 0.0), 6) AS mean_{n}, round(coalesce(stddev_pop({c}), 0.0), 6) AS std_{n}" for c, n in (("aoa", "v"), ("img", "a"), ("fam", "d")))
    + " FROM t JOIN lex USING (word) GROUP BY id",
    "lexicon_last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "circular_sample": "WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, source FROM documents), p AS (SELECT i AS place, (1000000007 + i) % (SELECT count(*) FROM documents) AS idx FROM range(10000) r(i)) SELECT place::INT AS place, doc_id, source FROM p JOIN n USING (idx)",
    "confusion_matrix": "WITH l AS (SELECT DISTINCT unnest([quality, toxic]) AS v FROM labels) SELECT a.v AS label, b.v AS pred, (SELECT count(*) FROM labels WHERE quality = a.v AND toxic = b.v) AS n FROM l a CROSS JOIN l b",
    "class_metrics": "WITH l AS (SELECT DISTINCT unnest([quality, toxic]) AS v FROM labels) SELECT v AS label, round(count_if(quality = v AND toxic = v) / count_if(quality = v)::DOUBLE, 6) AS recall, round(count_if(quality = v AND toxic = v) / count_if(toxic = v)::DOUBLE, 6) AS precision, round(avg((quality = toxic)::INT), 6) AS accuracy FROM l CROSS JOIN labels GROUP BY v",
    "anova_f": "WITH f AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM f GROUP BY ALL) SELECT feature::INT AS feature, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS f FROM c GROUP BY feature",
    "class_means": "SELECT label, feature::INT AS feature, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
    "anova_p": f"WITH RECURSIVE {ANOVA_P} SELECT feature::INT AS feature, round(f, 6) AS f, round(p, 9) AS p FROM anova",
    "mean_p": f"WITH RECURSIVE {ANOVA_P} SELECT feature::INT % 2 AS half, round(avg(p), 9) AS mean_p FROM anova GROUP BY half",
    "lemma_scripts": f"WITH {INFLECTED}, {scripts('inflected')} SELECT tag, ending, cut, add, n FROM learned",
    "lemma_held_out": f"""WITH {INFLECTED}, part AS (SELECT *, ('0x' || substr(md5('401|' || word), 1, 8))::BIGINT % 5 AS fold FROM inflected),
known AS (SELECT word, tag, lemma FROM part WHERE fold <> 0), {scripts("known")},
held AS (SELECT word, tag, lemma AS want, row_number() OVER () AS i FROM part WHERE fold = 0),
tries AS (SELECT i, word, h.tag = l.tag AS own, length(ending) AS n, cut, add FROM (SELECT *, unnest({ENDINGS}) AS ending FROM held) h JOIN learned l USING (ending) WHERE l.tag IN (h.tag, '*') AND (cut < length(word) OR add <> '')),
best AS (SELECT i, max({{'own': own, 'n': n, 'cut': cut, 'add': add}}) AS b FROM tries GROUP BY i)
SELECT tag, count(*) AS words, count(*) FILTER (coalesce(left(word, length(word) - b.cut) || b.add, word) = want) AS right_ FROM held LEFT JOIN best USING (i) GROUP BY tag""",
    "paired_t": "SELECT l_returnflag, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS t, (count(*) - 1)::DOUBLE AS df FROM lineitem GROUP BY l_returnflag",
    "train_test_split": f"SELECT doc_id, {HASH} < {int(0.2 * 2**32)} AS test FROM documents",
    "kfold_assign": f"SELECT doc_id, ({HASH} % 5)::INT AS fold FROM documents",
    "learning_curve_sample": "SELECT c_custkey FROM customer ORDER BY md5('401|' || c_custkey) LIMIT 1000",
    "gmm_responsibility": RESP + " SELECT id, m, round(logb, 4) AS logb, round(p, 4) AS p, round(loglik, 4) AS loglik FROM r",
    "gmm_m_step": RESP
    + " SELECT speaker, r.m, round(avg(p), 5) AS w, dim::INT AS dim, round(sum(p * x) / sum(p), 5) AS mu, round(greatest(sum(p * x * x) / sum(p) - (sum(p * x) / sum(p)) * (sum(p * x) / sum(p)), 1e-6), 5) AS var FROM r JOIN (SELECT id, dim, x FROM f) g USING (id) GROUP BY speaker, r.m, dim",
    "gmm_identify": f"WITH {FRAMES.format(parts=1)}, b AS (SELECT f.speaker AS truth, f.id AS utt, k.speaker, {DENSITY} AS ll FROM f JOIN model k ON f.dim = k.dim GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY truth, utt ORDER BY ll DESC, speaker)::INT AS rank FROM b) SELECT truth, utt, speaker, round(ll, 4) AS loglik, rank, truth = speaker AS correct FROM r WHERE rank <= 3",
    "gmm_open_set": f"WITH {FRAMES.format(parts=1)}, sp AS (SELECT speaker, row_number() OVER (ORDER BY speaker) <= 5 AS known FROM (SELECT DISTINCT speaker FROM f)), b AS (SELECT f.speaker AS truth, f.id AS utt, k.speaker, {DENSITY} AS ll FROM f JOIN model k ON f.dim = k.dim GROUP BY ALL), s AS (SELECT truth, utt, speaker, CASE WHEN known THEN ll END AS ll FROM b JOIN sp USING (speaker)), r AS (SELECT *, row_number() OVER (PARTITION BY truth, utt ORDER BY ll DESC NULLS LAST, speaker)::INT AS rank FROM s) SELECT truth, utt, speaker, round(ll, 4) AS loglik, rank, truth = speaker AS correct FROM r WHERE rank <= 6",
    "gmm_hold_out": "SELECT label::VARCHAR AS speaker, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5('401|' || vec_id)) = 1 AS test FROM embeddings",
}
