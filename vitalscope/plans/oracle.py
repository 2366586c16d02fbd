r"""Plain SQL for the catalog queries, to check them on another engine.

The SQL states what a query means in the most direct way, with full grids and
all pairs; it is not how the library computes it.
"""

from __future__ import annotations

from ..lexicon import (
    ENGLISH_HELPERS, ENGLISH_TERMS, HISTOGRAM_STOPWORDS, PRIORITY_TERMS,
    ROMAN_STOPWORDS, TERM_WEIGHTS,
)
from ..operators.features import SUBSTRING_KEY
from ..schemas import LEVEL_LABELS
from .catalog import LEXICON, PROTECTED, SEED, WATCH

SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = "regexp_extract_all(lower(text), '[a-z]+')"


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def values(name: str, columns: str, rows) -> str:
    cells = ", ".join(
        "(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows
    )
    return f"{name}({columns}) AS (VALUES {cells})"


def tokens_of(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{SPACES}]+'), lambda w: w <> '')"


CLEAN = f"regexp_replace(lower(text), '[^a-z{SPACES}]', ' ', 'g')"

# ---- stop words ------------------------------------------------------------------
LABELS = "lab AS (SELECT doc_id, CAST(quality * 2 + toxic AS INTEGER) AS label FROM labels)"
FREQ = f"""
tok AS (SELECT doc_id, unnest(list_distinct({LETTERS})) AS token FROM documents),
freq AS (SELECT token, count(*) AS document_count FROM tok GROUP BY token)"""


def stats_ctes(tag: str = "", where: str = "TRUE") -> str:
    """Statistics by the textbook: a present/absent by class table per token."""
    protected = listed(PROTECTED)
    t = tag
    return f"""
ldoc{t} AS (SELECT d.doc_id, l.label, {LETTERS} AS tokens FROM documents d JOIN lab l USING (doc_id) WHERE {where}),
ltok{t} AS (SELECT doc_id, label, unnest(list_distinct(tokens)) AS token FROM ldoc{t}),
size{t} AS (SELECT count(*)::DOUBLE AS n FROM ldoc{t}),
cls{t} AS (SELECT label, count(*)::DOUBLE AS c FROM ldoc{t} GROUP BY label),
dc{t} AS (SELECT token, count(*) AS document_count FROM ltok{t} GROUP BY token),
cut{t} AS (SELECT greatest(quantile_cont(document_count::DOUBLE, 0.75), 0.02::DOUBLE * (SELECT n FROM size{t})) AS c FROM dc{t}),
com{t} AS (SELECT token, document_count, document_count::DOUBLE AS d FROM dc{t} WHERE document_count >= (SELECT c FROM cut{t}) - 1e-9),
pres{t} AS (SELECT token, label, count(*)::DOUBLE AS p FROM ltok{t} GROUP BY token, label),
cell{t} AS (
  SELECT m.token, m.document_count, m.d, k.label, k.c, coalesce(p.p, 0) AS present, k.c - coalesce(p.p, 0) AS absent
  FROM com{t} m CROSS JOIN cls{t} k LEFT JOIN pres{t} p ON p.token = m.token AND p.label = k.label),
sums{t} AS (
  SELECT token, document_count, any_value(d) AS d, s.n,
    sum(CASE WHEN d * c > 0 THEN (present - d * c / s.n) ** 2 / (d * c / s.n) ELSE 0 END
      + CASE WHEN (s.n - d) * c > 0 THEN (absent - (s.n - d) * c / s.n) ** 2 / ((s.n - d) * c / s.n) ELSE 0 END) AS chi2,
    sum(CASE WHEN present > 0 THEN present / s.n * log2(present * s.n / (d * c)) ELSE 0 END
      + CASE WHEN absent > 0 THEN absent / s.n * log2(absent * s.n / ((s.n - d) * c)) ELSE 0 END) AS mi,
    -sum(c / s.n * log2(c / s.n)) AS h, count(*) AS k
  FROM cell{t} CROSS JOIN size{t} s GROUP BY token, document_count, s.n),
meas{t} AS (
  SELECT token, document_count, d / n AS df, chi2, CAST(k - 1 AS INTEGER) AS dof,
    CASE WHEN h > 0 THEN greatest(mi, 0) / h ELSE 0 END AS nmi,
    CASE WHEN k > 1 THEN sqrt(chi2 / n) ELSE 0 END AS v FROM sums{t}),
stat{t} AS (
  SELECT *, TRUE AS is_high_frequency, nmi <= 0.01 AND v <= 0.12 AS is_uninformative,
    token IN {protected} AS is_protected,
    nmi <= 0.01 AND v <= 0.12 AND token NOT IN {protected} AS is_stopword FROM meas{t})"""


STATS = f"WITH {LABELS}, {stats_ctes()}"
# The lower tail as a sum of positive terms, each from the log-gamma function.
P_VALUE = """round(CASE WHEN dof <= 0 OR chi2 <= 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 3000),
  lambda i: exp((dof / 2.0 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + i + 1))))) END::DOUBLE, 6)"""
REASON = """CASE WHEN is_stopword THEN 'removed' WHEN is_protected AND is_uninformative THEN 'guarded'
 ELSE 'informative: ' || concat_ws(' ', CASE WHEN round(nmi, 6) > 0.01 THEN 'nmi=' || printf('%.5f', nmi) END,
   CASE WHEN round(v, 6) > 0.12 THEN 'v=' || printf('%.3f', v) END) END"""

# ---- splits --------------------------------------------------------------------------


def ranked(source: str, key: str, label: str) -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({key} || '-{SEED}'), {key}) AS r, "
        f"count(*) OVER (PARTITION BY {label}) AS class_n FROM {source}"
    )


# ---- text stages -------------------------------------------------------------------------
def _ruled_text() -> str:
    expr = CLEAN
    for old, new in LEXICON.rules:
        expr = f"replace({expr}, {quoted(old)}, {quoted(new)})"
    return expr


def _case(word: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in mapping.items())
    return f"CASE {word} {arms} ELSE {word} END"


RULED = f"list_transform({tokens_of(_ruled_text())}, lambda w: {_case('w', LEXICON.fillers)})"


STUTTER = f"""
src AS (SELECT doc_id, ws, list_transform(ws, lambda w: {_case('w', LEXICON.variants)}) AS cs FROM {{source}}),
can AS (SELECT doc_id, list_transform(list_filter(range(1, len(ws) + 1),
   lambda i: i = 1 OR NOT (cs[i] = cs[i - 1] AND ws[i] <> ws[i - 1])), lambda i: cs[i]) AS t FROM src)"""

_untouched = sorted(LEXICON.untouched_by_repair())
# Length of the common subsequence row by row; a row is the running maximum of
# "skip this letter" and "use this letter".
FUZZY = f"""
ruled AS (SELECT doc_id, {RULED} AS ws FROM documents),
word AS (SELECT DISTINCT token FROM (SELECT unnest(ws) AS token FROM ruled)
   WHERE length(token) >= 3 AND token NOT IN {listed(_untouched)}),
{values("term", "ord, term", list(enumerate(LEXICON.fuzzy_terms)))},
wordl AS (SELECT token, length(token) AS m, list_transform(range(97, 123), lambda c: length(token) - length(replace(token, chr(c::INTEGER), ''))) AS a FROM word),
terml AS (SELECT ord, term, length(term) AS n, list_transform(range(97, 123), lambda c: length(term) - length(replace(term, chr(c::INTEGER), ''))) AS b FROM term),
cand AS (SELECT token, term, ord, m, n FROM wordl JOIN terml ON 5 * least(m, n) >= 2 * (m + n)
   WHERE 5 * list_sum(list_transform(range(1, 27), lambda i: least(a[i], b[i]))) >= 2 * (m + n)),
RECURSIVE_lcs AS (
  SELECT token, term, ord, m, n, 0 AS i, list_transform(range(0, n + 1), lambda j: 0::BIGINT) AS row FROM cand
  UNION ALL
  SELECT token, term, ord, m, n, i + 1,
    list_transform(range(1, n + 2), lambda j: list_max(list_transform(range(1, j + 1),
      lambda k: CASE WHEN k > 1 AND token[i + 1] = term[k - 1] THEN greatest(row[k], row[k - 1] + 1) ELSE row[k] END)))
  FROM RECURSIVE_lcs WHERE i < m),
score AS (SELECT token, term, ord, 200.0::DOUBLE * row[n + 1] / (m + n) AS score FROM RECURSIVE_lcs WHERE i = m AND 5 * row[n + 1] >= 2 * (m + n)),
best AS (SELECT token, term, score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, ord) AS r FROM score) WHERE r = 1)
""".replace("RECURSIVE_lcs", "lcs")

# ---- vectors ---------------------------------------------------------------------------------
VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SMOOTH = "SELECT vec_id, label, list_transform(range(1, len(v) + 1), lambda i: v[i] + v[i % len(v) + 1]) AS v FROM vec"
COS = "list_cosine_similarity(a.v, b.v)"
CLIP = f"greatest(0, least(1, {COS}))"


def pearson(a: str, b: str) -> str:
    ca = f"list_transform({a}, lambda x: x - list_avg({a}))"
    cb = f"list_transform({b}, lambda x: x - list_avg({b}))"
    return f"list_cosine_similarity({ca}, {cb})"


WITHIN = f"""
pair AS (SELECT a.label AS cluster, a.vec_id AS id_a, b.vec_id AS id_b, {CLIP} AS s, {COS} AS raw,
  list_cosine_similarity(a.z, b.z) AS r, list_distance(a.v, b.v) AS e
  FROM cen a JOIN cen b ON a.label = b.label AND a.vec_id < b.vec_id)"""
CEN = "cen AS (SELECT vec_id, label, v, list_transform(v, lambda x: x - list_avg(v)) AS z FROM vec)"


def arm(tag: str, source: str, threshold: float = 0.3) -> str:
    return f"""
in{tag} AS (SELECT a.label AS cluster, avg(s) AS within, 100.0 * avg(CASE WHEN s > {threshold} THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) AS n_pairs
  FROM (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM {source} a JOIN {source} b ON a.label = b.label AND a.vec_id < b.vec_id) a GROUP BY 1),
out{tag} AS (SELECT label AS cluster, avg(s) AS across FROM (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM {source} a JOIN {source} b ON a.label <> b.label) GROUP BY 1),
arm{tag} AS (SELECT cluster, within, across, within - across AS gap, pass_rate, n_pairs FROM in{tag} JOIN out{tag} USING (cluster))"""


def nearest(name: str, left: str, right: str, other: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.vec_id, a.label, b.vec_id AS nb, b.label AS nb_label, round({COS}, 10) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 10) DESC, b.vec_id) AS r
  FROM {left} a JOIN {right} b ON {other}) WHERE r = 1)"""


OPEN = f"""{VEC}, mine AS (SELECT * FROM vec WHERE label < 7), pool AS (SELECT * FROM vec WHERE label >= 7),
{nearest('closed', 'mine', 'mine', 'a.vec_id <> b.vec_id')}, {nearest('outer_nn', 'mine', 'pool', 'TRUE')},
won AS (SELECT c.vec_id, c.label AS true_cluster, c.nb AS neighbour, c.nb_label AS neighbour_cluster, c.s AS similarity,
  c.label = c.nb_label AS same_meaning,
  CASE WHEN o.s IS NULL OR c.s >= o.s THEN c.nb ELSE o.nb END AS open_pool_neighbour,
  (o.s IS NULL OR c.s >= o.s) AND c.label = c.nb_label AS open_pool_same_meaning
  FROM closed c LEFT JOIN outer_nn o USING (vec_id))"""
TOPK = f"""{VEC}, top AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round({COS}, 10) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 10) DESC, b.vec_id) AS rank
  FROM vec a JOIN vec b ON a.label >= 7 AND b.label < 7) WHERE rank <= 5)"""
NEXT = f"""{VEC}, smooth AS ({SMOOTH}),
checked AS (SELECT a.vec_id AS pair_id, {COS} AS raw, list_cosine_similarity(c.v, d.v) AS normalized
  FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 JOIN smooth c ON c.vec_id = a.vec_id JOIN smooth d ON d.vec_id = b.vec_id),
chk AS (SELECT *, normalized - raw AS lift, normalized - 0.1::DOUBLE AS drift, normalized > 0.3 AS passes_threshold,
  abs(normalized - 0.1::DOUBLE) <= 0.1 AS matches_documented FROM checked)"""

# ---- evaluation ------------------------------------------------------------------------------------
PRED = """pred AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label,
  CAST(least(4, floor(o_totalprice / 100000)) AS INTEGER) AS prediction FROM orders)"""
CELLS = f"{PRED}, cell AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL)"


def grades(under: str, over: str) -> str:
    return f"""CASE WHEN {under} < 5 THEN 'A+' WHEN {under} < 10 THEN 'A' WHEN {under} < 15 THEN 'B' WHEN {under} < 20 THEN 'C' ELSE 'F' END AS safety_grade,
 CASE WHEN {over} < 15 THEN 'A' WHEN {over} < 25 THEN 'B' WHEN {over} < 35 THEN 'C' ELSE 'D' END AS efficiency_grade"""


REPORT = f"""{CELLS}, k AS (SELECT DISTINCT label AS class FROM cell UNION SELECT DISTINCT prediction FROM cell),
base AS (SELECT class, coalesce((SELECT sum(n) FROM cell WHERE label = class), 0) AS support,
  coalesce((SELECT sum(n) FROM cell WHERE prediction = class), 0) AS predicted,
  coalesce((SELECT sum(n) FROM cell WHERE label = class AND prediction = class), 0) AS tp FROM k),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS r FROM base),
rep AS (SELECT class, p AS "precision", r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CAST(support AS BIGINT) AS support FROM pr)"""
METHODS = f"""ways AS (
  SELECT 0 AS ord, 'price' AS method, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label, CAST(least(4, floor(o_totalprice / 100000)) AS INTEGER) AS prediction FROM orders
  UNION ALL SELECT 1, 'customer', CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, CAST(o_custkey % 5 AS INTEGER) FROM orders
  UNION ALL SELECT 2, 'status', CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END FROM orders),
raw AS (SELECT ord, method, count(*) AS n_rows, 100.0::DOUBLE * count_if(prediction = label) / count(*) AS a,
  100.0::DOUBLE * count_if(prediction > label) / count(*) AS u, 100.0::DOUBLE * count_if(prediction < label) / count(*) AS o FROM ways GROUP BY ord, method),
res AS (SELECT ord, method, n_rows, round(a, 2) AS accuracy, round(u, 2) AS under_triage_pct, round(o, 2) AS over_triage_pct, {grades('u', 'o')} FROM raw),
safe AS (SELECT * FROM res WHERE under_triage_pct <= (SELECT min(under_triage_pct) FROM res) + 0.5 ORDER BY accuracy DESC, under_triage_pct, ord LIMIT 1),
acc AS (SELECT * FROM res ORDER BY accuracy DESC, under_triage_pct, ord LIMIT 1)"""
FOLDS = f"""{PRED}, rk AS ({ranked('pred', 'o_orderkey', 'label')}), fld AS (SELECT label, prediction, CAST((r - 1) % 5 AS INTEGER) AS fold FROM rk),
rate AS (SELECT fold, count(*) AS n_rows, 100.0::DOUBLE * count_if(prediction = label) / count(*) AS accuracy,
  100.0::DOUBLE * count_if(prediction > label) / count(*) AS under_triage_pct, 100.0::DOUBLE * count_if(prediction < label) / count(*) AS over_triage_pct FROM fld GROUP BY fold),
kk AS (SELECT fold, label AS class FROM fld UNION SELECT fold, prediction FROM fld),
f AS (SELECT k.fold, k.class, count_if(f.label = class)::DOUBLE AS s, count_if(f.prediction = class)::DOUBLE AS p, count_if(f.label = class AND f.prediction = class)::DOUBLE AS tp
  FROM kk k JOIN fld f ON f.fold = k.fold GROUP BY ALL),
macro AS (SELECT fold, avg(CASE WHEN tp > 0 THEN 2 * (tp / p) * (tp / s) / (tp / p + tp / s) ELSE 0 END) AS macro_f1 FROM f GROUP BY fold),
fm AS (SELECT fold, n_rows, accuracy, under_triage_pct, over_triage_pct, macro_f1 FROM rate JOIN macro USING (fold))"""

# ---- messy cells --------------------------------------------------------------------------------------
MESSY = """messy AS (SELECT event_id, value, CASE event_type WHEN 'error' THEN 'l' || (props->>'$.k') WHEN 'click' THEN ' ' || (props->>'$.k') || ' '
  WHEN 'signup' THEN NULL ELSE props->>'$.k' END AS cell FROM events),
num AS (SELECT *, TRY_CAST(trim(cell) AS DOUBLE) AS x FROM messy)"""
CACHE = """cache AS (SELECT text, max(CASE WHEN turn <= 2 THEN 'en: ' || text END) AS translation FROM conversations WHERE role = 'user' AND turn <= 2 GROUP BY text),
filled AS (SELECT conv_id, turn, c.text, k.translation, CASE WHEN k.translation IS NULL THEN 'pending' ELSE 'resumed' END AS status
  FROM conversations c LEFT JOIN cache k ON c.text = k.text)"""
CUST = "cust AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b, c_mktsegment FROM customer)"

_WEIGHTS = TERM_WEIGHTS | {"tion": 1.2, "the": 0.4, "ther": 1.7, "in": 0.9, "this": 1.1}
VOCAB_WORD = r"""wt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
wg AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wt),
vw AS (SELECT term, count(*) AS term_count FROM wg GROUP BY term ORDER BY term_count DESC, term LIMIT 350)"""
VOCAB_CHAR = f"""ct AS (SELECT unnest({tokens_of('lower(text)')}) AS w FROM documents), cw AS (SELECT ' ' || w || ' ' AS p, count(*) AS n FROM ct GROUP BY 1),
cg AS (SELECT unnest(list_concat(list_transform(range(1, length(p)), lambda i: substr(p, i::INTEGER, 2)), list_concat(
  list_transform(range(1, length(p) - 1), lambda i: substr(p, i::INTEGER, 3)), list_transform(range(1, greatest(length(p) - 2, 1)), lambda i: substr(p, i::INTEGER, 4))))) AS term, n FROM cw),
vc AS (SELECT term, CAST(sum(n) AS BIGINT) AS term_count FROM cg GROUP BY term ORDER BY term_count DESC, term LIMIT 350)"""


def queries_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["token_doc_freq"] = f"""WITH {FREQ} SELECT token, document_count,
      round(document_count::DOUBLE / (SELECT count(*) FROM documents), 8) AS document_frequency FROM freq"""
    sql["df_cutoff"] = f"WITH {FREQ} SELECT round(quantile_cont(document_count::DOUBLE, 0.75), 6) AS count_cutoff FROM freq"
    sql["stopword_stats"] = f"""{STATS} SELECT token, document_count, round(df, 4) AS document_frequency, round(nmi, 6) AS nmi,
      round(v, 6) AS cramers_v, round(chi2, 4) AS chi_square, dof AS chi_square_dof, {P_VALUE} AS p_value, is_high_frequency, is_uninformative, is_protected, is_stopword FROM stat"""
    sql["stopword_list"] = f"{STATS} SELECT token FROM stat WHERE is_stopword ORDER BY token"
    sql["stopword_reasons"] = f"{STATS} SELECT token, {REASON} AS reason FROM stat"
    sql["stopword_except"] = f"""WITH {LABELS}, lt AS (SELECT doc_id, label FROM documents JOIN lab USING (doc_id)),
      rk AS ({ranked('lt', 'doc_id', 'label')}),
      {stats_ctes()}, {stats_ctes('_t', "d.doc_id IN (SELECT doc_id FROM rk WHERE NOT r <= round(class_n * 0.2::DOUBLE))")}
      SELECT token, 'all_rows' AS only_in FROM (SELECT token FROM stat WHERE is_stopword EXCEPT SELECT token FROM stat_t WHERE is_stopword)
      UNION ALL SELECT token, 'train_rows' FROM (SELECT token FROM stat_t WHERE is_stopword EXCEPT SELECT token FROM stat WHERE is_stopword)"""
    sql["watchlist_intersect"] = f"{STATS} SELECT token FROM stat WHERE is_stopword AND token IN {listed(WATCH)}"
    sql["protected_in_corpus"] = f"WITH {FREQ} SELECT token, document_count FROM freq WHERE token IN {listed(PROTECTED)}"
    sql["remove_stopwords"] = f"""{STATS}, stops AS (SELECT token FROM stat WHERE is_stopword),
      pos AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {LETTERS} AS t FROM documents)),
      kept AS (SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS k FROM pos WHERE token NOT IN (SELECT token FROM stops) GROUP BY doc_id)
      SELECT doc_id, coalesce(k, text) AS text_without_stopwords FROM documents LEFT JOIN kept USING (doc_id)"""
    sql["explain_kept"] = f"""{STATS}, {FREQ} SELECT doc_id, token, {REASON} AS reason FROM tok JOIN stat USING (token) WHERE NOT is_stopword AND NOT is_protected"""
    sql["clean_text"] = f"SELECT doc_id, {CLEAN} AS cleaned FROM documents"
    sql["clean_pages"] = "SELECT page_id, array_to_string(regexp_extract_all(lower(html), '[a-z]+'), ' ') AS cleaned FROM pages"
    sql["phrase_rules"] = f"SELECT doc_id, array_to_string({RULED}, ' ') AS ruled FROM documents"
    sql["canonical_forms"] = f"""WITH ruled AS (SELECT doc_id, {RULED} AS ws FROM documents), {STUTTER.format(source='ruled')}
      SELECT doc_id, array_to_string(t, ' ') AS canonical FROM can"""
    sql["fuzzy_correct"] = f"WITH RECURSIVE {FUZZY} SELECT token, term, round(score, 6) AS score FROM best"
    repaired = """pos AS (SELECT doc_id, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS i FROM ruled),
      rep AS (SELECT doc_id, list(coalesce(term, pos.token) ORDER BY i) AS ws FROM pos LEFT JOIN best ON best.token = pos.token GROUP BY doc_id)"""
    sql["normalize_text"] = f"""WITH RECURSIVE {FUZZY}, {repaired}, {STUTTER.format(source='rep')}
      SELECT d.doc_id, coalesce(array_to_string(t, ' '), '') AS normalized FROM documents d LEFT JOIN can USING (doc_id)"""
    dropped = ["the", "ánd"]
    sql["explain_stages"] = f"""WITH RECURSIVE {FUZZY}, {repaired}, {STUTTER.format(source='rep')},
      al AS (SELECT d.doc_id, d.text AS raw, array_to_string({tokens_of('d.text')}, ' ') AS s0, array_to_string({tokens_of(CLEAN)}, ' ') AS s1,
        array_to_string(ruled.ws, ' ') AS s2, coalesce(array_to_string(rep.ws, ' '), '') AS s3, coalesce(can.t, []) AS f
        FROM documents d JOIN ruled USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN can USING (doc_id)),
      fin AS (SELECT *, array_to_string(f, ' ') AS s4, list_filter(f, lambda w: w NOT IN {listed(dropped)}) AS kept,
        list_filter(f, lambda w: w IN {listed(dropped)}) AS gone FROM al),
      al2 AS (SELECT *, CASE WHEN len(kept) = 0 THEN s4 ELSE array_to_string(kept, ' ') END AS s5,
        array_to_string(list_transform(list_filter(range(1, len(gone) + 1), lambda i: list_position(gone, gone[i]) = i), lambda i: gone[i]), ' ') AS g FROM fin)
      SELECT doc_id, 0 AS stage_no, 'raw' AS stage, md5(raw) AS text_md5, FALSE AS changed, '' AS dropped FROM al2
      UNION ALL SELECT doc_id, 1, 'clean', md5(s1), s1 <> s0, '' FROM al2
      UNION ALL SELECT doc_id, 2, 'rules', md5(s2), s2 <> s1, '' FROM al2
      UNION ALL SELECT doc_id, 3, 'fuzzy', md5(s3), s3 <> s2, '' FROM al2
      UNION ALL SELECT doc_id, 4, 'diacritize', md5(s4), s4 <> s3, '' FROM al2
      UNION ALL SELECT doc_id, 5, 'stopwords', md5(s5), s5 <> s4, g FROM al2"""
    english = listed(ENGLISH_TERMS + ENGLISH_HELPERS)
    stops = listed(ROMAN_STOPWORDS)
    sql["bilingual_split"] = f"""WITH t AS (SELECT doc_id, {tokens_of('lower(text)')} AS t FROM documents),
      s AS (SELECT doc_id, list_filter(t, lambda w: w IN {english}) AS en, list_filter(t, lambda w: w NOT IN {english}) AS ro FROM t)
      SELECT doc_id, array_to_string(en, ' ') AS english_portion, md5(array_to_string(ro, ' ')) AS roman_md5,
        array_to_string(list_filter(en, lambda w: w NOT IN {stops}), ' ') AS english_without_stopwords,
        md5(array_to_string(list_filter(ro, lambda w: w NOT IN {stops}), ' ')) AS roman_without_stopwords_md5 FROM s"""
    wanted = listed(PRIORITY_TERMS + ENGLISH_TERMS)
    sql["bilingual_truncate"] = f"""WITH t AS (SELECT doc_id, {tokens_of('lower(text)')} AS t FROM documents),
      p AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM t),
      q AS (SELECT doc_id, w, min(i) AS i FROM p GROUP BY doc_id, w),
      u AS (SELECT doc_id, list(w ORDER BY i) AS u FROM q GROUP BY doc_id)
      SELECT doc_id, md5(array_to_string(CASE WHEN len(list_filter(u, lambda w: w IN {wanted})) = 0 THEN u
        ELSE list_filter(u, lambda w: w IN {wanted})[1:7] END, ' ')) AS truncated_md5 FROM u"""
    # ---- corpus
    words = f"""ww AS (SELECT unnest({tokens_of('text')}) AS w FROM documents),
      wf AS (SELECT w AS "Word", count(*) AS "Frequency" FROM ww WHERE length(w) > 1 AND w NOT IN {listed(HISTOGRAM_STOPWORDS)} GROUP BY w)"""
    sql["word_frequencies"] = f"WITH {words} SELECT * FROM wf"
    sql["word_freq_top"] = f'WITH {words} SELECT * FROM wf ORDER BY "Frequency" DESC, "Word" LIMIT 30'
    sql["vocab_word"] = f"WITH {VOCAB_WORD} SELECT * FROM vw"
    sql["vocab_char"] = f"WITH {VOCAB_CHAR} SELECT * FROM vc"
    keys = values("wk", "ord, k, w", [(i, k, w) for i, (k, w) in enumerate(_WEIGHTS.items())])
    sql["attention_weights"] = f"""WITH {VOCAB_WORD}, {VOCAB_CHAR}, {keys},
      v AS (SELECT 'w' AS b, * FROM vw UNION ALL SELECT 'c', * FROM vc),
      m AS (SELECT b, term, w, row_number() OVER (PARTITION BY b, term ORDER BY length(k) DESC, ord) AS r FROM v JOIN wk ON
        CASE WHEN length(k) >= {SUBSTRING_KEY} THEN contains(term, k) ELSE list_contains({tokens_of('term')}, k) END)
      SELECT v.term, v.term_count, coalesce(m.w, 1.0)::DOUBLE AS weight FROM v LEFT JOIN m ON m.b = v.b AND m.term = v.term AND m.r = 1"""
    sql["dedupe_texts"] = "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text"
    sql["corpus_profile"] = f"""SELECT count(*) AS n_documents, count(DISTINCT text) AS n_distinct_texts,
      (SELECT count(DISTINCT w) FROM (SELECT unnest({LETTERS}) AS w FROM documents)) AS n_vocabulary, CAST(sum(len({LETTERS})) AS BIGINT) AS n_tokens FROM documents"""
    sql["label_levels"] = f"""WITH {LABELS} SELECT CAST(g AS INTEGER) AS label, count(label) AS n, round(count(label)::DOUBLE / (SELECT count(*) FROM lab), 8) AS share
      FROM range(6) r(g) LEFT JOIN lab ON label = g GROUP BY g"""
    sql["changed_rows"] = f"""SELECT count(*) AS n_rows, count_if(array_to_string({LETTERS}, ' ') <> array_to_string({RULED}, ' ')) AS n_changed FROM documents"""
    single = f"""{LABELS}, lt AS (SELECT doc_id, label, {LETTERS} AS t FROM documents JOIN lab USING (doc_id)),
      tk AS (SELECT doc_id, label, unnest(list_distinct(t)) AS token FROM lt),
      sg AS (SELECT token, min(label) AS label, count(*) AS document_count FROM tk GROUP BY token HAVING count(DISTINCT label) = 1)"""
    sql["single_class_tokens"] = f"WITH {single} SELECT * FROM sg"
    sql["leakage_audit"] = f"""WITH {single} SELECT (SELECT count(DISTINCT token) FROM tk) AS n_tokens, (SELECT count(*) FROM sg) AS n_revealing_tokens,
      (SELECT count(DISTINCT doc_id) FROM tk WHERE token IN (SELECT token FROM sg)) AS n_rows_holding, (SELECT count(*) FROM lt) AS n_rows"""
    sql["category_determinism"] = f"""WITH {LABELS}, c AS (SELECT source AS category, label, count(*) AS n FROM documents JOIN lab USING (doc_id) GROUP BY ALL)
      SELECT category, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, round(max(n)::DOUBLE / sum(n), 8) AS max_class_share FROM c GROUP BY category"""
    sql["record_contradictions"] = """SELECT doc_id, concat_ws(',',
      CASE WHEN (lang = 'en' AND (contains(lower(text), 'tione') OR contains(lower(text), 'thethe'))) OR (lang = 'fr' AND contains(lower(text), 'queque')) THEN 'text_vs_rhythm' END,
      CASE WHEN (lang = 'de' AND NOT n_chars BETWEEN 100 AND 3000) OR (lang = 'es' AND NOT n_chars BETWEEN 50 AND 5000) THEN 'rate_vs_rhythm' END,
      CASE WHEN n_chars <= 2000 AND (contains(lower(text), 'that it') OR contains(lower(text), 'von der')) THEN 'red_flag_at_low_acuity' END,
      CASE WHEN n_chars > 2000 AND (contains(lower(text), 'in the') OR contains(lower(text), 'of the')) THEN 'reassurance_at_high_acuity' END) AS contradictions FROM documents"""
    # ---- splits
    sql["stratified_split"] = f"WITH {LABELS}, rk AS ({ranked('lab', 'doc_id', 'label')}) SELECT doc_id, label, r <= round(class_n * 0.2::DOUBLE) AS is_test FROM rk"
    sql["kfold_assign"] = f"WITH {LABELS}, rk AS ({ranked('lab', 'doc_id', 'label')}) SELECT doc_id, label, CAST((r - 1) % 5 AS INTEGER) AS fold FROM rk"
    sql["sample_n"] = f"SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || '-{SEED}'), doc_id LIMIT 50"
    sql["sample_per_lang"] = f"WITH rk AS ({ranked('documents', 'doc_id', 'lang')}) SELECT doc_id, lang FROM rk WHERE r <= 20"
    order = f"ORDER BY md5(doc_id || '-{SEED}'), doc_id LIMIT 10"
    sql["meaning_clusters"] = f"""WITH lo AS (SELECT doc_id, lower(text) AS text FROM documents),
      c1 AS (SELECT doc_id FROM lo WHERE contains(text, 'heart') OR (contains(text, 'head') AND contains(text, 'th')) {order}),
      c2 AS (SELECT doc_id FROM lo WHERE contains(text, 'thing') AND contains(text, 'that') AND doc_id NOT IN (SELECT doc_id FROM c1) {order}),
      c3 AS (SELECT doc_id FROM lo WHERE contains(text, 'nation') AND doc_id NOT IN (SELECT doc_id FROM c1 UNION ALL SELECT doc_id FROM c2) {order})
      SELECT doc_id, 'heads' AS cluster FROM c1 WHERE (SELECT count(*) FROM c1) = 10 UNION ALL SELECT doc_id, 'things' FROM c2 WHERE (SELECT count(*) FROM c2) = 10
      UNION ALL SELECT doc_id, 'nations' FROM c3 WHERE (SELECT count(*) FROM c3) = 10"""
    sql["rare_class_filter"] = """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)"""
    sql["class_weights"] = f"""WITH {LABELS}, s AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
      SELECT label, n, round((SELECT sum(n) FROM s)::DOUBLE / ((SELECT count(*) FROM s) * n), 8) AS weight FROM s"""
    # ---- vectors
    sql["cluster_pairs"] = f"""WITH {VEC}, {CEN}, {WITHIN} SELECT cluster, id_a, id_b, round(s, 6) AS cosine_similarity,
      round(r, 6) AS pearson_correlation, round(e, 6) AS euclidean_distance FROM pair WHERE s > 0.25"""
    sql["cluster_summary"] = f"""WITH {VEC}, {CEN}, {WITHIN},
      su AS (SELECT cluster, (SELECT count(*) FROM vec WHERE label = cluster) AS n_complaints, count(*) AS n_pairs, avg(s) AS mc, min(s) AS lo, max(s) AS hi,
        avg(r) AS mr, avg(e) AS me, count_if(s > 0.5) AS above, 100.0::DOUBLE * count_if(s > 0.5) / count(*) AS pct FROM pair GROUP BY cluster),
      al AS (SELECT cluster::VARCHAR AS cluster, n_complaints, n_pairs, mc, lo, hi, mr, me, above, pct FROM su UNION ALL
        SELECT 'OVERALL', CAST(sum(n_complaints) AS BIGINT), CAST(sum(n_pairs) AS BIGINT), sum(mc * n_pairs) / sum(n_pairs), min(round(lo, 4)), max(round(hi, 4)),
        avg(round(mr, 4)), avg(round(me, 4)), CAST(sum(above) AS BIGINT), 100.0::DOUBLE * sum(above) / sum(n_pairs) FROM su)
      SELECT cluster, n_complaints, n_pairs, round(mc, 4) AS mean_cosine_similarity, round(lo, 4) AS min_cosine_similarity, round(hi, 4) AS max_cosine_similarity,
        round(mr, 4) AS mean_pearson_correlation, round(me, 4) AS mean_euclidean_distance, above AS pairs_above, round(pct, 4) AS pct_above,
        CASE WHEN pct >= 80 THEN 'ok' WHEN pct >= 50 THEN 'weak' ELSE 'POOR' END AS band FROM al"""
    sql["separation_gap"] = f"""WITH {VEC}, p AS (SELECT a.label = b.label AS same, {CLIP} AS s FROM vec a JOIN vec b ON a.vec_id < b.vec_id)
      SELECT count_if(same) AS within_pairs, count_if(NOT same) AS across_pairs, round(avg(s) FILTER (same), 6) AS within_mean, round(avg(s) FILTER (NOT same), 6) AS across_mean,
        round(min(s) FILTER (same), 6) AS within_min, round(max(s) FILTER (same), 6) AS within_max, round(min(s) FILTER (NOT same), 6) AS across_min,
        round(median(round(s, 4)) FILTER (same), 6) AS within_median, round(median(round(s, 4)) FILTER (NOT same), 6) AS across_median,
        round(max(s) FILTER (NOT same), 6) AS across_max, round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS separation_gap FROM p"""
    sql["group_similarity"] = f"""WITH {VEC}, {CEN}, {WITHIN}, g AS (SELECT cluster AS "group", count(*) AS n_pairs, avg(raw) AS m, median(round(raw, 4)) AS md, min(round(raw, 4)) AS lo, max(round(raw, 4)) AS hi FROM pair GROUP BY cluster)
      SELECT label AS "group", count(*) AS n_rows, any_value(n_pairs) AS n_pairs, round(any_value(m), 4) AS mean_similarity, round(any_value(md), 4) AS median_similarity,
        round(any_value(lo), 4) AS min_similarity, round(any_value(hi), 4) AS max_similarity FROM vec JOIN g ON g."group" = label GROUP BY label"""
    sql["arm_summary"] = f"""WITH {VEC}, {arm('_f', 'vec')} SELECT cluster, round(within, 6) AS within, round(across, 6) AS across, round(gap, 6) AS gap,
      round(pass_rate, 6) AS pass_rate, n_pairs FROM arm_f"""
    cols = ["within", "across", "gap", "pass_rate"]
    sql["two_arm_comparison"] = f"""WITH {VEC}, smooth AS ({SMOOTH}), {arm('_f', 'vec')}, {arm('_h', 'smooth')}
      SELECT f.cluster, f.n_pairs, {', '.join(f'round(f.{c}, 6) AS {c}_plain, round(h.{c}, 6) AS {c}_smoothed' for c in cols)}, round(h.gap - f.gap, 6) AS gap_change
      FROM arm_f f JOIN arm_h h USING (cluster)"""
    sql["pair_check"] = f"""WITH {NEXT} SELECT pair_id, round(raw, 6) AS raw, round(normalized, 6) AS normalized, round(lift, 6) AS lift, round(drift, 6) AS drift,
      passes_threshold, matches_documented FROM chk"""
    sql["pair_check_summary"] = f"""WITH {NEXT} SELECT round(avg(raw), 6) AS mean_raw, round(avg(normalized), 6) AS mean_normalized, round(avg(lift), 6) AS mean_lift,
      count_if(NOT passes_threshold) AS pairs_below_threshold, count_if(NOT matches_documented) AS pairs_drifted FROM chk"""
    sql["nn_closed"] = f"""WITH {VEC}, {nearest('nn', 'vec', 'vec', 'a.vec_id <> b.vec_id')} SELECT vec_id, label AS true_cluster, nb AS neighbour,
      nb_label AS neighbour_cluster, round(s, 6) AS similarity, label = nb_label AS same_meaning FROM nn"""
    sql["nn_open"] = f"WITH {OPEN} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM won"
    sql["nn_efficiency"] = f"""WITH {OPEN}, x AS (SELECT true_cluster AS cluster, * FROM won UNION ALL SELECT -1, * FROM won)
      SELECT cluster, count(*) AS n_rows, round(avg(same_meaning::INTEGER) * 100, 4) AS efficiency_closed_pct,
        round(avg(open_pool_same_meaning::INTEGER) * 100, 4) AS efficiency_open_pct FROM x GROUP BY cluster"""
    sql["nn_misses"] = f"""WITH {VEC}, {nearest('nn', 'vec', 'vec', 'a.vec_id <> b.vec_id')} SELECT vec_id AS key, label AS true_cluster, nb AS neighbour,
      nb_label AS neighbour_cluster FROM nn WHERE label <> nb_label ORDER BY vec_id LIMIT 10"""
    sql["topk_similar"] = f"""WITH {TOPK} SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 6) AS similarity,
      CASE WHEN s >= 0.7 THEN 'confident' WHEN s >= 0.5 THEN 'usable' ELSE 'weak' END AS verdict FROM top"""
    sql["topk_summary"] = f"WITH {TOPK} SELECT query, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS min_similarity FROM top GROUP BY query"
    sql["topk_one_query"] = f"""WITH {VEC}, q AS (SELECT v FROM vec ORDER BY vec_id LIMIT 1), a AS (SELECT vec_id, label, round(list_cosine_similarity(vec.v, q.v), 10) AS s FROM vec, q)
      SELECT vec_id, label, round(s, 6) AS similarity FROM a ORDER BY s DESC, vec_id LIMIT 6"""
    sql["vector_profile"] = f"""WITH {VEC} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_sum(v), 6) AS total,
      round(list_min(v), 6) AS low, round(list_max(v), 6) AS high FROM vec"""
    sql["vector_contract"] = """SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim,
      count_if(embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS n_not_finite,
      (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing,
      count(*) > 0 AND max(len(embedding)) = 64 AND min(len(embedding)) = 64 AND count_if(embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) = 0
        AND (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) = 0 AS is_valid FROM embeddings"""
    sql["block_scale"] = f"""WITH {VEC}, e AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vec), s AS (SELECT i, stddev_pop(x) AS sd FROM e GROUP BY i)
      SELECT round((SELECT avg(sd) FROM s), 6) AS mean_column_sd, round(avg(abs(x)) FILTER (x <> 0), 6) AS mean_abs_nonzero FROM e"""
    sql["vector_cosines"] = f"""WITH {VEC}, j AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)
      SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(a, b))), 6) AS cosine, round(list_cosine_similarity(a, b), 6) AS cosine_raw,
        round({pearson('a', 'b')}, 6) AS pearson, round(list_distance(a, b), 6) AS euclidean, 1.0::DOUBLE AS unit_norm FROM j"""
    # ---- evaluation
    sql["confusion_matrix"] = f"""WITH {CELLS}, g AS (SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction FROM range(5) x(a), range(5) y(b))
      SELECT label, prediction, coalesce(n, 0) AS n FROM g LEFT JOIN cell USING (label, prediction)"""
    sql["confusion_wide"] = f"WITH {PRED} SELECT label, {', '.join(f'count_if(prediction = {k}) AS pred_{k}' for k in range(5))} FROM pred GROUP BY label"
    sql["triage_errors"] = f"""WITH {PRED}, r AS (SELECT count(*) AS n_rows, 100.0::DOUBLE * count_if(prediction = label) / count(*) AS a,
        100.0::DOUBLE * count_if(prediction > label) / count(*) AS u, 100.0::DOUBLE * count_if(prediction < label) / count(*) AS o FROM pred)
      SELECT n_rows, round(a, 6) AS accuracy, round(u, 6) AS under_triage_pct, round(o, 6) AS over_triage_pct, {grades('u', 'o')} FROM r"""
    sql["class_rates"] = f"""WITH {PRED} SELECT label, count(*) AS total_actual, count_if(prediction = label) AS correct, count_if(prediction < label) AS over_triage,
      count_if(prediction > label) AS under_triage, round(100.0::DOUBLE * count_if(prediction = label) / count(*), 6) AS correct_rate,
      round(100.0::DOUBLE * count_if(prediction < label) / count(*), 6) AS over_triage_rate, round(100.0::DOUBLE * count_if(prediction > label) / count(*), 6) AS under_triage_rate
      FROM pred GROUP BY label"""
    sql["error_patterns"] = f"""WITH {CELLS}, s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY label) AS p FROM cell)
      SELECT label, prediction, n, round(p, 6) AS share_pct, CASE WHEN prediction < label THEN 'UPGRADED (over-triage)' ELSE 'DOWNGRADED (under-triage)' END AS direction
      FROM s WHERE label <> prediction"""
    sql["class_report"] = f"""WITH {REPORT} SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support,
      f1 < 0.7 AS is_weak, support <= 2 AS is_tiny, support < 5 AS fewer_rows_than_folds FROM rep"""
    means = ", ".join(
        f'round(avg("{c}"), 6) AS macro_{c}, round(sum("{c}" * support) / sum(support), 6) AS weighted_{c}' for c in ("precision", "recall", "f1"))
    sql["report_averages"] = f"WITH {REPORT} SELECT {means}, CAST(sum(support) AS BIGINT) AS support FROM rep"
    sql["method_table"] = f"WITH {METHODS} SELECT * FROM res"
    sql["method_selection"] = f"""WITH {METHODS} SELECT 'safety_first' AS pick, method, accuracy, under_triage_pct, over_triage_pct FROM safe
      UNION ALL SELECT 'most_accurate', method, accuracy, under_triage_pct, over_triage_pct FROM acc"""
    sql["method_override"] = f"""WITH {METHODS} SELECT res.method, safe.method AS automatic_method, round(res.under_triage_pct - safe.under_triage_pct, 4) AS under_triage_cost,
      round(res.accuracy - safe.accuracy, 4) AS accuracy_gain FROM res, safe WHERE res.method = 'customer'"""
    base = "(SELECT accuracy FROM res WHERE method = 'price') AS ba, (SELECT under_triage_pct FROM res WHERE method = 'price') AS bu"
    sql["baseline_delta"] = f"""WITH {METHODS} SELECT method, round(accuracy - ba, 4) AS accuracy_change, round(under_triage_pct - bu, 4) AS under_triage_change
      FROM (SELECT *, {base} FROM res)"""
    sql["method_ablation"] = f"""WITH {METHODS} SELECT method, round(accuracy - ba, 4) AS accuracy_change, round(under_triage_pct - bu, 4) AS under_triage_change,
      CASE WHEN accuracy > ba OR under_triage_pct < bu THEN 'helped' WHEN accuracy = ba AND under_triage_pct = bu THEN 'no change' ELSE 'did not help' END AS verdict
      FROM (SELECT *, {base} FROM res) WHERE method = 'status'"""
    sql["fold_metrics"] = f"""WITH {FOLDS} SELECT fold, n_rows, round(accuracy, 6) AS accuracy, round(under_triage_pct, 6) AS under_triage_pct,
      round(over_triage_pct, 6) AS over_triage_pct, round(macro_f1, 6) AS macro_f1 FROM fm"""
    both = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("accuracy", "macro_f1", "under_triage_pct"))
    safety = grades("avg(under_triage_pct)", "0").split(",\n")[0]
    sql["fold_summary"] = f"WITH {FOLDS} SELECT {both}, round(avg(over_triage_pct), 6) AS over_triage_pct_mean, {safety} FROM fm"
    # ---- repair and guards
    sql["repair_numeric"] = f"""WITH {MESSY} SELECT event_id, coalesce(x, 50.5)::DOUBLE AS number, x IS NULL AS substituted,
      CASE WHEN x IS NOT NULL THEN '' WHEN cell IS NULL THEN 'k missing->mean' ELSE 'k unreadable (''' || cell || ''')->mean' END AS note FROM num"""
    sql["range_flags"] = f"""WITH {MESSY} SELECT event_id, concat_ws(',', CASE WHEN NOT value BETWEEN 1 AND 100 THEN 'value' END, CASE WHEN NOT x BETWEEN 10 AND 90 THEN 'k' END) AS flags FROM num"""
    sql["safe_category"] = """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s FROM orders)
      SELECT o_orderkey, CASE WHEN upper(s) = 'O' THEN 'O' ELSE 'F' END AS category,
        CASE WHEN upper(s) IN ('F', 'O') THEN '' ELSE 'status=''' || s || ''' not seen in training -> defaulted to ''F''' END AS note FROM r"""
    sql["no_text_guard"] = f"""WITH t AS (SELECT doc_id, len({LETTERS}) < 3 AS nt, (n_chars % 100) / 100.0::DOUBLE AS c FROM documents), k AS (SELECT *, CASE WHEN nt THEN least(c, 0.5) ELSE c END AS cc FROM t)
      SELECT doc_id, nt AS no_text, round(cc, 6) AS confidence, printf('%.1f%%', cc * 100) || CASE WHEN nt THEN '  (capped - no complaint text)' ELSE '' END AS shown, cc < 0.4 AS is_low FROM k"""
    sql["passage_prefix"] = "SELECT item_id, 'passage: ' || coalesce(nullif(trim(text), ''), 'empty complaint') AS passage FROM benchmark"
    arms = " ".join(f"WHEN {k} THEN {quoted(v.split('(')[0].strip())}" for k, v in LEVEL_LABELS.items())
    sql["level_labels"] = f"WITH {LABELS} SELECT doc_id, label + 1 AS triage_level, CASE label {arms} END AS name FROM lab"
    sql["median_impute_scale"] = f"""WITH {CUST}, m AS (SELECT quantile_cont(b, 0.5) AS md FROM cust), f AS (SELECT c_custkey, coalesce(b, md) AS x FROM cust, m)
      SELECT c_custkey, round(x, 4) AS filled, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS scaled FROM f"""
    sql["onehot"] = f"""WITH c AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer)
      SELECT c_custkey, CAST(code AS INTEGER) AS code, {', '.join(f'CASE WHEN code = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS is_{i}' for i in range(5))} FROM c"""
    code = lambda c: f"dense_rank() OVER (ORDER BY {c}) - 1"
    width = lambda c: f"(SELECT count(DISTINCT {c}) FROM part)"
    scaled = lambda c: f"round(({c} - (SELECT avg({c}) FROM part)) / (SELECT stddev_pop({c}) FROM part), 6)"
    sql["generic_structured"] = f"""SELECT p_partkey, {scaled('p_size')} AS p_size, {scaled('p_retailprice')} AS p_retailprice, {code('p_name')} + 2 AS p_name_at,
      {code('p_brand')} + 2 + {width('p_name')} AS p_brand_at, {code('p_type')} + 2 + {width('p_name')} + {width('p_brand')} AS p_type_at,
      2 + {width('p_name')} + {width('p_brand')} + {width('p_type')} AS n_features FROM part"""
    sql["usable_rows"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(text, ' \t\n\r') <> '' AND source <> '' AND lang <> ''"
    sql["display_row_ids"] = "SELECT o_orderkey, row_number() OVER () AS row_id FROM orders"
    sql["best_macro_f1"] = f"""WITH {METHODS.split("raw AS (")[0].replace(" FROM orders", ", CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders").rstrip().rstrip(",")},
      kk AS (SELECT ord, method, fold, label AS class FROM ways UNION SELECT ord, method, fold, prediction FROM ways),
      f AS (SELECT k.ord, k.method, k.fold, k.class, count_if(w.label = class)::DOUBLE AS s, count_if(w.prediction = class)::DOUBLE AS p, count_if(w.label = class AND w.prediction = class)::DOUBLE AS tp
        FROM kk k JOIN ways w ON w.ord = k.ord AND w.fold = k.fold GROUP BY ALL),
      macro AS (SELECT ord, method, fold, avg(CASE WHEN tp > 0 THEN 2 * (tp / p) * (tp / s) / (tp / p + tp / s) ELSE 0 END) AS m FROM f GROUP BY ALL),
      acc AS (SELECT ord, fold, 100.0::DOUBLE * count_if(prediction = label) / count(*) AS a FROM ways GROUP BY ALL)
      SELECT method, round(avg(m), 6) AS macro_f1_mean, round(stddev_pop(m), 6) AS macro_f1_std, round(avg(a), 6) AS accuracy_mean
      FROM macro JOIN acc USING (ord, fold) GROUP BY ord, method ORDER BY avg(m) DESC, ord LIMIT 1"""
    each = " UNION ALL ".join(
        f"SELECT '{m}' AS model, '{t}' AS target, CAST((r - 1) % 5 AS INTEGER) AS fold, CAST({t} AS INTEGER) AS label FROM rk_{t}"
        for m in ("LogisticRegression", "RandomForest", "HistGradientBoosting") for t in ("level", "label"))
    sql["cv_coverage"] = f"""WITH v AS (SELECT vec_id, label, label % 4 AS level FROM embeddings), rk_level AS ({ranked('v', 'vec_id', 'level')}),
      rk_label AS ({ranked('v', 'vec_id', 'label')}) SELECT model, target, fold, label, count(*) AS n, count(*) AS n_different FROM ({each}) GROUP BY ALL"""
    sql["cache_enrich"] = f"WITH {CACHE} SELECT conv_id, turn, translation, status FROM filled"
    sql["pending_rows"] = f"WITH {CACHE} SELECT text, count(*) AS n_rows FROM filled WHERE status = 'pending' GROUP BY text"
    sql["enrich_status"] = f"""WITH {CACHE} SELECT count(*) AS n_rows, count_if(status = 'resumed') AS n_resumed, count_if(status = 'pending') AS n_pending,
      0::BIGINT AS n_translated, 0::BIGINT AS n_failed FROM filled"""
    sql["enrich_run"] = f"""WITH {CACHE} SELECT conv_id, turn, coalesce(translation, CASE WHEN length(text) < 400 THEN nullif(reverse(text), '') END) AS translation,
      CASE WHEN status = 'resumed' THEN status WHEN length(text) < 400 AND trim(text) <> '' THEN 'translated' ELSE 'failed' END AS status FROM filled"""
    weights = values("tw", "ord, k, w", [(i, k, w) for i, (k, w) in enumerate(TERM_WEIGHTS.items())])
    sql["bow_features"] = f"""WITH {VOCAB_WORD}, {VOCAB_CHAR}, {weights}, v AS (SELECT 'w' AS b, term FROM vw UNION ALL SELECT 'c', term FROM vc),
      m AS (SELECT b, term, w, row_number() OVER (PARTITION BY b, term ORDER BY length(k) DESC, ord) AS r FROM v JOIN tw ON
        CASE WHEN length(k) >= {SUBSTRING_KEY} THEN contains(term, k) ELSE list_contains({tokens_of('term')}, k) END),
      f AS (SELECT v.b, v.term, coalesce(m.w, 1.0)::DOUBLE AS w FROM v LEFT JOIN m ON m.b = v.b AND m.term = v.term AND m.r = 1),
      dw AS (SELECT doc_id, 'w' AS b, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wt),
      dt AS (SELECT doc_id, ' ' || unnest({tokens_of('lower(text)')}) || ' ' AS p FROM documents),
      dc AS (SELECT doc_id, 'c' AS b, unnest(list_concat(list_transform(range(1, length(p)), lambda i: substr(p, i::INTEGER, 2)), list_concat(
        list_transform(range(1, length(p) - 1), lambda i: substr(p, i::INTEGER, 3)), list_transform(range(1, greatest(length(p) - 2, 1)), lambda i: substr(p, i::INTEGER, 4))))) AS term FROM dt),
      hits AS (SELECT doc_id, a.b, a.term, count(*) * any_value(f.w) AS x FROM (SELECT * FROM dw UNION ALL SELECT * FROM dc) a JOIN f ON f.b = a.b AND f.term = a.term GROUP BY doc_id, a.b, a.term)
      SELECT d.doc_id, round(coalesce(sum(x), 0), 4) AS total, CAST(count(x) AS INTEGER) AS n_nonzero FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id"""
    gone = listed(["the", "ánd", "in"])
    sql["preprocess_text"] = f"""WITH RECURSIVE {FUZZY}, {repaired}, {STUTTER.format(source='rep')},
      k AS (SELECT doc_id, t, list_filter(t, lambda w: w NOT IN {gone}) AS kept FROM can)
      SELECT d.doc_id, coalesce(array_to_string(CASE WHEN len(kept) = 0 THEN t ELSE kept END, ' '), '') AS preprocessed FROM documents d LEFT JOIN k USING (doc_id)"""
    sql["stopword_report"] = f"""{STATS} SELECT count(*) AS n_tokens_tested, (SELECT count(*) FROM ldoc) AS n_documents,
      string_agg(token, ' ' ORDER BY token) FILTER (is_stopword) AS stopwords,
      coalesce(string_agg(token, ' ' ORDER BY token) FILTER (is_uninformative AND is_protected), '') AS protected_from_removal,
      coalesce(string_agg(token, ' ' ORDER BY token) FILTER (is_stopword AND token IN {listed(WATCH)}), '') AS review_recommended FROM stat"""
    sql["wide_to_long"] = """SELECT 'p_brand' AS cluster, p_brand AS text, count(*) AS n FROM part GROUP BY ALL
      UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL"""
    return sql

