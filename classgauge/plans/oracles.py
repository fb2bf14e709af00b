"""The same results in plain SQL over the whole tables, written from the definitions.

Each check is a chain of named subqueries; ``_sql`` puts the chain in front of the
final select.
"""

from __future__ import annotations

from classgauge.plans.queries import ARABIC, HEAD_SCALE, LATIN, TEXT_SCALE

Chain = tuple[tuple[str, str], ...]


def _sql(chain: Chain, final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in chain) + "\n" + final


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


LABEL = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END"
NAME = "CASE {0} WHEN 0 THEN 'NEG' WHEN 1 THEN 'POS' WHEN 2 THEN 'NEU' END"
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
BIGRAMS = "list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))"
STRIP = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Inputs.

LABELLED: Chain = (("base", f"SELECT doc_id AS id, text, {LABEL} AS label FROM documents JOIN labels USING (doc_id)"),)
EMBEDDED: Chain = (("base", "SELECT vec_id AS id, embedding, label FROM embeddings"),)

RAW: Chain = (
    ("tokens", f"SELECT doc_id, {TOKENS} AS tok FROM documents"),
    (
        "raw",
        "SELECT d.doc_id AS id, d.text, d.lang, d.source, t.tok,"
        " CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 AND quality = 1 THEN 'MIX' WHEN toxic = 1 THEN 'NEG'"
        " WHEN quality = 1 THEN 'POS' ELSE 'NEU' END AS annotation"
        " FROM documents d JOIN tokens t USING (doc_id) LEFT JOIN labels l USING (doc_id)",
    ),
)

QUOTAS: Chain = (
    ("q0", "SELECT label, count(*)::HUGEINT AS n FROM base GROUP BY label"),
    ("q1", "SELECT *, sum(n) OVER () AS total FROM q0"),
    ("q2", "SELECT *, total - ceil(total * 0.2)::HUGEINT AS rest FROM q1"),
    ("q3", "SELECT *, (n * rest) // total AS fl, row_number() OVER (ORDER BY (n * rest) % total DESC, label) AS rk FROM q2"),
    ("q4", "SELECT label, n, rest, fl + (rk <= rest - sum(fl) OVER ())::INT AS kept FROM q3"),
    ("q5", "SELECT *, rest - ceil(rest * 0.125)::HUGEINT AS train FROM q4"),
    ("q6", "SELECT *, (kept * train) // rest AS fl, row_number() OVER (ORDER BY (kept * train) % rest DESC, label) AS rk FROM q5"),
    ("q7", "SELECT *, fl + (rk <= train - sum(fl) OVER ())::INT AS nt FROM q6"),
    (
        "quotas",
        "SELECT label, n::BIGINT AS n_rows, nt::BIGINT AS n_train, (kept - nt)::BIGINT AS n_val, (n - kept)::BIGINT AS n_test FROM q7",
    ),
)
SPLIT: Chain = QUOTAS + (
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rk FROM base"),
    (
        "parts",
        "SELECT base.*, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split"
        " FROM ranked JOIN quotas USING (label) JOIN base USING (id)",
    ),
)

# Term weights under the train vocabulary.

TERMS: Chain = LABELLED + SPLIT + (
    ("toks", f"SELECT id, label, split, {TOKENS} AS tok FROM parts"),
    ("exploded", f"SELECT id, label, split, unnest({BIGRAMS}) AS term FROM toks"),
    ("tf", "SELECT id, label, split, term, count(*) AS tf FROM exploded GROUP BY ALL"),
    ("fit", "SELECT count(*) AS n FROM parts WHERE split = 'train'"),
    ("df", "SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term"),
    (
        "vocab",
        "SELECT row_number() OVER (ORDER BY term) - 1 AS term_idx, term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf"
        " FROM df, fit WHERE df >= 2 AND df <= 0.95 * n",
    ),
)
WEIGHTS: Chain = TERMS + (
    ("raws", "SELECT id, label, split, term_idx, term, (1 + ln(tf)) * idf AS x FROM tf JOIN vocab USING (term)"),
    ("weights", "SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raws"),
)

# Models: w(c, term_idx, w) and b(c, b).

SIZES: Chain = (("sizes", "SELECT label AS c, count(*) AS n FROM parts WHERE split = 'train' GROUP BY label"),)
CENTROID: Chain = WEIGHTS + SIZES + (
    (
        "means",
        "SELECT label AS c, term_idx, sum(weight) / any_value(n) AS m FROM weights JOIN sizes ON c = label"
        " WHERE split = 'train' GROUP BY label, term_idx",
    ),
    ("w", f"SELECT c, term_idx, m * {TEXT_SCALE} AS w FROM means"),
    ("b", f"SELECT c, -0.5 * sum(m * m) * {TEXT_SCALE} AS b FROM means GROUP BY c"),
)
BAYES: Chain = TERMS + SIZES + (
    ("tsums", "SELECT label AS c, term_idx, sum(tf) AS s FROM tf JOIN vocab USING (term) WHERE split = 'train' GROUP BY ALL"),
    ("totals", "SELECT c, sum(s) + (SELECT count(*) FROM vocab) AS t FROM tsums GROUP BY c"),
    (
        "w",
        "SELECT c, term_idx, ln((coalesce(s, 0) + 1)::DOUBLE) - ln(t::DOUBLE) AS w"
        " FROM (SELECT c, t, term_idx FROM totals, vocab) LEFT JOIN tsums USING (c, term_idx)",
    ),
    ("b", "SELECT c, ln((n + 1)::DOUBLE) - ln((sum(n) OVER () + 3)::DOUBLE) AS b FROM sizes"),
)

# Logits lp(id, y, c, z), then probabilities and one scored row per id.

SOFTMAX: Chain = (
    ("shifted", "SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM lp"),
    ("pr", "SELECT id, y, c, z, e / sum(e) OVER (PARTITION BY id) AS p FROM shifted"),
    (
        "scored",
        "SELECT id, y, list(p ORDER BY c) AS probs, list_position(list(p ORDER BY c), max(p)) - 1 AS pred FROM pr GROUP BY id, y",
    ),
)


def _dense(dims: int = 64, where: str = "split = 'test'") -> Chain:
    return EMBEDDED + SPLIT + (
        ("long", f"SELECT id, label, split, unnest(embedding[1:{dims}])::DOUBLE AS x, generate_subscripts(embedding[1:{dims}], 1) - 1 AS pos FROM parts"),
        ("means", "SELECT label AS c, pos, avg(x) AS m FROM long WHERE split = 'train' GROUP BY ALL"),
        ("b", f"SELECT c, -0.5 * {HEAD_SCALE} * sum(m * m) AS b FROM means GROUP BY c"),
        (
            "lp",
            f"SELECT id, any_value(label) AS y, c, sum(x * m) * {HEAD_SCALE} + any_value(b) AS z"
            f" FROM long JOIN means USING (pos) JOIN b USING (c) WHERE {where} GROUP BY id, c",
        ),
    )


DENSE = _dense() + SOFTMAX
DENSE_WHOLE = _dense(where="true") + SOFTMAX


def _centroid_scored(where: str) -> Chain:
    return CENTROID + (
        ("dots", f"SELECT id, c, sum(weight * w) AS d FROM weights JOIN w USING (term_idx) WHERE {where} GROUP BY id, c"),
        (
            "lp",
            f"SELECT id, label AS y, c, coalesce(d, 0) + b AS z FROM (SELECT id, label, c, b FROM parts, b WHERE {where})"
            " LEFT JOIN dots USING (id, c)",
        ),
    ) + SOFTMAX


CENTROID_SCORED = _centroid_scored("split = 'test'")
BAYES_SCORED = BAYES + (
    (
        "dots",
        "SELECT id, c, sum(tf * w) AS d FROM tf JOIN vocab USING (term) JOIN w USING (term_idx) WHERE split = 'test' GROUP BY id, c",
    ),
    (
        "lp",
        "SELECT id, label AS y, c, coalesce(d, 0) + b AS z FROM (SELECT id, label, c, b FROM parts, b WHERE split = 'test')"
        " LEFT JOIN dots USING (id, c)",
    ),
) + SOFTMAX

# New texts under the centroid model.
NEW_TEXTS: Chain = CENTROID + (
    ("ntok", f"SELECT conv_id, turn, {TOKENS} AS tok FROM conversations"),
    ("nexp", f"SELECT conv_id, turn, unnest({BIGRAMS}) AS term FROM ntok"),
    ("ntf", "SELECT conv_id, turn, term, count(*) AS tf FROM nexp GROUP BY ALL"),
    ("nraw", "SELECT conv_id, turn, term_idx, (1 + ln(tf)) * idf AS x FROM ntf JOIN vocab USING (term)"),
    ("nwgt", "SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS weight FROM nraw"),
    ("ndot", "SELECT conv_id, turn, c, sum(weight * w) AS d FROM nwgt JOIN w USING (term_idx) GROUP BY ALL"),
    (
        "lp",
        "SELECT conv_id || ':' || turn AS id, 0 AS y, c, coalesce(d, 0) + b AS z"
        " FROM (SELECT conv_id, turn, c, b FROM conversations, b) LEFT JOIN ndot USING (conv_id, turn, c)",
    ),
) + SOFTMAX
NEW_SCORED = (
    f"SELECT conv_id, turn, role, {{0}}{NAME.format('pred')} AS \"Pred_Label\","
    f" {_r('probs[1]')} AS \"Prob_NEG\", {_r('probs[2]')} AS \"Prob_POS\", {_r('probs[3]')} AS \"Prob_NEU\""
    " FROM conversations v JOIN scored ON scored.id = v.conv_id || ':' || v.turn"
)

# Metrics over scored.

CELLS: Chain = (
    ("cells", "SELECT y, pred, count(*) AS n FROM scored GROUP BY y, pred"),
    ("seen", "SELECT y AS c FROM cells UNION SELECT pred FROM cells"),
)


def _rates(classes: str) -> Chain:
    return (
        (
            "sums",
            "SELECT c, coalesce((SELECT sum(n) FROM cells WHERE y = c), 0) AS support,"
            " coalesce((SELECT sum(n) FROM cells WHERE pred = c), 0) AS guessed,"
            f" coalesce((SELECT sum(n) FROM cells WHERE y = c AND pred = c), 0) AS tp FROM {classes}",
        ),
        ("pr1", "SELECT *, coalesce(tp::DOUBLE / nullif(guessed, 0), 0) AS pre, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS rec FROM sums"),
        ("rates", "SELECT *, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0) AS f1 FROM pr1"),
    )


SEEN_RATES = CELLS + _rates("seen")
PER_CLASS = f"SELECT c::INT AS class_id, {{0}}{_r('pre')} AS precision, {_r('rec')} AS recall, {_r('f1')} AS f1, support::BIGINT AS support FROM rates"
EPS = "2.220446049250313e-16"
LOSSES: Chain = (
    (
        "losses",
        f"SELECT -ln(greatest(least(probs[y + 1], 1 - {EPS}::DOUBLE), {EPS}::DOUBLE)) AS ll,"
        " (SELECT sum(pow(p - (c = y)::INT, 2)) FROM pr WHERE pr.id = scored.id) AS bs FROM scored",
    ),
)
BINS: Chain = (
    ("confs", "SELECT y, pred, list_max(probs) AS conf FROM scored"),
    ("binned", "SELECT *, (SELECT count(*) FROM range(1, 15) t(i) WHERE conf > i * (1.0::DOUBLE / 15)) AS bin FROM confs"),
    ("bins", "SELECT bin, avg((y = pred)::INT) AS acc, avg(conf) AS conf, count(*) AS n FROM binned GROUP BY bin"),
)
ECE = "sum(n * abs(acc - conf)) / sum(n)"
MEANS = {
    "accuracy": "(SELECT avg((y = pred)::INT) FROM scored)",
    "precision_weighted": "(SELECT sum(pre * support) / sum(support) FROM rates)",
    "recall_weighted": "(SELECT sum(rec * support) / sum(support) FROM rates)",
    "f1_weighted": "(SELECT sum(f1 * support) / sum(support) FROM rates)",
    "precision_macro": "(SELECT avg(pre) FROM rates)",
    "recall_macro": "(SELECT avg(rec) FROM rates)",
    "f1_macro": "(SELECT avg(f1) FROM rates)",
    "log_loss": "(SELECT avg(ll) FROM losses)",
    "brier_score": "(SELECT avg(bs) FROM losses)",
    "ece_15bins": f"(SELECT {ECE} FROM bins)",
}
OVERALL = " UNION ALL ".join(
    f"SELECT {i} AS \"row\", '{name}' AS metric, {_r(expr)} AS value" for i, (name, expr) in enumerate(MEANS.items())
)
ALL_METRICS = SEEN_RATES + LOSSES + BINS

ROC: Chain = (
    ("ovr", "SELECT id, c, p AS s, (y = c)::INT AS pos FROM pr"),
    ("grouped", "SELECT c, s, sum(pos) AS pos, sum(1 - pos) AS neg FROM ovr GROUP BY c, s"),
    (
        "roc",
        "SELECT c, s, (sum(neg) OVER down)::DOUBLE / nullif(sum(neg) OVER (PARTITION BY c), 0) AS fpr,"
        " (sum(pos) OVER down)::DOUBLE / nullif(sum(pos) OVER (PARTITION BY c), 0) AS tpr FROM grouped"
        " WINDOW down AS (PARTITION BY c ORDER BY s DESC) UNION ALL SELECT DISTINCT c, NULL, 0.0, 0.0 FROM grouped",
    ),
    (
        "steps",
        "SELECT c, fpr, tpr, fpr - lag(fpr) OVER o AS dx, (tpr + lag(tpr) OVER o) / 2 AS mid FROM roc"
        " WINDOW o AS (PARTITION BY c ORDER BY fpr, tpr)",
    ),
    ("aucs", "SELECT c, sum(dx * mid) AS auc FROM steps GROUP BY c"),
)
# Every class curve read at every rate of the union grid: the last value on a repeated
# rate, a straight line between neighbours otherwise; then mean and trapezoids.
INTERPOLATED: Chain = ROC + (
    ("knots", "SELECT c, fpr, max(tpr) AS hi, min(tpr) AS lo FROM roc GROUP BY c, fpr"),
    ("asked", "SELECT * FROM (SELECT DISTINCT fpr AS f FROM roc), (SELECT DISTINCT c FROM roc)"),
    ("i1", "SELECT a.c, a.f, k.fpr AS f0, k.hi AS y0 FROM asked a ASOF JOIN knots k ON a.c = k.c AND a.f >= k.fpr"),
    ("i2", "SELECT i1.*, k.fpr AS f1, k.lo AS y1 FROM i1 ASOF LEFT JOIN knots k ON i1.c = k.c AND i1.f < k.fpr"),
    ("vals", "SELECT f, avg(CASE WHEN f = f0 THEN y0 ELSE y0 + (y1 - y0) * (f - f0) / (f1 - f0) END) AS t FROM i2 GROUP BY f"),
    ("cut", "SELECT (f - lag(f) OVER (ORDER BY f)) * (t + lag(t) OVER (ORDER BY f)) / 2 AS a FROM vals"),
)

DENSE_SQL = _sql(DENSE, "SELECT * FROM scored")
SHORT_SQL = _sql(_dense(32) + SOFTMAX, "SELECT * FROM scored")
CENTROID_SQL = _sql(CENTROID_SCORED, "SELECT * FROM scored")
BAYES_SQL = _sql(BAYES_SCORED, "SELECT * FROM scored")


def _pair(a: str, b: str) -> Chain:
    return (
        ("sa", a),
        ("sb", b),
        (
            "pair",
            "SELECT count(*) FILTER (sa.pred = sa.y AND sb.pred <> sb.y) AS b,"
            " count(*) FILTER (sa.pred <> sa.y AND sb.pred = sb.y) AS c FROM sa JOIN sb USING (id)",
        ),
    )


# The tail by an integral with a closed form (Craig): the mean of exp(-x / 2 sin^2) over the first quarter turn.
TAIL = "list_avg(list_transform(range(2000), lambda i: exp(-({0}) / 2 / pow(sin((i + 0.5::DOUBLE) * pi() / 4000), 2))))"
CHI2 = "CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2)::DOUBLE / (b + c) END"


def _baseline(name: str, scored: str) -> str:
    chain = (
        ("s", scored),
        ("m", "SELECT y AS maj FROM s GROUP BY y ORDER BY count(*) DESC, y LIMIT 1"),
        (
            "bc",
            "SELECT any_value(maj) AS maj, count(*) FILTER (pred = y AND y <> maj) AS b,"
            " count(*) FILTER (pred <> y AND y = maj) AS c FROM s, m",
        ),
    )
    return "SELECT * FROM (" + _sql(chain, f"SELECT '{name}' AS model, maj AS majority, b, c, {_r(CHI2)} AS chi2, {_r(TAIL.format(CHI2))} AS p_value FROM bc") + ")"


# Resamples drawn cell by cell as binomial shares of what is left. Each round of the recursion moves every resample one
# step: on to the next count while the law up to here is under the cell's uniform number, else to the next cell. Sums are
# exact to the last bits for means up to 200, as the tables' are that these queries run on.
RESAMPLES: Chain = (
    (
        "law",
        "SELECT row_number() OVER w AS i, y, pred, n, (sum(n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS mass"
        " FROM (SELECT y, pred, count(*) AS n FROM scored GROUP BY y, pred) WINDOW w AS (ORDER BY y, pred)",
    ),
    (
        "chances",
        "SELECT r, i, y, pred, n / mass > 0.5 AS flip, least(n / mass, 1 - n / mass) AS q,"
        " ('0x' || substr(md5('42:' || r || ':' || y || ':' || pred), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM law, range(1000) t(r)",
    ),
    (
        "walk",
        "SELECT r, i, (SELECT sum(n) FROM law)::BIGINT AS rest, 0::BIGINT AS k, exp((SELECT sum(n) FROM law) * ln(1 - q)) AS f,"
        " exp((SELECT sum(n) FROM law) * ln(1 - q)) AS upto FROM chances WHERE i = 1 UNION ALL"
        " SELECT r, CASE WHEN go THEN i ELSE i + 1 END, CASE WHEN go THEN rest ELSE after END, CASE WHEN go THEN k + 1 ELSE 0 END,"
        " CASE WHEN go THEN f2 ELSE start END, CASE WHEN go THEN upto + f2 ELSE start END FROM ("
        "SELECT w.*, w.upto < c.u AND w.k < w.rest AND c.q > 0 AS go, w.f * ((w.rest - w.k) / (w.k + 1.0::DOUBLE)) * (c.q / (1 - c.q)) AS f2,"
        " CASE WHEN c.flip THEN w.k ELSE w.rest - w.k END AS after, exp(CASE WHEN c.flip THEN w.k ELSE w.rest - w.k END * ln(1 - d.q)) AS start, d.i AS more"
        " FROM walk w JOIN chances c ON c.r = w.r AND c.i = w.i LEFT JOIN chances d ON d.r = w.r AND d.i = w.i + 1) WHERE go OR more IS NOT NULL",
    ),
    ("ended", "SELECT r, i, any_value(rest) AS rest, max(k) AS k FROM walk GROUP BY r, i"),
    ("resampled", "SELECT r, y, pred, CASE WHEN flip THEN rest - k ELSE k END AS n FROM ended JOIN chances USING (r, i)"),
    (
        "shares",
        "SELECT r, y AS c, n AS s, CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM resampled WHERE n > 0"
        " UNION ALL SELECT r, pred, n, 0 FROM resampled WHERE n > 0",
    ),
    ("f1s", "SELECT r, avg(f1) AS f1 FROM (SELECT r, c, 2.0::DOUBLE * sum(tp) / sum(s) AS f1 FROM shares GROUP BY r, c) GROUP BY r"),
)
LOWER_F1, UPPER_F1 = (f"(SELECT quantile_cont(f1, {q}) FROM f1s)" for q in (0.025, 0.975))

# The letters' shares that stand in for a model from outside.
SHARES = "length(text) - length(translate(text, '{0}', '')) AS {1}"
VOWELS, CONSONANTS = SHARES.format("aeiou", "v"), SHARES.format("bcdfghjklmnpqrstvwxyz", "k")
OUTSIDE_NEW: Chain = (("asked", f"SELECT *, 0 AS y, row_number() OVER () AS id, length(text) AS l, {VOWELS}, {CONSONANTS} FROM conversations"),)
OUTSIDE_TEST: Chain = (("asked", f"SELECT id, label AS y, length(text) AS l, {VOWELS}, {CONSONANTS} FROM parts WHERE split = 'test'"),)
SOFT_SHARES: Chain = (
    ("pr", "SELECT id, y, unnest([0, 1, 2]) AS c, unnest([v + 1, k + 1, l - v - k + 1]) / (l + 3)::DOUBLE AS p FROM asked"),
    ("scored", "SELECT id, y, list(p ORDER BY c) AS probs, list_position(list(p ORDER BY c), max(p)) - 1 AS pred FROM pr GROUP BY id, y"),
)
NEW_SHARES = f"SELECT conv_id, turn, role, {NAME.format('pred')} AS \"Pred_Label\", " + ", ".join(
    f"{_r(f'probs[{i + 1}]')} AS \"Prob_{n}\"" for i, n in enumerate(("NEG", "POS", "NEU"))
) + " FROM asked JOIN scored USING (id)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _macro(scored_chain: Chain) -> str:
    return "(" + _sql(scored_chain + ROC, "SELECT avg(auc) FROM aucs") + ")"


# The normaliser one rule at a time, as defined.
FOLD_FROM = "\u0625\u0623\u0622\u0649\u0629"  # alef with hamza below, above, with madda; alef maksura; teh marbuta
FOLD_TO = "\u0627\u0627\u0627\u064a\u0647"  # alef three times; yeh; heh
TATWEEL = "\u0640"
_CLASS = r"[\x{0617}-\x{061A}\x{064B}-\x{0652}]"
_FOLDS = "".join(f"\\x{{{ord(c):04X}}}" for c in FOLD_FROM[:3] + FOLD_TO[:1])
ARABIC_CLEAN: Chain = (
    ("t0", f"SELECT doc_id AS id, translate(coalesce(text, ''), '{LATIN}', '{ARABIC}') AS t FROM documents"),
    ("t1", f"SELECT id, regexp_replace(t, '{_CLASS}', '', 'g') AS t FROM t0"),
    ("t2", f"SELECT id, replace(t, '{TATWEEL}', '') AS t FROM t1"),
    ("t3", f"SELECT id, regexp_replace(t, '[{_FOLDS}]', '{FOLD_TO[0]}', 'g') AS t FROM t2"),
    ("t4", f"SELECT id, replace(replace(t, '{FOLD_FROM[3]}', '{FOLD_TO[3]}'), '{FOLD_FROM[4]}', '{FOLD_TO[4]}') AS t FROM t3"),
    ("t5", r"SELECT id, regexp_replace(t, '[^0-9a-zA-Z\x{0621}-\x{064A}\s]', ' ', 'g') AS t FROM t4"),
    ("t6", r"SELECT id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM t5"),
    ("toks", r"SELECT id, list_filter(string_split(t, ' '), lambda w: regexp_full_match(w, '[\x{0621}-\x{064A}]+')) AS tok FROM t6"),
    ("terms", f"SELECT id, {BIGRAMS} AS terms FROM toks"),
)
GENERIC: Chain = (
    ("toks", f"SELECT doc_id AS id, {TOKENS} AS tok FROM documents"),
    ("terms", f"SELECT id, {BIGRAMS} AS terms FROM toks"),
    ("exploded", "SELECT id, unnest(terms) AS term FROM terms"),
    ("tf", "SELECT id, term, count(*) AS tf FROM exploded GROUP BY ALL"),
)
DIGEST = "SELECT id, len(terms)::BIGINT AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5 FROM terms"
LINES: Chain = (
    ("cut", "SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents"),
    ("long", "SELECT id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS line_no FROM cut"),
    ("bare", f"SELECT id, line_no, regexp_replace(line, '^{STRIP}+|{STRIP}+$', '', 'g') AS line FROM long"),
)
# Each line under naive Bayes.
LINE_SCORES = BAYES + (
    ("lines", "SELECT id, line_no, line FROM (" + _sql(LINES, "SELECT * FROM bare WHERE line <> ''") + ")"),
    ("ltok", f"SELECT id, line_no, {TOKENS.replace('text', 'line')} AS tok FROM lines"),
    ("lexp", f"SELECT id, line_no, unnest({BIGRAMS}) AS term FROM ltok"),
    ("ldot", "SELECT id, line_no, c, sum(w) AS d FROM lexp JOIN vocab USING (term) JOIN w USING (term_idx) GROUP BY ALL"),
    (
        "lz",
        "SELECT id, line_no, c, coalesce(d, 0) + b AS z FROM (SELECT id, line_no, c, b FROM lines, b) LEFT JOIN ldot USING (id, line_no, c)",
    ),
    ("le", "SELECT *, exp(z - max(z) OVER (PARTITION BY id, line_no)) AS e FROM lz"),
    ("lp", "SELECT id, line_no, c, e / sum(e) OVER (PARTITION BY id, line_no) AS p FROM le"),
    (
        "lscored",
        "SELECT id, line_no, list(p ORDER BY c) AS probs, list_position(list(p ORDER BY c), max(p)) - 1 AS pred FROM lp GROUP BY ALL",
    ),
)
VECTOR_DIGEST = (
    "SELECT p.id, (SELECT count(*) FROM vocab) AS size, count(term_idx) AS n_terms, coalesce(sum(term_idx), 0)::BIGINT AS index_sum,"
    f" {_r('coalesce(sum(weight), 0)')} AS total FROM parts p {{0}} JOIN weights USING (id) GROUP BY p.id"
)
PREVIEW_W = (
    "SELECT c::INT AS class_id, v.term_idx, v.term, coalesce(w.w, 0) AS w FROM vocab v CROSS JOIN sizes"
    " LEFT JOIN w USING (c, term_idx) WHERE v.term_idx < 10 AND c < 5"
)

ORACLES: dict[str, str] = {
    "labelled_scan": _sql(LABELLED, "SELECT id, label, md5(text) AS text_md5 FROM base"),
    "new_texts_from_csv": "SELECT conv_id, turn, role, text FROM conversations",
    "typed_lines": _sql(LINES, "SELECT id, line_no, line FROM bare WHERE line <> ''"),
    "complete_rows": _sql(RAW, "SELECT id, annotation FROM raw WHERE text IS NOT NULL AND annotation IS NOT NULL"),
    "prepared_rows": _sql(
        RAW,
        "SELECT id, md5(coalesce(array_to_string(tok, ' '), '')) AS text_md5,"
        " CASE annotation WHEN 'NEG' THEN 0 WHEN 'POS' THEN 1 ELSE 2 END AS label"
        " FROM raw WHERE annotation IN ('NEG', 'POS', 'NEU') AND source <> 'src7'",
    ),
    "rejected_rows": _sql(
        RAW,
        "SELECT id, annotation, CASE WHEN source = 'src7' THEN 'tokens' ELSE 'annotation' END AS reason"
        " FROM raw WHERE annotation = 'MIX' OR (annotation IS NOT NULL AND source = 'src7')",
    ),
    "label_names": _sql(LABELLED, f"SELECT id, {NAME.format('label')} AS label_name FROM base"),
    "input_preview": _sql(
        RAW,
        "SELECT id, coalesce(array_to_string(tok, ' '), '') AS text, CASE annotation WHEN 'NEG' THEN 0 WHEN 'POS' THEN 1 ELSE 2 END AS label"
        " FROM raw WHERE annotation IN ('NEG', 'POS', 'NEU') AND source <> 'src7' ORDER BY id LIMIT 10",
    ),
    "column_as_text": "SELECT conv_id, turn, turn::VARCHAR AS text FROM conversations",
    "arabic_normalized": _sql(ARABIC_CLEAN, "SELECT id, t AS clean FROM t6"),
    "arabic_terms": _sql(ARABIC_CLEAN, DIGEST),
    "generic_terms": _sql(GENERIC, DIGEST),
    "term_counts": _sql(GENERIC, "SELECT id, term, tf FROM tf"),
    "document_frequency": _sql(
        GENERIC,
        "SELECT term, count(*) AS df FROM tf GROUP BY term HAVING df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents)",
    ),
    "vocabulary": _sql(TERMS, f"SELECT term_idx, term, df, {_r('idf')} AS idf FROM vocab"),
    "tfidf_fit_weights": _sql(WEIGHTS, f"SELECT id, term_idx, {_r('weight')} AS weight FROM weights WHERE split = 'train'"),
    "tfidf_new_weights": _sql(
        WEIGHTS,
        f"SELECT p.id, term_idx, {_r('weight')} AS weight FROM parts p LEFT JOIN weights USING (id) WHERE p.split <> 'train'",
    ),
    "tfidf_vectors": _sql(WEIGHTS, VECTOR_DIGEST.format("LEFT")),
    "tfidf_vectors_any_size": _sql(WEIGHTS, VECTOR_DIGEST.format("LEFT")),
    "tfidf_vectors_from_weights": _sql(WEIGHTS, VECTOR_DIGEST.format("")),
    "split_of_embeddings": _sql(EMBEDDED + SPLIT, "SELECT id, label, split FROM parts"),
    "split_of_texts": _sql(LABELLED + SPLIT, "SELECT id, label, split FROM parts"),
    "split_quotas": _sql(LABELLED + QUOTAS, "SELECT * FROM quotas"),
    "final_fit_rows": _sql(LABELLED + SPLIT, "SELECT id, label FROM parts WHERE split IN ('train', 'val')"),
    "centroid_weights": _sql(_dense(), f"SELECT c::INT AS class_id, pos::INT AS pos, {_r(f'm * {HEAD_SCALE}')} AS w FROM means"),
    "head_bias": _sql(_dense(), f"SELECT c::INT AS class_id, {_r('b')} AS b FROM b"),
    "dense_logits": _sql(_dense(where="true"), f"SELECT id, c::INT AS class_id, {_r('z')} AS logit FROM lp"),
    "softmax_probabilities": _sql(DENSE_WHOLE, f"SELECT id, c::INT AS class_id, {_r('p')} AS prob FROM pr"),
    "predicted_class": _sql(DENSE_WHOLE, "SELECT id, pred::INT AS pred FROM scored"),
    "naive_bayes_scores": _sql(
        BAYES_SCORED, f"SELECT pred::INT AS pred, id, c::INT AS class_id, {_r('z', 4)} AS logit FROM lp JOIN scored USING (id)"
    ),
    "scored_new_texts": _sql(NEW_TEXTS, NEW_SCORED.format("")),
    "logreg_grid_choice": "SELECT unnest([0.01, 0.1, 0.5, 1, 2, 5, 10]::DOUBLE[]) AS \"C\", true AS choice_holds",
    "logreg_optimum": _sql(
        TERMS,
        "SELECT (SELECT count(*) FROM parts WHERE split <> 'test') AS n_rows, (SELECT count(*) FROM (SELECT term FROM tf WHERE split <> 'test'"
        " GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM parts WHERE split <> 'test'))) AS n_terms,"
        " 3 AS n_classes, 'driver' AS solver, true AS optimal",
    ),
    "logreg_tables_optimum": _sql(
        TERMS,
        "SELECT (SELECT count(*) FROM parts WHERE split <> 'test') AS n_rows, (SELECT count(*) FROM (SELECT term FROM tf WHERE split <> 'test'"
        " GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM parts WHERE split <> 'test'))) AS n_terms,"
        " 3 AS n_classes, 'tables' AS solver, true AS optimal",
    ),
    "logreg_plans_agree": "SELECT conv_id, turn, true AS same FROM conversations",
    "logreg_introspection_check": _sql(
        LABELLED, f"SELECT id, c::INT AS class_id, {NAME.format('c')} AS class_label, true AS agrees FROM base, range(3) t(c)"
    ),
    "scored_new_texts_any_size": _sql(NEW_TEXTS, NEW_SCORED.format("")),
    "text_model_bias": _sql(BAYES, f"SELECT c::INT AS class_id, {NAME.format('c')} AS class_label, {_r('b')} AS b FROM b"),
    "scored_new_texts_by_join": _sql(NEW_TEXTS, f"SELECT id, c::INT AS class_id, {_r('z')} AS logit FROM lp"),
    "rejected_csv_rows": (
        "SELECT conv_id, turn, role, md5(concat_ws(',', conv_id, turn, role) || ',\"' ||"
        " replace(translate(text, chr(13) || chr(10), '  '), '\"', '\"\"') || '\",more') AS record_md5 FROM conversations WHERE turn % 5 = 0"
    ),
    "outside_scored_new_texts": _sql(OUTSIDE_NEW + SOFT_SHARES, NEW_SHARES),
    "outside_model_metrics": _sql(LABELLED + SPLIT + OUTSIDE_TEST + SOFT_SHARES + ALL_METRICS, OVERALL),
    "scored_csv_written": _sql(NEW_TEXTS, NEW_SCORED.format("md5(text) AS text_md5, ")),
    "scored_lines": _sql(
        LINE_SCORES,
        f"SELECT id, line_no, {NAME.format('pred')} AS \"Pred_Label\", {_r('probs[1]')} AS \"Prob_NEG\","
        f" {_r('probs[2]')} AS \"Prob_POS\", {_r('probs[3]')} AS \"Prob_NEU\" FROM lscored",
    ),
    "prediction_audit": _sql(
        CENTROID_SCORED,
        f"SELECT md5(text) AS text, y AS true_label_id, {NAME.format('y')} AS true_label, pred::INT AS pred_label_id,"
        f" {NAME.format('pred')} AS pred_label, {_r('probs[1]')} AS \"prob_NEG\", {_r('probs[2]')} AS \"prob_POS\","
        f" {_r('probs[3]')} AS \"prob_NEU\" FROM scored JOIN parts USING (id)",
    ),
    "confusion_matrix": _sql(
        DENSE + CELLS,
        "SELECT a.i::INT AS y, b.i::INT AS pred, coalesce(n, 0) AS n FROM range(10) a(i) CROSS JOIN range(10) b(i)"
        " LEFT JOIN cells ON cells.y = a.i AND cells.pred = b.i",
    ),
    "confusion_seen": _sql(CENTROID_SCORED + CELLS, "SELECT y, pred::INT AS pred, n FROM cells"),
    "confusion_wide": _sql(
        CENTROID_SCORED + CELLS,
        "SELECT i::INT AS y, "
        + ", ".join(f"coalesce((SELECT sum(n) FROM cells WHERE y = i AND pred = {k}), 0)::BIGINT AS pred_{k}" for k in range(3))
        + " FROM range(3) t(i)",
    ),
    "accuracy": _sql(DENSE, f"SELECT {_r(MEANS['accuracy'])} AS accuracy"),
    "per_class_metrics": _sql(
        DENSE + CELLS + (("listed", "SELECT i AS c FROM range(10) t(i)"),) + _rates("listed"), PER_CLASS.format("")
    ),
    "per_class_text_report": _sql(
        CENTROID_SCORED + CELLS + (("listed", "SELECT i AS c FROM range(3) t(i)"),) + _rates("listed"),
        PER_CLASS.format(NAME.format("c") + " AS class_label, "),
    ),
    "macro_scores": _sql(
        DENSE + SEEN_RATES, "SELECT " + ", ".join(f"{_r(MEANS[m])} AS {m}" for m in ("precision_macro", "recall_macro", "f1_macro"))
    ),
    "weighted_scores": _sql(
        DENSE + SEEN_RATES,
        "SELECT " + ", ".join(f"{_r(MEANS[m])} AS {m}" for m in ("precision_weighted", "recall_weighted", "f1_weighted")),
    ),
    "log_loss": _sql(DENSE + LOSSES, f"SELECT {_r(MEANS['log_loss'])} AS log_loss"),
    "brier_score": _sql(DENSE + LOSSES, f"SELECT {_r(MEANS['brier_score'])} AS brier_score"),
    "calibration_error": _sql(DENSE + BINS, f"SELECT {_r(ECE)} AS ece_15bins FROM bins"),
    "reliability_table": _sql(
        DENSE + BINS,
        f"SELECT bin::INT AS bin, {_r('(bin + 0.5::DOUBLE) / 15')} AS center, {_r('conf')} AS confidence, {_r('acc')} AS accuracy, n FROM bins",
    ),
    "overall_metrics": _sql(DENSE + ALL_METRICS, OVERALL),
    "detailed_metrics": _recursive(
        _sql(
            DENSE + ALL_METRICS + RESAMPLES,
            OVERALL + f" UNION ALL SELECT 10, 'f1_macro_ci_lo', {_r(LOWER_F1)} UNION ALL SELECT 11, 'f1_macro_ci_hi', {_r(UPPER_F1)}",
        )
    ),
    "bootstrap_interval": _recursive(_sql(DENSE + RESAMPLES, f"SELECT {_r(LOWER_F1)} AS f1_macro_ci_lo, {_r(UPPER_F1)} AS f1_macro_ci_hi")),
    "overall_text_metrics": _sql(CENTROID_SCORED + ALL_METRICS, OVERALL),
    "overall_bayes_metrics": _sql(BAYES_SCORED + ALL_METRICS, OVERALL),
    "classification_report": _sql(
        CENTROID_SCORED + ALL_METRICS + (("size", "SELECT count(*) AS support FROM scored"),),
        f"SELECT 0 AS \"row\", c::INT::VARCHAR AS class, {_r('pre')} AS precision, {_r('rec')} AS recall, {_r('f1')} AS f1, support::BIGINT AS support FROM rates"
        f" UNION ALL SELECT 1, 'accuracy', NULL, NULL, {_r(MEANS['accuracy'])}, support FROM size"
        + "".join(
            f" UNION ALL SELECT {i}, '{m} avg', " + ", ".join(_r(MEANS[f"{k}_{m}"]) for k in ("precision", "recall", "f1")) + ", support FROM size"
            for i, m in ((2, "macro"), (3, "weighted"))
        ),
    ),
    "evaluation_record": _sql(
        CENTROID_SCORED + ALL_METRICS,
        f"SELECT 'centroid' AS name, {_r(MEANS['accuracy'])} AS accuracy, {_r(MEANS['f1_macro'])} AS macro_f1, "
        + ", ".join(f"{_r(MEANS[m])} AS {m}" for m in ("precision_weighted", "recall_weighted", "f1_weighted", "log_loss")),
    ),
    "record_fields": _sql(
        CENTROID_SCORED + ALL_METRICS,
        f"SELECT 'centroid' AS name, {_r(MEANS['accuracy'])} AS accuracy, {_r(MEANS['f1_macro'])} AS macro_f1, "
        + ", ".join(f"{_r(MEANS[m])} AS {m}" for m in ("precision_weighted", "recall_weighted", "f1_weighted", "log_loss")),
    ),
    "quick_metrics": _sql(
        DENSE + SEEN_RATES, f"SELECT {_r(MEANS['accuracy'])} AS accuracy, {_r(MEANS['f1_macro'])} AS f1_macro"
    ),
    "one_vs_rest": _sql(DENSE + ROC, f"SELECT id, c::INT AS class_id, {_r('s')} AS score, pos AS positive FROM ovr"),
    "roc_points": _sql(
        DENSE + ROC, f"SELECT c::INT AS class_id, {_r('s')} AS threshold, {_r('fpr')} AS fpr, {_r('tpr')} AS tpr FROM roc"
    ),
    "auc_per_class": _sql(DENSE + ROC, f"SELECT c::INT AS class_id, {_r('auc')} AS auc FROM aucs"),
    # The rank form: mean rank of the positives among all, equal scores sharing theirs.
    "auc_per_class_bayes": _sql(
        BAYES_SCORED
        + ROC
        + (
            (
                "ranks",
                "SELECT c, pos, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0::DOUBLE AS rk FROM ovr",
            ),
        ),
        f"SELECT c::INT AS class_id, {_r('(sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * sum(1 - pos), 0)')} AS auc FROM ranks GROUP BY c",
    ),
    "macro_auc_interpolated": _sql(DENSE + INTERPOLATED, f"SELECT {_r('sum(a)')} AS macro_auc_interpolated FROM cut"),
    "macro_auc_interpolated_text": _sql(
        CENTROID_SCORED + INTERPOLATED, f"SELECT {_r('sum(a)')} AS macro_auc_interpolated FROM cut"
    ),
    "macro_auc_interpolated_bayes": _sql(
        BAYES_SCORED + INTERPOLATED, f"SELECT {_r('sum(a)')} AS macro_auc_interpolated FROM cut"
    ),
    "macro_auc_ovr": _sql(DENSE + ROC, f"SELECT {_r('avg(auc)')} AS macro_auc_ovr FROM aucs"),
    "majority_baseline": _sql(
        CENTROID_SCORED, "SELECT y AS majority, count(*) AS support FROM scored GROUP BY y ORDER BY support DESC, y LIMIT 1"
    ),
    "paired_correctness": _sql(_pair(DENSE_SQL, SHORT_SQL), "SELECT b, c FROM pair"),
    "mcnemar_statistic": _sql(_pair(DENSE_SQL, SHORT_SQL), f"SELECT b, c, {_r(CHI2)} AS chi2 FROM pair"),
    "mcnemar_p_value": f"SELECT majority, b, c, chi2, p_value FROM ({_baseline('dense', DENSE_SQL)})",
    "baseline_report": " UNION ALL ".join(
        _baseline(n, s) for n, s in (("centroid", CENTROID_SQL), ("bayes", BAYES_SQL), ("dense", DENSE_SQL))
    ),
    "model_pair_report": _sql(
        _pair(CENTROID_SQL, BAYES_SQL),
        f"SELECT {_r(_macro(CENTROID_SCORED))} AS auc_a, {_r(_macro(BAYES_SCORED))} AS auc_b, b, c, {_r(CHI2)} AS chi2, {_r(TAIL.format(CHI2))} AS p_value FROM pair",
    ),
    "text_introspection": _sql(
        _centroid_scored("true"),
        f"SELECT id, c::INT AS class_id, {NAME.format('c')} AS class_label, {_r('z')} AS \"logit_xWT_plus_b\","
        f" {_r('p')} AS prob_from_model_predict_proba, {_r('p')} AS prob_from_manual_softmax FROM pr",
    ),
    "head_introspection": _sql(
        DENSE_WHOLE,
        f"SELECT id, c::INT AS class_id, 'class ' || c AS class_label, {_r('z')} AS logit_from_model, {_r('z')} AS \"logit_manual_W_hCLS_plus_b\","
        f" {_r('p')} AS prob_from_model_softmax, {_r('p')} AS prob_from_manual_softmax FROM pr",
    ),
    "weight_preview": _sql(CENTROID, f"SELECT class_id, term_idx, term, {_r('w')} AS w FROM ({PREVIEW_W})"),
    "weight_preview_wide": _sql(
        CENTROID,
        "SELECT class_id, "
        + ", ".join(f"{_r(f'max(w) FILTER (term_idx = {k})')} AS f{k}" for k in range(10))
        + f" FROM ({PREVIEW_W}) GROUP BY class_id",
    ),
    "dense_weight_preview": _sql(
        _dense(), f"SELECT c::INT AS class_id, pos::INT AS pos, {_r(f'm * {HEAD_SCALE}')} AS w FROM means WHERE c < 5 AND pos < 10"
    ),
    "vector_preview": (
        "SELECT id, size, pos, round(x::DOUBLE, 6) + 0.0 AS value FROM (SELECT vec_id AS id, len(embedding)::INT AS size,"
        " unnest(embedding[1:10]) AS x, (generate_subscripts(embedding[1:10], 1) - 1)::INT AS pos FROM embeddings)"
    ),
    "top_terms": _sql(
        WEIGHTS
        + (("ordered", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, term_idx)::INT AS rk FROM weights"),),
        f"SELECT id, rk AS \"rank\", term_idx AS feature_index, term AS feature_name, {_r('weight')} AS x_value FROM ordered WHERE rk <= 10",
    ),
    "top_terms_any_size": _sql(
        WEIGHTS
        + (("ordered", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, term_idx)::INT AS rk FROM weights"),),
        f"SELECT id, rk AS \"rank\", term_idx AS feature_index, term AS feature_name, {_r('weight')} AS x_value FROM ordered WHERE rk <= 10",
    ),
    "text_introspection_any_size": _sql(
        _centroid_scored("true"),
        f"SELECT id, c::INT AS class_id, {NAME.format('c')} AS class_label, {_r('z')} AS \"logit_xWT_plus_b\","
        f" {_r('p')} AS prob_from_model_predict_proba, {_r('p')} AS prob_from_manual_softmax FROM pr",
    ),
    "weight_preview_by_term": _sql(CENTROID, f"SELECT class_id, term, {_r('w')} AS w FROM ({PREVIEW_W})"),
    "scored_preview": f"SELECT * FROM ({_sql(NEW_TEXTS, NEW_SCORED.format(''))}) ORDER BY conv_id, turn LIMIT 10",
    "written_reports": _sql(
        CENTROID_SCORED + ALL_METRICS,
        f"SELECT 'overall' AS file, metric AS name, value FROM ({OVERALL})"
        f" UNION ALL SELECT 'classes', {NAME.format('c')}, {_r('f1')} FROM rates"
        f" UNION ALL SELECT 'predictions', {NAME.format('y')} || '>' || {NAME.format('pred')}, count(*)::DOUBLE FROM scored GROUP BY y, pred",
    ),
}
