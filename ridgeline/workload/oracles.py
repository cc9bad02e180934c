"""DuckDB oracle SQL for the registered queries (same names, columns and rounding).

One-pass operators repeat the arithmetic in SQL.  Fits are checked against
independent solutions: gradient descent step by step in ``WITH RECURSIVE``;
least squares by the normal equations (Cramer's rule); logistic regression by
Newton steps in ``WITH RECURSIVE``.
"""

from __future__ import annotations

from ridgeline.plans.gd import BATCH_MIX, BATCH_PRIME
from ridgeline.workload import queries as Q
from ridgeline.workload.fixtures import LIN3, LIN_NET, LIN_RAW, LOG2, LOG_SIG, SPLIT_KEY, SPLIT_PARTS, Fixture

NEWTON_STEPS = 30


def R(expr: str, k: int) -> str:
    return f"(round({expr}, {k}) + 0.0)"


def lit(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def points(fx: Fixture, where: str | None = None, keys: bool = False) -> str:
    """``y, x1..xd`` (bias last) as DOUBLE, rows with NULLs dropped, like the Spark design."""
    cols = [f"CAST(({fx.label}) AS DOUBLE) AS y"]
    cols += [f"CAST(({e}) AS DOUBLE) AS x{j + 1}" for j, (_, e) in enumerate(fx.features)]
    if fx.bias:
        cols.append(f"CAST(1.0 AS DOUBLE) AS x{len(fx.features) + 1}")
    if keys:
        cols = ["CAST(l_orderkey AS BIGINT) AS l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber",
                f"({SPLIT_KEY}) AS split_key"] + cols
    conds = [f"({fx.label}) IS NOT NULL"] + [f"({e}) IS NOT NULL" for _, e in fx.features]
    if where:
        conds.append(f"({where})")
    return f"SELECT {', '.join(cols)} FROM {fx.table} WHERE {' AND '.join(conds)}"


def dot(w, prefix: str = "") -> str:
    """``w1*x1 + w2*x2 + ...`` summed left to right, like the Spark expression."""
    return "(" + " + ".join(f"({lit(v)} * {prefix}x{j + 1})" for j, v in enumerate(w)) + ")"


def rows(items: list[tuple[int, str, str]], source: str, value: str) -> str:
    """One row per feature from one aggregate row: ``(feature_index, feature, value)``."""
    parts = [
        f"SELECT CAST({j} AS BIGINT) AS feature_index, '{name}' AS feature, {expr} AS {value} FROM {source}"
        for j, name, expr in items
    ]
    return " UNION ALL ".join(parts)


def squared_term(m: str, y: str = "y") -> str:
    return f"(({m} - {y}) * ({m} - {y}) * 0.5)"


def logistic_term(m: str, y: str = "y") -> str:
    return f"(greatest({m}, 0.0) + ln(1 + exp(-abs({m}))) - {y} * {m})"


def logistic_slope(m: str, y: str = "y") -> str:
    return f"(1.0 / (1.0 + exp(-{m})) - {y})"


# --- S, P ---------------------------------------------------------------------
def o_labeled_points() -> str:
    return (
        f"SELECT l_orderkey, l_linenumber, {R('y', 9)} AS label, {R('x1', 9)} AS qty, {R('x2', 9)} AS disc, "
        f"x3 AS bias FROM ({points(LIN3, keys=True)})"
    )


def o_libsvm_scan() -> str:
    src = f"({points(LIN3)})"
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS feature_index, count(*) AS n, {R(f'sum({c})', 6)} AS total FROM {src}"
        for i, c in [(-1, "y"), (0, "x1"), (1, "x2")]
    )


def o_binarize_label() -> str:
    return (
        "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, "
        "CASE WHEN label IS NULL THEN NULL WHEN label = 2 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END "
        "AS label_bin FROM embeddings"
    )


def o_append_bias() -> str:
    return (
        "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS feature_index, "
        "unnest(arr) AS value FROM (SELECT vec_id, list_append(CAST(embedding AS DOUBLE[]), CAST(1.0 AS DOUBLE)) "
        "AS arr FROM embeddings WHERE embedding IS NOT NULL)"
    )


def o_random_split() -> str:
    return f"SELECT count(*) AS n_total, CAST(0 AS BIGINT) AS n_overlap, true AS share_ok FROM ({points(LIN3)})"


def o_key_split() -> str:
    return (
        f"SELECT CASE WHEN split_key % {SPLIT_PARTS} = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, "
        f"{R('sum(y)', 6)} AS label_sum FROM ({points(LIN3, keys=True)}) GROUP BY 1"
    )


# --- E ------------------------------------------------------------------------
def o_linear_margin() -> str:
    return f"SELECT l_orderkey, l_linenumber, {R(dot(Q.W_LIN), 9)} AS margin FROM ({points(LIN3, keys=True)})"


def o_squared_loss_terms() -> str:
    m = dot(Q.W_LIN)
    grads = ", ".join(f"{R(f'(({m}) - y) * x{j + 1}', 9)} AS grad_{n}" for j, n in enumerate(LIN3.names))
    return f"SELECT l_orderkey, l_linenumber, {R(squared_term(m), 9)} AS loss, {grads} FROM ({points(LIN3, keys=True)})"


def o_logistic_loss_terms() -> str:
    m = dot(Q.W_LOG)
    return (
        f"SELECT l_orderkey, l_linenumber, {R(logistic_term(m), 9)} AS loss, {R(logistic_slope(m), 9)} AS slope "
        f"FROM ({points(LOG2, keys=True)})"
    )


def o_predict_linear() -> str:
    return (
        f"SELECT l_orderkey, l_linenumber, {R('y', 9)} AS label, {R(dot(Q.W_LIN), 9)} AS prediction "
        f"FROM ({points(LIN3, keys=True)})"
    )


def o_predict_logistic() -> str:
    p = f"(1.0 / (1.0 + exp(-{dot(Q.W_SIG)})))"
    return (
        f"SELECT l_orderkey, l_linenumber, y AS label, {R(p, 9)} AS probability, "
        f"CASE WHEN {p} > 0.5 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS prediction "
        f"FROM ({points(LOG_SIG, keys=True)})"
    )


# --- A ------------------------------------------------------------------------
def o_loss_ls() -> str:
    return f"SELECT count(*) AS n, {R(f'avg({squared_term(dot(Q.W_LIN))})', 9)} AS loss FROM ({points(LIN3)})"


def o_loss_logistic() -> str:
    return f"SELECT count(*) AS n, {R(f'avg({logistic_term(dot(Q.W_LOG))})', 9)} AS loss FROM ({points(LOG2)})"


def _gradient(fx: Fixture, w, slope: str) -> str:
    m = dot(w)
    s = slope.format(m=m)
    aggs = ", ".join(f"avg({s} * x{j + 1}) AS g{j + 1}" for j in range(len(fx.names)))
    src = f"(SELECT {aggs} FROM ({points(fx)}))"
    return rows([(j, n, R(f"g{j + 1}", 9)) for j, n in enumerate(fx.names)], src, "gradient")


def o_gradient_ls() -> str:
    return _gradient(LIN3, Q.W_LIN, "(({m}) - y)")


def o_gradient_logistic() -> str:
    return _gradient(LOG2, Q.W_LOG, logistic_slope("{m}"))


def o_gradient_array_form() -> str:
    w = Q.emb_weights()
    dim = len(w) - 1
    m = "(" + " + ".join(f"({lit(v)} * x[{j + 1}])" for j, v in enumerate(w[:-1])) + f" + ({lit(w[-1])} * 1.0))"
    pts = (
        "SELECT CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 2 THEN 0.0 ELSE 1.0 END AS y "
        "FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL"
    )
    s = f"(SELECT x, {logistic_slope(m)} AS s FROM ({pts}))"
    per = (
        f"SELECT CAST(i - 1 AS BIGINT) AS feature_index, 'x' || CAST(i - 1 AS VARCHAR) AS feature, "
        f"{R('avg(s * x[i])', 9)} AS gradient FROM {s}, range(1, {dim + 1}) r(i) GROUP BY i"
    )
    bias = f"SELECT CAST({dim} AS BIGINT) AS feature_index, 'bias' AS feature, {R('avg(s)', 9)} AS gradient FROM {s}"
    return f"{per} UNION ALL {bias}"


def o_gradient_vector_form() -> str:
    return o_gradient_array_form()


def o_gradient_wide_columns() -> str:
    return o_gradient_array_form()


def o_gradient_wide_named() -> str:
    pts = (
        "SELECT vec_id, [pow(CAST(embedding[(j % 64) + 1] AS DOUBLE), (j // 64) + 1) for j in range(320)] AS x, "
        "CASE WHEN label = 2 THEN 0.0 ELSE 1.0 END AS y FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL"
    )
    w = "[((j % 7) - 3) / 100.0 for j in range(320)]"
    m = f"(list_dot_product(x, CAST({w} AS DOUBLE[])) + 0.05)"
    return (
        f"WITH s AS (SELECT x, {logistic_slope(m)} AS s FROM ({pts})) "
        f"SELECT CAST(i AS BIGINT) AS feature_index, 'e' || (i % 64) || '_p' || (i // 64) AS feature, {R('avg(s * x[i + 1])', 9)} AS gradient "
        f"FROM s, range(320) r(i) GROUP BY i UNION ALL SELECT CAST(320 AS BIGINT), 'bias', {R('avg(s)', 9)} FROM s"
    )


def o_dirty_rows_array() -> str:
    cells = [
        "CAST(embedding[1] AS DOUBLE)",
        "CASE WHEN vec_id % 5 <> 1 THEN CAST(embedding[2] AS DOUBLE) END",
        "CASE WHEN vec_id % 7 <> 2 THEN CAST(embedding[3] AS DOUBLE) END",
    ]
    x = ", ".join(f"CASE WHEN vec_id % 11 <> 3 THEN {c} END AS x{j + 1}" for j, c in enumerate(cells))
    pts = f"SELECT {x}, CASE WHEN vec_id % 13 <> 4 AND label IS NOT NULL THEN CASE WHEN label = 2 THEN 0.0 ELSE 1.0 END END AS y FROM embeddings"
    good = "x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL"
    m = "(0.5 * x1 - 0.25 * x2 + 0.125 * x3 + 0.05)"
    terms = " UNION ALL ".join(
        f"SELECT CAST({j} AS BIGINT) AS feature_index, '{n}' AS feature, {R(f'avg(s * {x})', 9)} AS gradient FROM s"
        for j, (n, x) in enumerate((("x0", "x1"), ("x1", "x2"), ("x2", "x3"), ("bias", "1.0")))
    )
    return (
        f"WITH p AS ({pts}), s AS (SELECT *, {logistic_slope(m)} AS s FROM p WHERE {good}), "
        f"k AS (SELECT CAST(count(*) FILTER (NOT coalesce({good}, false)) AS BIGINT) AS dropped_rows FROM p) "
        f"SELECT kind, g.*, dropped_rows FROM ({terms}) g, k, (VALUES ('array'), ('columns')) v(kind)"
    )


def o_gradient_sparse() -> str:
    m = "z"
    return (
        "WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), "
        "c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS y, CAST('0x' || substr(md5(w), 1, 5) AS BIGINT) AS i, count(*) AS v FROM w GROUP BY ALL), "
        f"s AS (SELECT doc_id, {logistic_slope(m)} AS s FROM (SELECT doc_id, y, sum(v * ((i % 7) - 3) / 1000.0) AS z FROM c GROUP BY doc_id, y)) "
        f"SELECT i AS feature_index, {R('sum(s * v) / (SELECT count(*) FROM s)', 9)} AS gradient FROM c JOIN s USING (doc_id) GROUP BY i"
    )


def _words(digits: int) -> str:
    """``c(doc_id, y, i, v)``: the counts of hashed words."""
    return (
        "w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), "
        f"c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS y, CAST('0x' || substr(md5(w), 1, {digits}) AS BIGINT) AS i, count(*) AS v FROM w GROUP BY ALL)"
    )


def _wide_words() -> str:
    return f"{_words(Q.WIDE_DIGITS)}, e AS (SELECT doc_id, y, i, v / sum(v) OVER (PARTITION BY doc_id) AS v FROM c), n AS (SELECT count(DISTINCT doc_id) AS n FROM e)"


def o_wide_gradient() -> str:
    return (
        f"WITH {_wide_words()}, s AS (SELECT doc_id, {logistic_slope('z')} AS s FROM (SELECT doc_id, y, sum(v * ((i % 7) - 3) / 10.0) AS z FROM e GROUP BY doc_id, y)) "
        f"SELECT i AS feature_index, {R('sum(s * v) / any_value(n)', 9)} AS gradient FROM e JOIN s USING (doc_id), n GROUP BY i"
    )


def _wide_gd(steps: list[float], ridge: float, digits: int) -> str:
    """Gradient descent, a group by feature per step."""
    ctes = [_wide_words(), "w0 AS (SELECT DISTINCT i, CAST(0.0 AS DOUBLE) AS w FROM e)"]
    for k, step in enumerate(steps):
        ctes.append(f"s{k} AS (SELECT doc_id, {logistic_slope('z')} AS s FROM (SELECT doc_id, y, sum(v * w) AS z FROM e JOIN w{k} USING (i) GROUP BY doc_id, y))")
        ctes.append(f"w{k + 1} AS (SELECT i, any_value(w) - {lit(step)} * (sum(s * v) / any_value(n) + {lit(ridge)} * any_value(w)) AS w FROM e JOIN s{k} USING (doc_id) JOIN w{k} USING (i), n GROUP BY i)")
    return f"WITH {', '.join(ctes)} SELECT i AS feature_index, {R('w', digits)} AS weight FROM w{len(steps)}"


def o_wide_gd_fit() -> str:
    return _wide_gd([Q.WIDE_STEP / (k + 1) ** 0.5 for k in range(Q.WIDE_STEPS)], 0.0, 9)


def o_wide_cg_fit() -> str:
    """Steps of 0.9: the curvature lies between the ridge term's 1 and 1.25."""
    return _wide_gd([0.9] * 14, Q.WIDE_RIDGE, 6)


def _alphas(values) -> str:
    return "(VALUES " + ", ".join(f"({lit(a)})" for a in values) + ") a(alpha)"


def o_directional_derivative() -> str:
    zp = f"SELECT {dot(Q.W_LIN)} AS z, {dot(Q.D_LIN)} AS p, y FROM ({points(LIN3)})"
    return (
        f"SELECT a.alpha AS alpha, {R('avg(((t.z + a.alpha * t.p) - t.y) * t.p)', 9)} AS slope "
        f"FROM ({zp}) t, {_alphas(Q.ALPHAS_LIN)} GROUP BY a.alpha"
    )


def o_line_search_profile() -> str:
    zp = f"SELECT {dot(Q.W_LOG)} AS z, {dot(Q.D_LOG)} AS p, y FROM ({points(LOG2)})"
    m = "(t.z + a.alpha * t.p)"
    prof = (
        f"SELECT a.alpha AS alpha, avg({logistic_term(m, 't.y')}) AS f, avg({logistic_slope(m, 't.y')} * t.p) AS s "
        f"FROM ({zp}) t, {_alphas((0.0,) + tuple(Q.ALPHAS_LOG))} GROUP BY a.alpha"
    )
    return (
        f"WITH prof AS ({prof}), base AS (SELECT f AS f0, s AS s0 FROM prof WHERE alpha = 0) "
        f"SELECT alpha, {R('f', 9)} AS loss, {R('s', 9)} AS slope, "
        f"f <= f0 + 0.0001 * alpha * s0 AS armijo_ok, abs(s) <= -0.1 * s0 AS curvature_ok "
        f"FROM prof, base WHERE alpha <> 0"
    )


def o_mse() -> str:
    return (
        f"SELECT count(*) AS n, {R(f'avg(power({dot(Q.W_NET)} - y, 2))', 9)} AS mse FROM ({points(LIN_NET)})"
    )


def _accuracy(w: str, src: str) -> str:
    """Accuracy of weights ``w1, w2`` (columns of ``w``) on rows of ``src``."""
    p = "(1.0 / (1.0 + exp(-((w.w1 * t.x1) + (w.w2 * t.x2)))))"
    pred = f"CASE WHEN {p} > 0.5 THEN 1.0 ELSE 0.0 END"
    return (
        f"SELECT count(*) AS n, {R(f'avg(CASE WHEN {pred} = t.y THEN 1.0 ELSE 0.0 END)', 9)} AS accuracy "
        f"FROM ({src}) t, ({w}) w"
    )


def o_accuracy() -> str:
    w = f"SELECT {lit(Q.W_SIG[0])} AS w1, {lit(Q.W_SIG[1])} AS w2"
    return _accuracy(w, points(LOG_SIG, where=f"({SPLIT_KEY}) % {SPLIT_PARTS} = 0"))


# --- F: fits ------------------------------------------------------------------
def _gd_cte(fx: Fixture, step: float, tol: float, max_iter: int, check_from: int, slope: str = "({z} - p.y)", pts: str | None = None, drawn: str = "true") -> str:
    d = len(fx.names)
    ws = [f"w{j + 1}" for j in range(d)]
    margin = "(" + " + ".join(f"(g.w{j + 1} * p.x{j + 1})" for j in range(d)) + ")"
    new = ", ".join(
        f"g.w{j + 1} - ({lit(step)} / sqrt(g.it + 1)) * avg({slope.format(z=margin)} * p.x{j + 1}) AS w{j + 1}"
        for j in range(d)
    )
    olds = ", ".join(f"g.w{j + 1} AS o{j + 1}" for j in range(d))
    diff = " + ".join(f"(o{j + 1} - w{j + 1}) * (o{j + 1} - w{j + 1})" for j in range(d))
    norm = " + ".join(f"w{j + 1} * w{j + 1}" for j in range(d))
    zeros = ", ".join("CAST(0.0 AS DOUBLE)" for _ in ws)
    return (
        f"WITH RECURSIVE pts AS ({pts or points(fx)}), "
        f"gd(it, {', '.join(ws)}, done) AS ("
        f"SELECT 0, {zeros}, false "
        f"UNION ALL "
        f"SELECT it, {', '.join(ws)}, "
        f"(it >= {check_from}) AND sqrt({diff}) < {lit(tol)} * greatest(sqrt({norm}), 1.0) "
        f"FROM (SELECT g.it + 1 AS it, {olds}, {new} FROM gd g, pts p "
        f"WHERE NOT g.done AND g.it < {max_iter} AND {drawn} GROUP BY g.it, {', '.join('g.' + w for w in ws)}) s)"
    )


def _gd_weights(fx: Fixture, step, tol, max_iter, check_from, slope: str = "({z} - p.y)", pts: str | None = None, drawn: str = "true") -> str:
    cte = _gd_cte(fx, step, tol, max_iter, check_from, slope, pts, drawn)
    last = "(SELECT * FROM gd WHERE it = (SELECT max(it) FROM gd))"
    body = rows([(j, n, R(f"w{j + 1}", 6)) for j, n in enumerate(fx.names)], last, "weight")
    return f"{cte} SELECT feature_index, feature, weight, CAST((SELECT max(it) FROM gd) AS BIGINT) AS iterations FROM ({body})"


def o_gd_fit() -> str:
    return _gd_weights(LIN3, Q.GD_STEP, Q.GD_TOL, Q.GD_MAX, 1)


def o_gd_passes_fit() -> str:
    return o_gd_fit()


def o_gd_history() -> str:
    cte = _gd_cte(LIN3, Q.GD_STEP, Q.GD_TOL, Q.GD_MAX, 1)
    parts = " UNION ALL ".join(
        f"SELECT CAST(it AS BIGINT) AS iteration, CAST({j} AS BIGINT) AS feature_index, {R(f'w{j + 1}', 6)} AS weight "
        f"FROM gd WHERE it > 0"
        for j in range(len(LIN3.names))
    )
    return f"{cte} {parts}"


def o_gd_baseline_fit() -> str:
    return _gd_weights(LIN_RAW, Q.STOCK_STEP, Q.STOCK_TOL, Q.STOCK_MAX, 2)


def o_linear_baseline_fit() -> str:
    return _gd_weights(LIN_NET, Q.SGD_STEP, 1e-3, Q.SGD_MAX, 2)


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


def _normal_equations(fx: Fixture) -> str:
    """Least-squares weights of a 3-weight fixture by Cramer's rule: ``SELECT w1, w2, w3``."""
    assert len(fx.names) == 3
    aggs = [f"avg(x{i} * x{j}) AS a{i}{j}" for i in range(1, 4) for j in range(1, 4)]
    aggs += [f"avg(x{i} * y) AS b{i}" for i in range(1, 4)]
    mom = f"(SELECT {', '.join(aggs)} FROM ({points(fx)}))"
    A = [[f"a{i}{j}" for j in range(1, 4)] for i in range(1, 4)]
    det = _det3(A)
    sol = []
    for k in range(3):
        Ak = [[(f"b{i + 1}" if j == k else A[i][j]) for j in range(3)] for i in range(3)]
        sol.append(f"{_det3(Ak)} / {det} AS w{k + 1}")
    return f"SELECT {', '.join(sol)} FROM {mom}"


def o_cg_linear_fit() -> str:
    w = f"({_normal_equations(LIN_NET)})"
    return rows([(j, n, R(f"w{j + 1}", 6)) for j, n in enumerate(LIN_NET.names)], w, "weight")


def o_cg_linear_passes_fit() -> str:
    return o_cg_linear_fit()


def o_ml_linear_fit() -> str:
    return o_cg_linear_fit()


def o_cg_linear_wolfe_fit() -> str:
    w = f"({_normal_equations(LIN_NET)})"
    return rows([(j, n, R(f"w{j + 1}", 5)) for j, n in enumerate(LIN_NET.names)], w, "weight")


def o_linear_final_loss() -> str:
    """Around the means, so that the level of the labels does not drown the residuals."""
    return (
        "WITH p AS (SELECT l_quantity / 50 AS x, l_quantity * 0.5 + 0.001 * (l_linenumber % 3) AS y FROM lineitem), "
        "m AS (SELECT avg(x) AS mx, avg(y) AS my FROM p), "
        "c AS (SELECT avg((x - mx) * (x - mx)) AS xx, avg((x - mx) * (y - my)) AS xy FROM p, m) "
        "SELECT count(*) AS n, round(avg(0.5 * power((y - my) - xy / xx * (x - mx), 2)) * 1e7, 1) AS loss_e7 FROM p, m, c"
    )


def _newton(fx: Fixture, lam: float, where: str | None = None) -> str:
    """Logistic weights (one feature + bias) by Newton steps: ``SELECT w1, w2``."""
    assert len(fx.names) == 2
    P = "(1.0 / (1.0 + exp(-((n.w1 * p.x1) + (n.w2 * p.x2)))))"
    L = lit(lam)
    inner = (
        f"SELECT n.it, n.w1, n.w2, "
        f"avg(({P} - p.y) * p.x1) + {L} * n.w1 AS g1, avg({P} - p.y) + {L} * n.w2 AS g2, "
        f"avg({P} * (1 - {P}) * p.x1 * p.x1) + {L} AS h11, avg({P} * (1 - {P}) * p.x1) AS h12, "
        f"avg({P} * (1 - {P})) + {L} AS h22 "
        f"FROM nt n, pts p WHERE n.it < {NEWTON_STEPS} GROUP BY n.it, n.w1, n.w2"
    )
    return (
        f"WITH RECURSIVE pts AS ({points(fx, where=where)}), nt(it, w1, w2) AS ("
        f"SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) UNION ALL "
        f"SELECT it + 1, w1 - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), "
        f"w2 - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM ({inner}) s) "
        f"SELECT w1, w2 FROM nt WHERE it = {NEWTON_STEPS}"
    )


def _newton_rows(fx: Fixture, lam: float) -> str:
    return rows([(j, n, R(f"w{j + 1}", 3)) for j, n in enumerate(fx.names)], f"({_newton(fx, lam)})", "weight")


def o_cg_logistic_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_cg_logistic_l2_fit() -> str:
    return _newton_rows(LOG_SIG, Q.RIDGE)


def o_cg_logistic_search_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_cg_logistic_sequential_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_cg_fit_report() -> str:
    m = "((w.w1 * t.x1) + (w.w2 * t.x2))"
    return (
        f"SELECT 'cg_logistic' AS method, count(*) AS n_rows, CAST(2 AS BIGINT) AS dim, true AS converged, true AS passes_add_up, "
        f"true AS losses_add_up, {R(f'avg({logistic_term(m, "t.y")})', 6)} AS final_loss, CAST(0 AS BIGINT) AS dropped_rows "
        f"FROM ({points(LOG_SIG)}) t, ({_newton(LOG_SIG, 0.0)}) w"
    )


def o_cg_array_fit() -> str:
    """Ridge logistic weights of the 64 embedding entries and the bias, by gradient descent over lists."""
    pts = (
        "SELECT list_append(CAST(embedding AS DOUBLE[]), 1.0::DOUBLE) AS x, CASE WHEN label = 2 THEN 0.0 ELSE 1.0 END AS y "
        "FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL"
    )
    slope = logistic_slope("list_dot_product(p.x, g.w)", "p.y")
    return (
        f"WITH RECURSIVE pts AS ({pts}), gd(it, w) AS (SELECT 0, CAST([0.0 for j in range(65)] AS DOUBLE[]) UNION ALL "
        f"SELECT it + 1, list(v ORDER BY i) FROM ("
        f"SELECT it, i, any_value(wi) - 2.0 * (avg(s * xi) + {lit(Q.RIDGE)} * any_value(wi)) AS v FROM ("
        f"SELECT g.it AS it, {slope} AS s, unnest(p.x) AS xi, unnest(g.w) AS wi, unnest(range(65)) AS i FROM gd g, pts p WHERE g.it < 150) GROUP BY it, i) GROUP BY it) "
        f"SELECT CAST(i AS BIGINT) AS feature_index, CASE WHEN i = 64 THEN 'bias' ELSE 'x' || i END AS feature, {R('wi', 3)} AS weight "
        f"FROM (SELECT unnest(w) AS wi, unnest(range(65)) AS i FROM gd WHERE it = 150)"
    )


def _descent(label: str, features: dict[str, str], slope: str, curve: float, step: str, rounds: int, digits: int) -> str:
    """Coordinate descent, one weight per row of the recursion: ``step`` maps (w - g/h) in ``{v}`` with bound ``{h}`` on its curvature."""
    names = [*features, "bias"]
    d = len(names)
    pts = f"SELECT CAST({label} AS DOUBLE) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS x{j + 1}' for j, e in enumerate(features.values()))}, CAST(1.0 AS DOUBLE) AS x{d} FROM lineitem"
    z = "(" + " + ".join(f"g.w{j + 1} * p.x{j + 1}" for j in range(d)) + ")"
    ws = ", ".join(f"w{j + 1}" for j in range(d))
    xj = "CASE g.it % " + str(d) + " " + " ".join(f"WHEN {j} THEN p.x{j + 1}" for j in range(d)) + " END"
    sums = f"SELECT g.it, {', '.join(f'g.w{j + 1}' for j in range(d))}, avg({slope.format(z=z, y='p.y')} * {xj}) AS g, {curve!r} * avg(({xj}) * ({xj})) AS h FROM cd g, pts p WHERE g.it < {d * rounds} GROUP BY g.it, {', '.join(f'g.w{j + 1}' for j in range(d))}"
    new = ", ".join(f"CASE WHEN it % {d} = {j} THEN {step.format(v=f'(w{j + 1} - g / h)', h='h')} ELSE w{j + 1} END" for j in range(d))
    body = rows([(j, n, R(f"w{j + 1}", digits)) for j, n in enumerate(names)], f"(SELECT * FROM cd WHERE it = {d * rounds})", "weight")
    zeros = ", ".join("CAST(0.0 AS DOUBLE)" for _ in names)
    return f"WITH RECURSIVE pts AS ({pts}), cd(it, {ws}) AS (SELECT 0, {zeros} UNION ALL SELECT it + 1, {new} FROM ({sums}) s) {body}"


def o_cg_logistic_l1_fit() -> str:
    soft = f"sign({{v}}) * greatest(abs({{v}}) - {lit(Q.L1_WEIGHT)} / {{h}}, 0.0)"
    return _descent(LOG_SIG.label, Q.LOG_SIG3, logistic_slope("{z}", "{y}"), 0.25, soft, 250, 4)


def o_cg_logistic_bounds_fit() -> str:
    return _descent(LOG_SIG.label, Q.LOG_SIG3, logistic_slope("{z}", "{y}"), 0.25, f"least({lit(Q.BOUND[1])}, greatest({lit(Q.BOUND[0])}, {{v}}))", 250, 4)


def o_huber_cg_fit() -> str:
    d = lit(Q.HUBER_DELTA)
    return _descent(LIN_NET.label, dict(LIN_NET.features), f"greatest(-{d}, least({d}, {{z}} - {{y}}))", 1.0, "{v}", 500, 4)


def o_hinge_gd_fit() -> str:
    return _gd_weights(LOG_SIG, Q.HINGE_STEP, 0.0, Q.HINGE_STEPS, 1, "CASE WHEN (2.0 * p.y - 1.0) * {z} < 1.0 THEN 1.0 - 2.0 * p.y ELSE 0.0 END")


def o_sgd_minibatch_fit() -> str:
    p, (m1, m2) = BATCH_PRIME, BATCH_MIX
    digest = f"md5('{Q.BATCH_SEED}:' || CAST(split_key AS VARCHAR))"
    hashes = ", ".join(f"CAST('0x' || substr({digest}, {at}, 8) AS BIGINT) AS {c}" for c, at in (("a", 1), ("b", 9)))
    pts = f"SELECT *, {hashes} FROM ({points(LIN3, keys=True)})"
    drawn = f"(xor((xor(p.a, (g.it + 1) * 2654435769 % 4294967296) * {m1}) % {p}, p.b) * {m2}) % {p} < {int(Q.BATCH * p)}"
    return _gd_weights(LIN3, Q.GD_STEP, 0.0, Q.BATCH_STEPS, 1, pts=pts, drawn=drawn)


def o_lbfgs_own_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_lbfgs_sparse_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_libsvm_sparse_mse() -> str:
    return o_linear_pipeline_mse()


def o_sparse_logistic_accuracy() -> str:
    return o_logistic_pipeline_accuracy()


def o_libsvm_infer() -> str:
    return (
        f"WITH {_words(5)} SELECT count(DISTINCT doc_id) AS n, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0 AND doc_id % 9 < 7) AS damaged, "
        f"max(i) + 1 AS num_features, count(*) AS entries FROM c"
    )


def o_lbfgs_logistic_fit() -> str:
    return _newton_rows(LOG_SIG, 0.0)


def o_linear_pipeline_mse() -> str:
    w = _normal_equations(LIN_NET)
    pred = "((w.w1 * t.x1) + (w.w2 * t.x2) + (w.w3 * t.x3))"
    return (
        f"SELECT count(*) AS n, {R(f'avg(power({pred} - t.y, 2))', 9)} AS mse "
        f"FROM ({points(LIN_NET)}) t, ({w}) w"
    )


def o_logistic_pipeline_accuracy() -> str:
    train = f"({SPLIT_KEY}) % {SPLIT_PARTS} <> 0"
    test = f"({SPLIT_KEY}) % {SPLIT_PARTS} = 0"
    return _accuracy(_newton(LOG_SIG, 0.0, where=train), points(LOG_SIG, where=test))


ORACLES = {
    name[2:]: fn
    for name, fn in list(globals().items())
    if name.startswith("o_") and callable(fn)
}


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLES.items()}
