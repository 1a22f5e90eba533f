"""DuckDB SQL for the correctness check of every registered query.

The SQL is written independently of the Spark plans: closed forms where
they exist (Cramer's rule for the 3x3 normal equations, the 2x2 symmetric
eigenproblem, the textbook NMI), and an unrolled chain of CTEs for
Lloyd's iterations. Model constants that cannot be computed in SQL (the
seeded random draws) are inlined as literals.
"""

from __future__ import annotations


def lit(x: float) -> str:
    """Full-precision double literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def dlist(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


# ---------------------------------------------------------------------------
# shared fixtures
# ---------------------------------------------------------------------------

LI = ("li AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS x1, "
      "l_tax AS x2, l_extendedprice / CAST(1000 AS DOUBLE) AS y FROM lineitem)")


LI_FLOAT_LABEL = ("li AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, "
                  "CAST(CAST(l_extendedprice / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS y "
                  "FROM lineitem)")


def li_scaled(base: str = LI) -> str:
    """Centred label, max-abs scaled features (zero max -> 0.0)."""
    return (base + ", st AS (SELECT avg(y) AS mu, max(abs(x0)) AS m0, max(abs(x1)) AS m1, "
            "max(abs(x2)) AS m2 FROM li), "
            "lis AS (SELECT CASE WHEN m0 = 0 THEN 0.0 ELSE x0 / m0 END AS x0, "
            "CASE WHEN m1 = 0 THEN 0.0 ELSE x1 / m1 END AS x1, "
            "CASE WHEN m2 = 0 THEN 0.0 ELSE x2 / m2 END AS x2, y - mu AS y FROM li, st)")


def sparse(d: int) -> str:
    return (f"sp AS (SELECT l_orderkey AS id, CAST(l_suppkey % {d} AS BIGINT) AS j, "
            f"sum(l_quantity) AS x FROM lineitem GROUP BY l_orderkey, l_suppkey % {d})")


EMB = "pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def emb_long() -> str:
    return ("el AS (SELECT vec_id, CAST(unnest(range(len(x))) AS BIGINT) AS j, "
            "unnest(x) AS v FROM pts)")


# ---------------------------------------------------------------------------
# 3x3 normal equations
# ---------------------------------------------------------------------------

def moment_cols(src: str, xs: list[str], ys: dict[str, str]) -> str:
    """``mom`` CTE: n, g_ij (i<=j), b_<name>_i, yy_<name> from ``src``."""
    cols = ["CAST(count(*) AS DOUBLE) AS n"]
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            cols.append(f"sum({xs[i]} * {xs[j]}) AS g{i}{j}")
    for name, y in ys.items():
        cols.append(f"sum(({y}) * ({y})) AS yy_{name}")
        for i, x in enumerate(xs):
            cols.append(f"sum({x} * ({y})) AS b_{name}_{i}")
    return f"mom AS (SELECT {', '.join(cols)} FROM {src})"


def _g(i, j):
    return f"g{min(i, j)}{max(i, j)}"


def _a(i, j, reg):
    return f"({_g(i, j)} + {reg})" if i == j else _g(i, j)


def _det3(c0, c1, c2):
    return (f"(({c0[0]})*(({c1[1]})*({c2[2]}) - ({c1[2]})*({c2[1]}))"
            f" - ({c1[0]})*(({c0[1]})*({c2[2]}) - ({c0[2]})*({c2[1]}))"
            f" + ({c2[0]})*(({c0[1]})*({c1[2]}) - ({c0[2]})*({c1[1]})))")


def solve3_exprs(reg: str, b: list[str]) -> list[str]:
    """w = (G + reg·I)^-1 b by Cramer's rule, G from the ``mom`` columns."""
    cols = [[_a(i, j, reg) for i in range(3)] for j in range(3)]
    det = _det3(*cols)
    out = []
    for k in range(3):
        rep = [c if idx != k else b for idx, c in enumerate(cols)]
        out.append(f"({_det3(*rep)}) / ({det})")
    return out


def sse_expr(w: list[str], name: str = "y") -> str:
    """||Xw - y||² from the moments: w'Gw - 2 w'b + y'y."""
    quad = " + ".join(f"({w[i]})*({w[j]})*{_g(i, j)}" for i in range(3) for j in range(3))
    lin = " + ".join(f"({w[i]})*b_{name}_{i}" for i in range(3))
    return f"(({quad}) - 2*({lin}) + yy_{name})"


def cg_history_sql(src_ctes: str, src: str, gamma: float, digits: int) -> str:
    """Rows t = 0 and t = 2 of the CG history on a 3-feature problem:
    t = 0 is the first CG iterate w1 = alpha0·b, t = 2 the exact solution
    (CG solves a 3x3 system in three steps)."""
    reg = f"n * {lit(gamma)}"
    b = [f"b_y_{i}" for i in range(3)]
    wstar = solve3_exprs(reg, b)
    ab = [" + ".join(f"{_a(i, j, reg)} * {b[j]}" for j in range(3)) for i in range(3)]
    bb = " + ".join(f"{x}*{x}" for x in b)
    bab = " + ".join(f"{b[i]} * ({ab[i]})" for i in range(3))
    return f"""
WITH {src_ctes}, {moment_cols(src, ['x0', 'x1', 'x2'], {'y': 'y'})},
w AS (SELECT *, ({bb}) / ({bab}) AS alpha0,
             {wstar[0]} AS s0, {wstar[1]} AS s1, {wstar[2]} AS s2 FROM mom),
it AS (
  SELECT CAST(0 AS BIGINT) AS iter, n, {reg} AS ng,
         {sse_expr([f'alpha0*{b[i]}' for i in range(3)])} AS sse,
         alpha0*alpha0*({bb}) AS wn FROM w
  UNION ALL
  SELECT CAST(2 AS BIGINT), n, {reg}, {sse_expr(['s0', 's1', 's2'])},
         s0*s0 + s1*s1 + s2*s2 FROM w)
SELECT iter, round((greatest(sse, 0) + ng * wn) / (2 * n), {digits}) AS objective,
       round(greatest(sse, 0) / n, {digits}) AS train_error FROM it"""


def multitask_history_sql(src_ctes: str, src: str, ys: dict[str, str], gamma: float,
                          iters: int = 3, digits: int = 12, tol: float = 1e-8,
                          rel_tol: float = 1e-10) -> str:
    """Block CG on 3 features and len(ys) outputs, unrolled ``iters`` times
    in staged CTEs; rows (iter, residual_sq) up to and including the first
    iteration that meets a stop rule."""
    names = list(ys)
    reg = f"n * {lit(gamma)}"
    first = ["*"]
    for c in names:
        first += [f"b_{c}_{i} AS r0_{c}_{i}" for i in range(3)]
        first += [f"b_{c}_{i} AS p0_{c}_{i}" for i in range(3)]
        first.append(f"({' + '.join(f'b_{c}_{i}*b_{c}_{i}' for i in range(3))}) AS rs0_{c}")
    total0 = " + ".join(f"rs0_{c}" for c in names)
    stages = [f"st0 AS (SELECT {', '.join(first)}, ({total0}) AS tot0 FROM mom)"]
    for t in range(iters):
        a, b = t, t + 1
        ap = {}
        cols = ["*"]
        for c in names:
            for i in range(3):
                ap[(c, i)] = (f"({reg} * p{a}_{c}_{i} + "
                              + " + ".join(f"{_g(i, j)} * p{a}_{c}_{j}" for j in range(3)) + ")")
            pap = " + ".join(f"p{a}_{c}_{i} * {ap[(c, i)]}" for i in range(3))
            cols.append(f"CASE WHEN ({pap}) = 0 OR rs{a}_{c} = 0 THEN 0.0 "
                        f"ELSE rs{a}_{c} / ({pap}) END AS al{a}_{c}")
        stages.append(f"sa{a} AS (SELECT {', '.join(cols)} FROM st{a})")
        cols = ["*"]
        for c in names:
            for i in range(3):
                cols.append(f"r{a}_{c}_{i} - al{a}_{c} * {ap[(c, i)]} AS r{b}_{c}_{i}")
        stages.append(f"sr{a} AS (SELECT {', '.join(cols)} FROM sa{a})")
        cols = ["*"]
        for c in names:
            cols.append(f"({' + '.join(f'r{b}_{c}_{i}*r{b}_{c}_{i}' for i in range(3))}) AS rs{b}_{c}")
        stages.append(f"ss{a} AS (SELECT {', '.join(cols)} FROM sr{a})")
        cols = ["*", f"({' + '.join(f'rs{b}_{c}' for c in names)}) AS tot{b}"]
        for c in names:
            for i in range(3):
                cols.append(f"r{b}_{c}_{i} + (CASE WHEN rs{a}_{c} = 0 THEN 0.0 ELSE rs{b}_{c} / rs{a}_{c} END)"
                            f" * p{a}_{c}_{i} AS p{b}_{c}_{i}")
        stages.append(f"st{b} AS (SELECT {', '.join(cols)} FROM ss{a})")
    rel = lit(rel_tol * rel_tol)

    def stopped(b):
        return f"(tot{b} < {lit(tol)} OR tot{b} <= {rel} * tot0)"

    rows = []
    for t in range(iters):
        earlier = " AND ".join(f"NOT {stopped(b)}" for b in range(1, t + 1)) or "TRUE"
        rows.append(f"SELECT CAST({t} AS BIGINT) AS iter, round(tot{t + 1}, {digits}) AS residual_sq "
                    f"FROM st{iters} WHERE {earlier}")
    return (f"WITH {src_ctes}, {moment_cols(src, ['x0', 'x1', 'x2'], ys)}, "
            + ",\n".join(stages) + "\n" + " UNION ALL ".join(rows))


# ---------------------------------------------------------------------------
# Lloyd's iterations, unrolled
# ---------------------------------------------------------------------------

def sqdist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def kmeans_ctes(k: int, iters: int) -> str:
    """CTEs pts, c0..c{iters} and a{iters}(vec_id, label, prediction, dist)."""
    parts = [EMB,
             f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS cluster, "
             f"x AS center FROM pts ORDER BY vec_id LIMIT {k})"]
    for t in range(1, iters + 2):
        prev = f"c{t - 1}"
        parts.append(
            f"a{t} AS (SELECT p.vec_id, p.label, "
            f"arg_min(c.cluster, [{sqdist_sql('p.x', 'c.center')}, CAST(c.cluster AS DOUBLE)]) AS prediction, "
            f"min({sqdist_sql('p.x', 'c.center')}) AS dist "
            f"FROM pts p, {prev} c GROUP BY p.vec_id, p.label)")
        if t == iters + 1:
            break
        parts.append(
            f"s{t} AS (SELECT a.prediction AS cluster, CAST(unnest(range(len(p.x))) AS BIGINT) AS j, "
            f"unnest(p.x) AS v FROM a{t} a JOIN pts p USING (vec_id))")
        parts.append(
            f"n{t} AS (SELECT cluster, list(m ORDER BY j) AS center FROM "
            f"(SELECT cluster, j, avg(v) AS m FROM s{t} GROUP BY cluster, j) GROUP BY cluster)")
        parts.append(
            f"c{t} AS (SELECT cluster, center FROM n{t} UNION ALL "
            f"SELECT cluster, center FROM {prev} WHERE cluster NOT IN (SELECT cluster FROM n{t}))")
    return ",\n".join(parts)


# ---------------------------------------------------------------------------
# NMI (textbook form)
# ---------------------------------------------------------------------------

def nmi_sql(src_ctes: str, src: str, u: str, v: str, digits: int = 10) -> str:
    return f"""
WITH {src_ctes}{',' if src_ctes else ''}
pair AS (SELECT {u} AS u, {v} AS v FROM {src}),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pair),
pu AS (SELECT u, count(*) / (SELECT n FROM tot) AS p FROM pair GROUP BY u),
pv AS (SELECT v, count(*) / (SELECT n FROM tot) AS p FROM pair GROUP BY v),
puv AS (SELECT u, v, count(*) / (SELECT n FROM tot) AS p FROM pair GROUP BY u, v),
mi AS (SELECT greatest(sum(puv.p * ln(puv.p / (pu.p * pv.p))), 0.0) AS mi
       FROM puv JOIN pu USING (u) JOIN pv USING (v)),
h AS (SELECT (SELECT CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum(p * ln(p)) END FROM pu) AS h_u,
             (SELECT CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum(p * ln(p)) END FROM pv) AS h_v),
r AS (SELECT mi, h_u, h_v FROM mi, h)
SELECT round(mi, {digits}) AS mi, round(h_u, {digits}) AS h_u, round(h_v, {digits}) AS h_v,
  round(CASE WHEN h_u = 0 AND h_v = 0 THEN 1.0
             WHEN mi = 0 OR h_u = 0 OR h_v = 0 THEN 0.0
             ELSE mi / sqrt(h_u * h_v) END, {digits}) AS nmi_geometric,
  round(CASE WHEN h_u = 0 AND h_v = 0 THEN 1.0
             WHEN mi = 0 OR h_u = 0 OR h_v = 0 THEN 0.0
             ELSE 2 * mi / (h_u + h_v) END, {digits}) AS nmi_arithmetic
FROM r"""


# ---------------------------------------------------------------------------
# 2x2 SVD closed form on part [p_size, p_retailprice/100]
# ---------------------------------------------------------------------------

PART2 = ("pp AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, "
         "p_retailprice / CAST(100 AS DOUBLE) AS x1 FROM part)")

SVD2 = PART2 + """,
g AS (SELECT sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x1*x1) AS c FROM pp),
e AS (SELECT a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
             (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM g),
raw AS (SELECT l1, l2, b AS u0, l1 - a AS u1, b AS t0, l2 - a AS t1 FROM e),
nv AS (SELECT l1, l2, u0 / sqrt(u0*u0 + u1*u1) AS u0, u1 / sqrt(u0*u0 + u1*u1) AS u1,
              t0 / sqrt(t0*t0 + t1*t1) AS t0, t1 / sqrt(t0*t0 + t1*t1) AS t1 FROM raw),
v AS (SELECT sqrt(l1) AS s1, sqrt(greatest(l2, 0)) AS s2,
        CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -u0 ELSE u0 END AS v00,
        CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -u1 ELSE u1 END AS v10,
        CASE WHEN (CASE WHEN abs(t0) >= abs(t1) THEN t0 ELSE t1 END) < 0 THEN -t0 ELSE t0 END AS v01,
        CASE WHEN (CASE WHEN abs(t0) >= abs(t1) THEN t0 ELSE t1 END) < 0 THEN -t1 ELSE t1 END AS v11
      FROM nv)"""


__all__ = ["lit", "dlist", "LI", "LI_FLOAT_LABEL", "li_scaled", "sparse", "EMB", "emb_long", "moment_cols",
           "solve3_exprs", "sse_expr", "cg_history_sql", "multitask_history_sql", "kmeans_ctes", "nmi_sql",
           "sqdist_sql", "PART2", "SVD2"]
