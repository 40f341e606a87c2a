"""SQL for DuckDB that states what each catalog query must return.

Written from the definitions of the operators: positions by ``row_number`` over the whole
table, running sums by plain windows, trees unrolled level by level.
"""

from __future__ import annotations

from quietgrove.functions import risk_tables as rt
from quietgrove.catalog import fixtures as fx
from quietgrove.sources.presets import COMPANY_FLAGS

SEED = "7"
SPAN = "4503599627370496::DOUBLE"


def draw(seed, *keys):
    parts = "".join(f", coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"(('0x' || substr(sha256(concat_ws('|', '{seed}'{parts})), 1, 13))::BIGINT)"


def uni(seed, *keys):
    return f"(({draw(seed, *keys)}::DOUBLE + 0.5::DOUBLE) / {SPAN})"


def rd(expr, digits=6):
    return f"(round({expr}, {digits}) + 0.0)"


REG = """reg AS (SELECT o_orderkey AS row_id, c_acctbal, c_nationkey, o_orderstatus,
  o_orderpriority, c_mktsegment, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey)"""
PLANTED = REG + """,
planted AS (SELECT * EXCLUDE (y), (CASE WHEN o_orderpriority = '1-URGENT' THEN 0.6::DOUBLE ELSE -0.2::DOUBLE END)
  + (CASE WHEN c_acctbal < 2000 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
  + (row_id % 9 - 4)::DOUBLE / 40.0::DOUBLE AS y FROM reg)"""
GRADS = REG + """,
grads AS (SELECT *, floor(y / 8000.0::DOUBLE) / 64.0::DOUBLE - 0.5::DOUBLE
  - ((CASE WHEN o_orderpriority = '1-URGENT' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN c_acctbal < 2000 THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END)) AS grad,
  CAST(CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS BIGINT) AS node_id FROM reg)"""
BINARY = """bin AS (SELECT d.doc_id AS row_id, n_chars, lang, source, CAST(quality AS DOUBLE) AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
FLIPPED = BINARY + """,
flipped AS (SELECT * EXCLUDE (y), CASE WHEN (SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) >
  sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) FROM bin) THEN 1 - y ELSE y END AS y FROM bin)"""
MULTI = REG + """,
multi AS (SELECT * EXCLUDE (y, o_orderstatus), CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE
  WHEN 'O' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS y FROM reg)"""
MISSING = REG + """,
missing AS (SELECT * REPLACE (CASE WHEN row_id % 17 = 0 THEN '?' ELSE o_orderpriority END
  AS o_orderpriority) FROM reg)"""
SCORED = REG + """,
cfg AS (SELECT * FROM (VALUES (0, 'clip'), (1, 'filter'), (2, 'both')) c(ci, config),
  (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) b(budget)
  UNION ALL SELECT 3, 'plain', 0.0::DOUBLE),
scored AS (SELECT row_id, 'orders' AS dataset,
  CASE (row_id // 5) % 3 WHEN 0 THEN 300 WHEN 1 THEN 5000 ELSE 15000 END AS n,
  CAST(row_id % 5 AS INTEGER) AS fold, config, budget,
  CASE WHEN (row_id // 15) % 2 = 0 THEN 'loss' ELSE 'cost' END AS label, y,
  y + (row_id % 11 - 5) * 100.0::DOUBLE * (ci + 1) / (budget + 1) AS p FROM reg, cfg)"""


def company():
    sector = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(fx.SECTORS))
    flags = ", ".join(f"CAST((c_custkey // {i + 1}) % 2 AS INTEGER) AS \"{f}\""
                      for i, f in enumerate(COMPANY_FLAGS))
    return f"""company AS (SELECT c_custkey AS row_id,
  CASE WHEN (c_custkey // 3) % 2 = 0 THEN 'small' ELSE 'large' END AS company_size,
  CASE c_custkey % {len(fx.SECTORS)} {sector} END AS company_sector, {flags} FROM customer)"""


# -- trees, level by level -----------------------------------------------------------------

ALL = [("c_acctbal", "num"), ("c_nationkey", "num"), ("o_orderstatus", "text"),
       ("o_orderpriority", "text"), ("c_mktsegment", "text")]
MULTI_FEATURES = [f for f in ALL if f[0] != "o_orderstatus"]
DOCS = [("n_chars", "num"), ("lang", "text"), ("source", "text")]


def hist(src, name, feats, by, where="TRUE"):
    keys = ", ".join([*by, ""]) if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {keys}{i} AS fi, "
        + (f"CAST({f} AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS c" if kind != "text" else
           f"CAST(NULL AS DOUBLE) AS v, {f} AS c")
        + f", grad FROM {src} WHERE {where}" for i, (f, kind) in enumerate(feats))
    return (f"{name} AS (SELECT {keys}fi, v, c, count(*) AS n, sum(grad) AS g "
            f"FROM ({parts}) GROUP BY ALL)")


def hist_on_grid(lo, step, size):
    """``hist`` with the points of a grid as the numeric candidates, present or not."""
    lo, step = f"{float(lo)!r}::DOUBLE", f"{float(step)!r}::DOUBLE"

    def make(src, name, feats, by, where="TRUE"):
        keys = ", ".join([*by, ""]) if by else ""
        parts = []
        for i, (f, kind) in enumerate(feats):
            if kind == "text":
                parts.append(f"SELECT {keys}{i} AS fi, CAST(NULL AS DOUBLE) AS v, {f} AS c, grad, 1 AS one "
                             f"FROM {src} WHERE {where}")
                continue
            point = f"(SELECT max({lo} + p * {step}) FROM range({size}) r(p) WHERE {lo} + p * {step} <= {f})"
            parts += [f"SELECT {keys}{i} AS fi, {point} AS v, CAST(NULL AS VARCHAR) AS c, grad, 1 AS one "
                      f"FROM {src} WHERE {where}",
                      f"SELECT DISTINCT {keys}{i} AS fi, {lo} + p * {step} AS v, CAST(NULL AS VARCHAR) AS c, "
                      f"0.0::DOUBLE AS grad, 0 AS one FROM {src}, range({size}) r(p) WHERE {where}"]
        return (f"{name} AS (SELECT {keys}fi, v, c, CAST(sum(one) AS BIGINT) AS n, sum(grad) AS g "
                f"FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)")

    return make


def gains(h, name, feats, by, lam=0.1):
    keys = ", ".join([*by, ""]) if by else ""
    cats = ", ".join(str(i) for i, (_, k) in enumerate(feats) if k != "num") or "-1"
    group = f"PARTITION BY {keys}fi"
    before = f"OVER ({group} ORDER BY v NULLS FIRST, c NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_w AS (SELECT *, CASE WHEN fi IN ({cats}) THEN n ELSE coalesce(sum(n) {before}, 0) END AS nl,
  CASE WHEN fi IN ({cats}) THEN g ELSE coalesce(sum(g) {before}, 0) END AS gl,
  sum(n) OVER ({group}) AS nt, sum(g) OVER ({group}) AS gt FROM {h}),
{name} AS (SELECT {keys}fi, v, c, CAST(nl AS BIGINT) AS nl, gl, CAST(nt - nl AS BIGINT) AS nr, gt - gl AS gr,
  greatest(gl * gl / (nl + {lam}::DOUBLE) + (gt - gl) * (gt - gl) / (nt - nl + {lam}::DOUBLE), 0.0) AS gain
  FROM {name}_w WHERE nl > 0 AND nt - nl > 0)"""


def best(g, name, by, order="gain DESC", where="gain > 0"):
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return (f"{name} AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER ({part} ORDER BY "
            f"{order}, fi, v NULLS FIRST, c NULLS FIRST) AS rk FROM {g} WHERE {where}) WHERE rk = 1)")


def routed(src, b, name, feats, by):
    test = {"num": "< b.v", "code": "= b.v", "text": "= b.c"}
    left = " ".join(f"WHEN {i} THEN {f} {test[k]}" for i, (f, k) in enumerate(feats))
    on = " AND ".join(f"r.{k} = b.{k}" for k in by)
    return (f"{name} AS (SELECT r.* REPLACE (CASE WHEN b.fi IS NULL THEN r.node_id "
            f"WHEN CASE b.fi {left} END THEN 2 * r.node_id + 1 ELSE 2 * r.node_id + 2 END AS node_id) "
            f"FROM {src} r LEFT JOIN {b} b ON {on})")


def grow(src, p, feats, depth, by=("node_id",), order=None, where="gain > 0", hist=hist):
    """CTEs from rows (with node_id 0 and grad) to ``{p}_r{depth}``, rows in their leaves."""
    by, out = list(by), []
    for d in range(depth):
        rows = src if d == 0 else f"{p}_r{d}"
        out += [hist(rows, f"{p}_h{d}", feats, by, f"node_id >= {2 ** d - 1}"),
                gains(f"{p}_h{d}", f"{p}_g{d}", feats, by),
                best(f"{p}_g{d}", f"{p}_b{d}", by, *([order] if order else []), where=where),
                routed(rows, f"{p}_b{d}", f"{p}_r{d + 1}", feats, by)]
    return ", ".join(out)


def leaf_table(rows, name, by=("node_id",)):
    keys = ", ".join(by)
    return (f"{name} AS (SELECT {keys}, count(*) AS n, sum(grad) AS g, "
            f"-sum(grad) / (count(*) + 0.1::DOUBLE) AS w FROM {rows} GROUP BY {keys})")


def boosted(source, feats, start, gradient, rounds, depth, eta, prefix="t"):
    """CTEs of plain boosting; the result table ``{prefix}_end`` has row_id, y, pred."""
    out = [f"{prefix}_s0 AS (SELECT *, CAST({start} AS DOUBLE) AS pred FROM {source})"]
    for t in range(rounds):
        q = f"{prefix}{t}"
        out.append(f"{q}_in AS (SELECT *, {gradient} AS grad, 0::BIGINT AS node_id FROM {prefix}_s{t})")
        out.append(grow(f"{q}_in", q, feats, depth))
        out.append(leaf_table(f"{q}_r{depth}", f"{q}_leaf"))
        out.append(f"{prefix}_s{t + 1} AS (SELECT r.* EXCLUDE (pred, grad, node_id), "
                   f"r.pred + {eta}::DOUBLE * l.w AS pred FROM {q}_r{depth} r JOIN {q}_leaf l USING (node_id))")
    out.append(f"{prefix}_end AS (SELECT * FROM {prefix}_s{rounds})")
    return ", ".join(out)


def fit_tree_sql(b1_sql=None):
    """Node table of a depth-2 tree on ``grads``."""
    feature = " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(ALL))
    b1 = b1_sql or ""
    return f"""WITH {GRADS}, top AS (SELECT * REPLACE (0::BIGINT AS node_id) FROM grads),
{grow('top', 't', ALL, 2) if not b1 else b1}, {leaf_table('t_r2', 'leaf')},
inner_nodes AS (SELECT * FROM t_b0 UNION ALL SELECT * FROM t_b1)
SELECT node_id, false AS is_leaf, CASE fi {feature} END AS feature, v AS split_value,
  c AS split_category, {rd('gain')} AS gain, nl + nr AS n, CAST(NULL AS DOUBLE) AS prediction
FROM inner_nodes
UNION ALL SELECT node_id, true, NULL, NULL, NULL, NULL, n, {rd('w')} FROM leaf"""


def best_first_sql(depth, max_leaves, min_split):
    """Node table of a tree grown first in, first out. A node is split if it has rows enough and both
    children could be split again; with each node that is not, leaves so far and nodes that wait are
    counted, and growth ends once they reach the limit."""
    feature = " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(ALL))
    out = [f"WITH {GRADS}, top AS (SELECT * REPLACE (0::BIGINT AS node_id) FROM grads)",
           grow("top", "t", ALL, depth + 1),
           "q0 AS (SELECT 0::BIGINT AS node_id, 0 AS ord, 0 AS carried, false AS ended)"]
    for d in range(depth + 1):
        able = "false"
        if d < depth:
            able = (f"(b.nl + b.nr >= {min_split} AND (SELECT count(*) FROM t_b{d + 1} c "
                    "WHERE c.node_id IN (2 * q.node_id + 1, 2 * q.node_id + 2)) = 2)")
        out += [f"able{d} AS (SELECT q.*, NOT ended AND coalesce({able}, false) AS able FROM q{d} q "
                f"LEFT JOIN t_b{d} b ON q.node_id = b.node_id)",
                f"count{d} AS (SELECT *, sum(CASE WHEN able THEN 0 ELSE 1 END) OVER (ORDER BY ord) AS leaves, "
                f"count(*) OVER () AS waiting FROM able{d})",
                f"""halt{d} AS (SELECT min(ord) AS cut FROM count{d} WHERE NOT able AND NOT ended
  AND carried + leaves + (waiting - 1 - ord) + 2 * (ord + 1 - leaves) >= {max_leaves})""",
                f"""split{d} AS (SELECT c.*, cut IS NOT NULL OR ended AS stops FROM count{d} c, halt{d}
  WHERE able AND (cut IS NULL OR ord < cut))""",
                f"""q{d + 1} AS (SELECT s.node_id * 2 + side AS node_id, row_number() OVER (ORDER BY s.ord, k.gain DESC, side) - 1 AS ord,
  carried + (SELECT max(leaves) FROM count{d}) AS carried, stops AS ended
  FROM split{d} s, (VALUES (1), (2)) v(side) LEFT JOIN t_b{d + 1} k ON k.node_id = s.node_id * 2 + side)"""
                if d < depth else f"q{d + 1} AS (SELECT * FROM q{d} WHERE false)",
                f"in{d} AS (SELECT b.* FROM t_b{d} b JOIN split{d} s ON b.node_id = s.node_id)",
                routed("top" if d == 0 else f"r{d}", f"in{d}", f"r{d + 1}", ALL, ["node_id"])]
    inner = " UNION ALL ".join(f"SELECT * FROM in{d}" for d in range(depth + 1))
    return ", ".join(out) + f""", {leaf_table(f'r{depth + 1}', 'leaf')}
SELECT node_id, false AS is_leaf, CASE fi {feature} END AS feature, v AS split_value,
  c AS split_category, {rd('gain')} AS gain, nl + nr AS n, CAST(NULL AS DOUBLE) AS prediction
FROM ({inner})
UNION ALL SELECT node_id, true, NULL, NULL, NULL, NULL, n, {rd('w')} FROM leaf"""


def sibling_gains(src, name, feats=ALL):
    """Pooled gains of the children (side 0 / 1) of each parent_id in ``src``."""
    own = hist(src, f"{name}_own", feats, ["parent_id", "side"])
    pool = hist(src, f"{name}_pool", feats, ["parent_id"])
    return f"""{own}, {gains(f'{name}_own', f'{name}_og', feats, ['parent_id', 'side'])},
{pool}, {gains(f'{name}_pool', f'{name}_pg', feats, ['parent_id'])},
{name} AS (SELECT o.parent_id, o.side, o.fi, o.v, o.c, o.nl, o.gl, o.nr, o.gr, p.gain
  FROM {name}_og o JOIN {name}_pg p ON o.parent_id = p.parent_id AND o.fi = p.fi
  AND o.v IS NOT DISTINCT FROM p.v AND o.c IS NOT DISTINCT FROM p.c)"""


def utilities():
    return f"""WITH {GRADS}, {hist('grads', 'h', ALL, ['node_id'])}, {gains('h', 'g', ALL, ['node_id'])},
u AS (SELECT *, 0.05::DOUBLE * gain / 6.0::DOUBLE AS utility FROM g)"""


CAND = "node_id, fi AS feature_idx, v AS value, c AS category"
SPLIT = (f"nl AS n_left, {rd('gl')} AS g_left, nr AS n_right, {rd('gr')} AS g_right, "
         f"{rd('gain')} AS gain")


def order_pos(keys, src, extra="*"):
    return f"SELECT {extra}, row_number() OVER (ORDER BY {keys}) - 1 AS pos FROM {src}"


def fold_of(pos, n, k):
    big = f"({n} % {k}) * ({n} // {k} + 1)"
    return (f"CAST(CASE WHEN {pos} < {big} THEN {pos} // ({n} // {k} + 1) "
            f"ELSE {n} % {k} + ({pos} - {big}) // ({n} // {k}) END AS INTEGER)")


def balanced(trees, n="n"):
    """Quota ends of a balanced allotment as a recursive table q(t, unused, quota, top)."""
    return f"""q(t, unused, quota, top) AS (
  SELECT 0, {n}, {n} // {trees}, {n} // {trees} FROM cnt
  UNION ALL SELECT t + 1, unused - quota, (unused - quota) // ({trees} - t - 1),
    top + (unused - quota) // ({trees} - t - 1) FROM q WHERE t + 1 < {trees})"""


def quantile_sql(cols, src, percentile, eps, lo, hi):
    tail = (1.0 - percentile / 100.0) / 2.0
    qs = (tail, percentile / 100.0 + tail)
    parts = " UNION ALL ".join(
        f"SELECT {i} AS fi, greatest({lo}::DOUBLE, least(CAST({c} AS DOUBLE), {hi}::DOUBLE)) AS v FROM {src}"
        for i, c in enumerate(cols))
    return f"""vals AS ({parts}), n AS (SELECT count(*) AS n FROM {src}),
padded AS (SELECT fi, v FROM vals UNION ALL SELECT DISTINCT fi, {hi}::DOUBLE FROM vals),
pos AS (SELECT fi, v, row_number() OVER (PARTITION BY fi ORDER BY v) - 1 AS gap,
  coalesce(lag(v) OVER (PARTITION BY fi ORDER BY v), {lo}::DOUBLE) AS gap_lo FROM padded),
gaps AS (SELECT fi, gap, gap_lo, v AS gap_hi FROM pos WHERE v > gap_lo),
targets AS (SELECT 0 AS side, CAST(floor((n - 1) * {qs[0]!r}::DOUBLE + 1.5) AS BIGINT) AS target FROM n
  UNION ALL SELECT 1, CAST(floor((n - 1) * {qs[1]!r}::DOUBLE + 1.5) AS BIGINT) FROM n),
weights AS (SELECT fi AS feature_idx, side, gap, gap_lo, gap_hi, ln(gap_hi - gap_lo) + {eps / 2}::DOUBLE
  * (CASE WHEN gap < target THEN gap + 1 - target ELSE target - gap END) / 2 AS log_weight FROM gaps, targets)"""


def interval_sql(seed=SEED):
    gum = f"log_weight - ln(-ln({uni(seed + '|gap', 'feature_idx', 'side', 'gap')}))"
    point = uni(seed + "|point", "feature_idx", "side")
    return f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx, side
  ORDER BY {gum} DESC) AS rk FROM weights) WHERE rk = 1),
found AS (SELECT feature_idx, min(gap_lo + (gap_hi - gap_lo) * {point}) AS lower,
  max(gap_lo + (gap_hi - gap_lo) * {point}) AS upper FROM picked GROUP BY feature_idx)"""


# -- risk ----------------------------------------------------------------------------------

def fp(flag, table):
    return f"(CASE WHEN \"{flag}\" = 1 THEN {table[flag]}::DOUBLE ELSE 1.0::DOUBLE - {table[flag]}::DOUBLE END)"


def cpt(name):
    keys, rows = rt.CONDITIONAL_TABLES[name]
    cases = " ".join("WHEN " + " AND ".join(f"\"{k}\" = {v}" for k, v in zip(keys, r[:-1]))
                     + f" THEN {r[-1]}::DOUBLE" for r in rows)
    return f"(CASE {cases} END)"


def by_size(values):
    return (f"(CASE company_size WHEN 'small' THEN {values['small']}::DOUBLE "
            f"WHEN 'large' THEN {values['large']}::DOUBLE END)")


def by_both(values):
    cases = " ".join(f"WHEN company_size = '{s}' AND company_sector = '{k}' THEN {v}::DOUBLE"
                     for s, inner in values.items() for k, v in inner.items())
    return f"(CASE {cases} END)"


def loss_sql():
    sector = by_both(rt.SECTOR_GIVEN_SIZE)
    up = " * ".join([sector, *[fp(f, rt.FEATURE_GIVEN_LOSS) for f in rt.FEATURE_GIVEN_LOSS],
                     cpt("R2PS"), cpt("PDTI"), f"{rt.LOSS_PRIOR}::DOUBLE"])
    down = " * ".join([sector, by_size(rt.SIZE_PROBABILITY),
                       *[fp(f, rt.FEATURE_PROBABILITY) for f in
                         [*rt.FEATURE_GIVEN_LOSS, "company_does_red_teaming", "company_has_2FA",
                          "company_has_IDS"]],
                       *[cpt(t) for t in ("PWD", "SOC", "IPS", "THREAT", "IOC")]])
    return f"least(({up}) / ({down}), 1.0)"


def leaked_sql():
    parts = []
    for kind in ("pii", "pci", "phi", "credentials", "other"):
        sectors = ", ".join(f"'{s}'" for s, kinds in rt.SECTOR_DATA.items() if kind in kinds)
        cost = by_size({s: rt.DATA_COST[s][kind] for s in ("small", "large")})
        parts.append(f"CASE WHEN company_has_{kind} = 1 AND company_sector IN ({sectors}) "
                     f"THEN {cost} ELSE 0.0::DOUBLE END")
    return "(" + " + ".join(parts) + ")"


def breach_part(i):
    return by_both({s: {k: v[i] for k, v in inner.items()} for s, inner in rt.BREACH_COST.items()})


def fraction(changes):
    return "greatest(1.0::DOUBLE + " + " + ".join(
        f"CASE WHEN \"{f}\" = 1 THEN {a}::DOUBLE ELSE {b}::DOUBLE END"
        for f, (a, b) in changes.items()) + ", 0.0)"


def cost_sql():
    breach = f"greatest({breach_part(0)}, least({breach_part(1)} * {fraction(rt.BREACH_FRACTION)}, {breach_part(2)}))"
    return f"round({leaked_sql()} + {breach} + {by_both(rt.CRISIS_COST)} * {fraction(rt.CRISIS_FRACTION)}, 2)"


def old_loss_sql():
    def given(f):
        p = by_size({s: rt.OLD_FEATURE_GIVEN_LOSS[s][f] for s in ("small", "large")})
        return f"(CASE WHEN \"{f}\" = 1 THEN {p} ELSE 1.0::DOUBLE - {p} END)"
    flags = list(rt.OLD_FEATURE_PROBABILITY)
    up = " * ".join([*[given(f) for f in flags], f"{rt.OLD_LOSS_PRIOR}::DOUBLE"])
    down = " * ".join(fp(f, rt.OLD_FEATURE_PROBABILITY) for f in flags)
    return f"greatest(0.0, least(round(({up}) / ({down}), 4), 1.0))"


def mean_std(group, metric):
    return f"""per_fold AS (SELECT {group}, fold, {metric} AS score FROM scored GROUP BY ALL),
means AS (SELECT {group}, avg(score) AS mean, stddev_pop(score) AS std FROM per_fold GROUP BY {group})"""


RMSE = "sqrt(avg(pow(y - p, 2)))"
MAPE = ("avg(abs((CASE WHEN y = 0 THEN 0.00001::DOUBLE ELSE y END - p) / "
        "(CASE WHEN y = 0 THEN 0.00001::DOUBLE ELSE y END))) * 100")


def oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["a1_load_table"] = """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus,
  o_orderpriority, o_totalprice FROM orders"""
    o["a2_preset_regression"] = f"""WITH {REG} SELECT o_orderstatus AS sex, c_acctbal AS length,
  CAST(c_nationkey AS DOUBLE) AS diameter, y AS height, y / 2 AS whole_weight, y / 4 AS shucked_weight,
  y / 8 AS viscera_weight, y / 16 AS shell_weight, CAST(row_id AS DOUBLE) AS rings FROM reg"""
    names = ["clump_thickness", "cell_size", "cell_shape", "marginal_adhesion",
             "epithelial_cell_size", "bare_nuclei", "bland_chromatin", "normal_nucleoli", "mitoses"]
    marks = [f"CAST((row_id + {i}) % 10 + 1 AS VARCHAR)" for i in range(8)]
    exprs = [*marks[:5], "CAST(row_id % 7 AS VARCHAR)", *marks[5:]]
    o["a2_preset_binary"] = f"""WITH {MISSING} SELECT {', '.join(f'{e} AS {n}' for e, n in zip(exprs, names))},
  CASE WHEN c_acctbal < 2000 THEN '4' ELSE '2' END AS class FROM missing WHERE o_orderpriority <> '?'"""
    census = [("age", "num"), ("workclass", "text"), ("education", "text"), ("education_num", "num"),
              ("marital_status", "text"), ("occupation", "text"), ("relationship", "text"), ("race", "text"),
              ("sex", "text"), ("capital_gain", "num"), ("capital_loss", "num"), ("hours_per_week", "num"),
              ("native_country", "text")]
    coded = [f"'p{i}_' || CAST(row_id * {i + 3} % {k} AS VARCHAR)" for i, k in enumerate((5, 7, 13, 17, 19))]
    cols = ["CAST(c_nationkey AS DOUBLE)", coded[0], coded[1], "CAST(row_id % 11 AS DOUBLE)", "c_mktsegment",
            "o_orderpriority", coded[2], coded[3], coded[4], "floor(c_acctbal)", "CAST(row_id % 23 AS DOUBLE)",
            "CAST(row_id % 29 AS DOUBLE)", "o_orderstatus"]
    start = "(SELECT ln(q / (1 - q)) FROM (SELECT min(cnt) / sum(cnt) AS q FROM (SELECT count(*) AS cnt FROM turned GROUP BY y)))"
    o["a2_file_to_model_binary"] = f"""WITH {MISSING}, shaped AS (SELECT row_id, {', '.join(
        f'{e} AS {n}' for e, (n, _) in zip(cols, census))},
  CASE WHEN c_acctbal < 7000 OR o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
  FROM missing WHERE o_orderpriority <> '?'),
turned AS (SELECT * REPLACE (CASE WHEN (SELECT avg(y) FROM shaped) > 0.5 THEN 1 - y ELSE y END AS y) FROM shaped),
{boosted('turned', census, start, '1 / (1 + exp(-pred)) - y', 2, 2, 0.5)}
SELECT age, capital_gain, occupation, y AS income, {rd('pred')} AS prediction FROM t_end"""
    wide = [(f"audio_{i}", "num") for i in range(1, 91)]
    entries = [f"floor(CAST(embedding[{i + 1}] AS DOUBLE) * 1000)" for i in range(64)] + [
        f"floor(CAST(embedding[{i + 1}] AS DOUBLE) * CAST(embedding[{i + 2}] AS DOUBLE) * 100000)" for i in range(26)]
    o["a2_file_to_model_wide"] = f"""WITH sound AS (SELECT vec_id AS row_id, CAST(label + 1990 AS DOUBLE) AS y, {', '.join(
        f'{e} AS {n}' for e, (n, _) in zip(entries, wide))} FROM embeddings),
{boosted('sound', wide, '(SELECT avg(y) FROM sound)', 'pred - y', 1, 2, 0.5)}
SELECT y AS year, audio_1, audio_90, {rd('pred')} AS prediction FROM t_end"""
    o["a3_read_tabs"] = """SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS nation,
  c_mktsegment AS segment, c_acctbal AS balance FROM customer"""
    o["a4_append_tables"] = """SELECT c_acctbal AS balance, c_custkey AS id FROM customer
  UNION ALL SELECT s_acctbal, s_suppkey FROM supplier"""
    o["a5_take_first"] = f"WITH {REG} SELECT * FROM reg ORDER BY row_id LIMIT 12000"
    o["a6_sample_n"] = f"""WITH {MISSING} SELECT * FROM missing WHERE o_orderpriority <> '?'
  ORDER BY {draw(SEED, 'row_id')}, row_id LIMIT 700"""
    o["a7_write_results"] = f"""WITH {SCORED}, {mean_std('dataset, config, budget', RMSE)}
SELECT dataset, config, budget, {rd('mean', 4)} AS mean, {rd('std', 4)} AS std FROM means"""

    o["b1_drop_columns"] = f"WITH {REG} SELECT * EXCLUDE (c_nationkey, c_mktsegment) FROM reg"
    o["b2_drop_missing"] = f"WITH {MISSING} SELECT * FROM missing WHERE o_orderpriority <> '?'"
    for key, first in (("b3a_label_encode_sorted", "{c}"),
                       ("b3b_label_encode_first_seen", "min(row_id)")):
        maps = ", ".join(
            f"m_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {first.format(c=c)}) - 1 AS DOUBLE) AS code "
            f"FROM reg GROUP BY {c})" for c in fx.CATEGORICAL)
        joins = " ".join(f"JOIN m_{c} USING ({c})" for c in fx.CATEGORICAL)
        codes = ", ".join(f"m_{c}.code AS {c}" for c in fx.CATEGORICAL)
        o[key] = (f"WITH {REG}, {maps} SELECT row_id, c_acctbal, c_nationkey, {codes}, y "
                  f"FROM reg {joins}")
    o["b4_map_values"] = f"""WITH {REG} SELECT * REPLACE (CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O'
  THEN 2 ELSE 3 END AS INTEGER) AS o_orderstatus, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE -1
  END AS INTEGER) AS o_orderpriority) FROM reg"""
    o["b5_minority_positive"] = f"WITH {FLIPPED} SELECT * FROM flipped"
    o["b6_quantile_bin"] = f"""WITH {REG}, cnt AS (SELECT count(*) AS n FROM reg),
py AS ({order_pos('y', 'reg', 'y')}), pa AS ({order_pos('c_acctbal', 'reg', 'c_acctbal')}),
ey AS (SELECT y AS e FROM py, cnt WHERE pos IN (0, n // 4, 2 * (n // 4), 3 * (n // 4))),
ea AS (SELECT c_acctbal AS e FROM pa, cnt WHERE pos IN (0, n // 2))
SELECT row_id, y, CAST((SELECT count(*) FROM ey WHERE e <= y) - 1 AS INTEGER) AS bin,
  CAST(CASE (SELECT count(*) FROM ea WHERE e <= c_acctbal) - 1 WHEN 0 THEN -1 ELSE
  (SELECT count(*) FROM ea WHERE e <= c_acctbal) - 1 END AS INTEGER) AS signed_bin FROM reg"""
    o["b7_select_target"] = f"WITH {company()} SELECT row_id, company_size, {rd(cost_sql(), 2)} AS y FROM company"
    scaled = "(y - lo) / (hi - lo) * 2.0::DOUBLE - 1.0::DOUBLE"
    o["b8_scale_target"] = f"""WITH {REG}, e AS (SELECT min(y) AS lo, max(y) AS hi FROM reg)
SELECT row_id, {rd(scaled, 9)} AS y FROM reg, e"""
    o["b9_unscale"] = f"""WITH {REG}, e AS (SELECT min(y) AS lo, max(y) AS hi FROM reg)
SELECT row_id, {rd(f'(({scaled}) * 0.5::DOUBLE - (-1.0::DOUBLE - lo * (2.0::DOUBLE / (hi - lo)))) / (2.0::DOUBLE / (hi - lo))', 4)} AS p
FROM reg, e"""
    o["b10_clamp"] = f"WITH {REG} SELECT row_id, greatest(0.0, least(c_acctbal, 5000.0::DOUBLE)) AS clamped FROM reg"
    o["b11_scale_features_private"] = f"""WITH {REG}, {quantile_sql(['c_acctbal', 'y'], 'reg', 90.0, 4.0, -2000.0, 600000.0)},
{interval_sql()} SELECT row_id,
  {rd('(greatest(a.lower, least(c_acctbal, a.upper)) - a.lower) / (a.upper - a.lower) * 10', 5)} AS c_acctbal,
  {rd('(greatest(b.lower, least(y, b.upper)) - b.lower) / (b.upper - b.lower) * 10', 5)} AS y
FROM reg, found a, found b WHERE a.feature_idx = 0 AND b.feature_idx = 1"""

    o["c0_global_rank"] = f"WITH {REG} SELECT row_id, y, row_number() OVER (ORDER BY y, row_id) - 1 AS position FROM reg"
    o["c1_train_test_split"] = f"""WITH {REG}, cnt AS (SELECT count(*) AS n FROM reg), p AS ({order_pos('row_id', 'reg', 'row_id, y')})
SELECT row_id, y, pos < ceil((1 - 0.7::DOUBLE) * n) AS is_test FROM p, cnt"""
    o["c2_kfold"] = f"""WITH {REG}, cnt AS (SELECT count(*) AS n FROM reg), p AS ({order_pos('row_id', 'reg', 'row_id, y')}),
s AS ({order_pos(draw(SEED, 'row_id') + ', row_id', 'reg', 'row_id')})
SELECT row_id, y, {fold_of('p.pos', 'n', 7)} AS block, {fold_of('s.pos', 'n', 7)} AS fold FROM p JOIN s USING (row_id), cnt"""
    o["c3_shuffle"] = f"""WITH {REG} SELECT row_id, y, row_number() OVER (ORDER BY {draw(SEED, 'row_id')}, row_id) - 1
  AS position FROM reg"""
    ids = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 45"
    o["c4_subset"] = f"WITH {REG} SELECT * FROM reg WHERE row_id IN ({ids})"
    o["c5_remove_rows"] = f"WITH {REG} SELECT * FROM reg WHERE row_id NOT IN ({ids})"
    drawn = order_pos(f"{draw(SEED, 'row_id')}, row_id", "reg", "row_id, y")
    o["c6_partition_balanced"] = f"""WITH RECURSIVE {REG}, cnt AS (SELECT count(*) AS n FROM reg), p AS ({drawn}),
{balanced(7)} SELECT row_id, y, CAST((SELECT count(*) FROM q WHERE top <= pos) AS INTEGER) AS tree_id FROM p"""
    o["c7_partition_geometric"] = f"""WITH {REG}, cnt AS (SELECT count(*) AS n FROM reg), p AS ({drawn}),
q0 AS (SELECT t, CAST(floor(n * 0.2::DOUBLE * pow(0.8::DOUBLE, t) / (1 - pow(0.8::DOUBLE, 20))) AS BIGINT) AS quota
  FROM cnt, range(20) r(t)),
q AS (SELECT t, sum(quota) OVER (ORDER BY t) AS top FROM q0 WHERE t < coalesce((SELECT min(t) FROM q0 WHERE quota = 0), 20))
SELECT row_id, y, CAST(CASE WHEN pos < (SELECT max(top) FROM q) THEN (SELECT count(*) FROM q WHERE top <= pos) END
  AS INTEGER) AS tree_id FROM p"""
    cent = f"{REG}, cen AS (SELECT row_id, (y - 250000) / 200000 AS grad FROM reg), k AS (SELECT CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) AS quota FROM cen)"
    clip = "greatest(-0.9::DOUBLE, least(grad, 0.9::DOUBLE))"
    o["c8_gradient_filter_fill"] = f"""WITH {cent},
p AS ({order_pos(f"CASE WHEN abs(grad) > 0.9 THEN 1 ELSE 0 END, {draw(SEED, 'row_id')}, row_id", 'cen')})
SELECT row_id, {clip} AS grad FROM p, k WHERE pos < quota"""
    o["c9_gradient_filter_drop"] = f"""WITH {cent}, p AS ({order_pos(f"{draw(SEED, 'row_id')}, row_id", 'cen')})
SELECT row_id, grad FROM p, k WHERE pos < quota AND abs(grad) <= 0.9"""
    o["c10_gradient_filter_clip"] = f"WITH {cent} SELECT row_id, {clip} AS grad FROM cen"

    o["d1_regression_init"] = f"WITH {REG} SELECT {rd('avg(y)', 4)} AS init FROM reg"
    o["d2_binary_init"] = f"""WITH {FLIPPED}, s AS (SELECT min(cnt) / sum(cnt) AS p FROM
  (SELECT count(*) AS cnt FROM flipped GROUP BY y)) SELECT {rd('ln(p / (1 - p))', 9)} AS init FROM s"""
    o["d3_multiclass_init"] = f"""WITH {MULTI} SELECT CAST(y AS INTEGER) AS class_id,
  {rd('ln(count(*) / (SELECT count(*)::DOUBLE FROM multi))', 9)} AS init FROM multi GROUP BY y"""
    o["d4_regression_gradient"] = f"WITH {REG} SELECT row_id, {rd('c_acctbal * 30 - y', 4)} AS grad FROM reg"
    o["d5_binary_gradient"] = f"""WITH {BINARY} SELECT row_id,
  {rd('1 / (1 + exp(-(n_chars / 5000::DOUBLE - 1))) - y', 9)} AS grad FROM bin"""
    soft = """soft AS (SELECT *, exp(p0) + exp(p1) + exp(p2) AS z FROM (SELECT *, c_acctbal / 5000 AS p0,
  c_nationkey / 20::DOUBLE AS p1, (row_id % 5) / 4::DOUBLE AS p2 FROM multi))"""
    o["d6_multiclass_gradient"] = f"WITH {MULTI}, {soft} SELECT row_id, " + ", ".join(
        rd(f"exp(p{k}) / z - (CASE WHEN y = {k} THEN 1 ELSE 0 END)", 9) + f" AS g{k}"
        for k in range(3)) + " FROM soft"

    h = f"WITH {GRADS}, {hist('grads', 'h', ALL, ['node_id'])}"
    g = f"{h}, {gains('h', 'g', ALL, ['node_id'])}"
    o["e1_candidates_distinct"] = f"{h} SELECT {CAND}, n, {rd('g')} AS g FROM h"
    grid = " UNION ALL ".join(
        f"""SELECT node_id, {i} AS feature_idx, i * 500.0::DOUBLE AS value,
  count(*) FILTER (WHERE x < i * 500) AS nl, coalesce(sum(grad) FILTER (WHERE x < i * 500), 0) AS gl,
  count(*) FILTER (WHERE x >= i * 500) AS nr, coalesce(sum(grad) FILTER (WHERE x >= i * 500), 0) AS gr
  FROM (SELECT node_id, grad, {f} AS x FROM grads), range(20) r(i) GROUP BY node_id, i"""
        for i, f in enumerate(fx.NUMERIC))
    o["e2_candidates_grid"] = f"""WITH {GRADS}, c AS ({grid}) SELECT node_id, feature_idx, value,
  nl AS n_left, {rd('gl')} AS g_left, nr AS n_right, {rd('gr')} AS g_right,
  {rd('gl * gl / (nl + 0.1::DOUBLE) + gr * gr / (nr + 0.1::DOUBLE)')} AS gain FROM c WHERE nl > 0 AND nr > 0"""
    o["e3_candidates_declared"] = f"""WITH {GRADS}, k AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'),
  ('3-MEDIUM'), ('9-NEVER')) k(category), (SELECT DISTINCT node_id FROM grads))
SELECT k.node_id, 0 AS feature_idx, category, count(row_id) AS n, {rd('coalesce(sum(grad), 0)')} AS g
FROM k LEFT JOIN grads r ON r.node_id = k.node_id AND o_orderpriority = category GROUP BY ALL"""
    o["e4_split_gain_numeric"] = f"{g} SELECT node_id, fi AS feature_idx, v AS value, {SPLIT} FROM g WHERE fi < 2"
    o["e5_split_gain_categorical"] = f"{g} SELECT node_id, fi AS feature_idx, c AS category, {SPLIT} FROM g WHERE fi >= 2"
    o["e6_sibling_gain"] = f"""WITH {GRADS}, sib AS (SELECT *, 0 AS parent_id, CAST(node_id - 1 AS INTEGER) AS side FROM grads),
{sibling_gains('sib', 's')} SELECT parent_id, side, fi AS feature_idx, v AS value, c AS category, {SPLIT} FROM s"""
    o["e7_utility"] = f"{utilities()} SELECT {CAND}, {rd('utility')} AS utility FROM u"
    norm = "ln(sum(exp({u})) OVER (PARTITION BY node_id))"
    p_pos = f"CASE WHEN utility > 0 THEN exp(utility - {norm.format(u='utility')}) ELSE 0 END"
    p_all = f"CASE WHEN utility > 0.5 THEN exp(utility - 0.5 - {norm.format(u='utility - 0.5')}) ELSE 0 END"
    o["e8_split_probabilities"] = f"""{utilities()} SELECT {CAND}, {rd(p_pos, 9)} AS probability, 'positive' AS norm FROM u
UNION ALL SELECT {CAND}, {rd(p_all, 9)}, 'all' FROM u"""
    gum = f"ln(-ln({uni(SEED, 'node_id', 'fi', 'v', 'c')}))"
    keep = f"{CAND}, nl AS n_left, nr AS n_right, {rd('utility')} AS utility"
    o["e9_exponential_mechanism"] = f"""{utilities()},
{best('u', 'hi', ['node_id'], f'utility - {gum} DESC', 'utility > 0')},
{best('u', 'lo', ['node_id'], f'-utility - {gum} DESC', 'utility > 0')}
SELECT {keep}, 'high' AS prefers FROM hi UNION ALL SELECT {keep}, 'low' FROM lo"""
    o["e10_split_cdf"] = f"""{utilities()}, pr AS (SELECT *, {p_pos} AS p FROM u) SELECT {CAND},
  {rd('sum(p) OVER (PARTITION BY node_id ORDER BY fi, v NULLS FIRST, c NULLS FIRST ROWS UNBOUNDED PRECEDING)', 9)} AS cdf FROM pr"""
    o["e11_best_split"] = f"{g}, {best('g', 'b', ['node_id'])} SELECT {CAND}, {SPLIT} FROM b"
    o["e12_log_sum_exp"] = f"""WITH {REG}, m AS (SELECT o_orderpriority, max(c_acctbal / 3) AS t FROM reg GROUP BY 1)
SELECT o_orderpriority, {rd('any_value(t) + ln(sum(exp(c_acctbal / 3 - t)))', 8)} AS lse
FROM reg JOIN m USING (o_orderpriority) GROUP BY o_orderpriority"""

    o["f1_route"] = f"{g}, {best('g', 'b', ['node_id'])}, {routed('grads', 'b', 'r', ALL, ['node_id'])} SELECT row_id, node_id FROM r"
    o["f2_fit_tree"] = fit_tree_sql()
    # Depth 2 with room for three leaves: all splits are possible here, so the first leaf is
    # made once both nodes below the root have children; the tree is the full one.
    o["f3_fit_tree_best_first"] = fit_tree_sql()
    o["f3_best_first_limit"] = best_first_sql(3, 4, "(SELECT count(*) FROM grads) * 15 // 100")
    level1 = f"""{hist('top', 't_h0', ALL, ['node_id'])}, {gains('t_h0', 't_g0', ALL, ['node_id'])},
{best('t_g0', 't_b0', ['node_id'])}, {routed('top', 't_b0', 't_r1', ALL, ['node_id'])},
t_sib AS (SELECT *, 0 AS parent_id, CAST(node_id - 1 AS INTEGER) AS side FROM t_r1),
{sibling_gains('t_sib', 't_sg')},
t_g1 AS (SELECT CAST(side + 1 AS BIGINT) AS node_id, fi, v, c, nl, gl, nr, gr, gain FROM t_sg),
{best('t_g1', 't_b1', ['node_id'])}, {routed('t_r1', 't_b1', 't_r2', ALL, ['node_id'])}"""
    o["f4_fit_tree_sibling"] = fit_tree_sql(level1)
    o["f5_leaf_values"] = f"""WITH {GRADS}, {leaf_table('grads', 'l')} SELECT node_id, n, {rd('w', 9)} AS leaf_value FROM l"""
    parts = " UNION ALL ".join(
        f"SELECT CAST(row_id % 4 AS INTEGER) AS node_id, {k} AS class_id, exp(p{k}) / z AS p, "
        f"exp(p{k}) / z - (CASE WHEN y = {k} THEN 1 ELSE 0 END) AS g FROM soft" for k in range(3))
    o["f6_leaf_values_multiclass"] = f"""WITH {MULTI}, {soft}, l AS ({parts})
SELECT node_id, class_id, count(*) AS n,
  {rd('-sum(g) * (2::DOUBLE / 3) / (sum(p * (1 - p)) + 0.1::DOUBLE)', 8)} AS leaf_value FROM l GROUP BY ALL"""
    bound = f"{0.2 * 0.9 ** 3!r}::DOUBLE"
    o["f7_leaf_values_clipped"] = f"""WITH {GRADS}, {leaf_table('grads', 'l', ['c_nationkey'])}
SELECT c_nationkey, n, {rd(f'greatest(-{bound}, least(w, {bound}))', 9)} AS leaf_value FROM l"""
    b3 = f"{0.9 ** 3!r}::DOUBLE"
    scale = f"{min(1 / 1.1, 2 * 0.9 ** 3) / 1.0!r}::DOUBLE"
    lap = (f"{scale} * (ln({uni(SEED + '|1', 'c_nationkey')}) - ln({uni(SEED + '|2', 'c_nationkey')}))")
    o["f8_leaf_values_private"] = f"""WITH {GRADS}, {leaf_table('grads', 'l', ['c_nationkey'])}
SELECT c_nationkey, n, {rd(f'greatest(-{b3}, least(w, {b3})) + {lap}', 8)} AS leaf_value FROM l"""

    plain = f"WITH {PLANTED}, {boosted('planted', ALL, '(SELECT avg(y) FROM planted)', 'pred - y', 2, 2, 0.5)}"
    o["h2_plain_boosting"] = f"{plain} SELECT row_id, {rd('pred')} AS prediction FROM t_end"
    o["h6_transform"] = f"{plain} SELECT row_id, {rd('y')} AS y, {rd('pred')} AS p FROM t_end"
    sig = "1 / (1 + exp(-abs(pred)))"
    o["h9_signed_label"] = f"""{plain} SELECT row_id, CASE WHEN pred >= 0 THEN 1 ELSE -1 END AS label,
  {rd(f'CASE WHEN pred >= 0 THEN 1 - {sig} ELSE {sig} END')} AS p0,
  {rd(f'CASE WHEN pred >= 0 THEN {sig} ELSE 1 - {sig} END')} AS p1 FROM t_end"""
    o["h10_decision_path"] = f"""{plain} SELECT row_id, CASE WHEN node_id >= 3 THEN '0>' || CAST((node_id - 1) // 2 AS VARCHAR)
  || '>' || CAST(node_id AS VARCHAR) WHEN node_id > 0 THEN '0>' || CAST(node_id AS VARCHAR) ELSE '0' END AS path FROM t0_r2"""
    o["f9_node_stats"] = f"""{plain}, rows_ AS (SELECT 0 AS tree_id, node_id, grad FROM t0_r2
  UNION ALL SELECT 1, node_id, grad FROM t1_r2),
paths AS (SELECT tree_id, node_id, grad FROM rows_
  UNION ALL SELECT tree_id, (node_id - 1) // 2, grad FROM rows_ WHERE node_id >= 3
  UNION ALL SELECT tree_id, 0, grad FROM rows_ WHERE node_id > 0)
SELECT tree_id, 0 AS class_id, node_id, count(*) AS n, {rd('sum(grad)')} AS gradient_sum,
  {rd('CASE WHEN node_id = 0 THEN 0 ELSE -sum(grad) / (count(*) + 0.1::DOUBLE) END')} AS leaf_value
FROM paths GROUP BY tree_id, node_id"""
    o["h1_private_boosting"] = private_sql()
    o["h1_private_boosting_filtered"] = pool_sql("fill", 3, 2, 2.0, 0.1, 0.5, clip=False)
    o["h1_private_boosting_dropped"] = pool_sql("drop", 3, 2, 8.0, 0.3, 0.4)
    o["h5_private_rejection"] = pool_sql("take", 4, 1, 24.0, 0.5, 1.0, patience=2)
    o["h1_private_grid_scaled"] = private_sql(2, 4.0, 1.0, (0.0, 0.0625, 16))
    multi = f"WITH {MULTI}, {multiclass_sql()}"
    o["h3_multiclass_boosting"] = f"{multi} SELECT row_id, " + ", ".join(
        rd(f"p{k}") + f" AS raw{k}" for k in range(3)) + " FROM m_s2"
    o["h7_predict_label_multiclass"] = f"""{multi} SELECT row_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0
  WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM m_s2"""
    start = "(SELECT ln(q / (1 - q)) FROM (SELECT min(cnt) / sum(cnt) AS q FROM (SELECT count(*) AS cnt FROM flipped GROUP BY y)))"
    two = f"WITH {FLIPPED}, {boosted('flipped', DOCS, start, '1 / (1 + exp(-pred)) - y', 2, 1, 0.5)}"
    o["h7_predict_label"] = f"{two} SELECT row_id, CASE WHEN pred >= 0 THEN 1 ELSE 0 END AS label FROM t_end"
    o["h8_predict_proba"] = f"""{two} SELECT row_id, {rd('1 - 1 / (1 + exp(-pred))')} AS p0,
  {rd('1 / (1 + exp(-pred))')} AS p1 FROM t_end"""
    allots = []
    for e in range(2):
        pos = order_pos(f"{draw(f'{SEED}|{e}', 'row_id')}, row_id", "reg", "row_id")
        allots.append(f"SELECT row_id, {e} AS ensemble_id, CAST((SELECT count(*) FROM q WHERE top <= pos) AS INTEGER) "
                      f"AS tree_id, 1.5::DOUBLE AS budget FROM ({pos})")
    o["h4_ensemble_schedule"] = f"""WITH RECURSIVE {REG}, cnt AS (SELECT count(*) AS n FROM reg), {balanced(3)}
{' UNION ALL '.join(allots)}"""
    o["h5_tree_rejection"] = rejection_sql()

    events = quantile_sql(["value"], "events", 95.0, 0.5, 0.0, 1000.0)
    o["g1_quantile_weights"] = f"""WITH {events} SELECT feature_idx, side, gap, gap_lo, gap_hi,
  {rd('log_weight', 7)} AS log_weight FROM weights"""
    o["g1_dp_quantile_interval"] = f"""WITH {events}, {interval_sql()} SELECT 'value' AS "column",
  {rd('lower')} AS lower, {rd('upper')} AS upper FROM found"""

    o["k1a_rmse"] = f"WITH {SCORED} SELECT config, budget, {rd(RMSE, 4)} AS rmse FROM scored GROUP BY ALL"
    wrong = "CASE WHEN y <> (CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END) THEN 1.0::DOUBLE ELSE 0 END"
    o["k1b_error_rate"] = f"""WITH {BINARY} SELECT lang, {rd(f'avg({wrong}) * 100')} AS error_rate,
  {rd(f'1 - avg({wrong})')} AS accuracy FROM bin GROUP BY lang"""
    o["k1c_mape"] = f"""WITH {SCORED}, z AS (SELECT * REPLACE (CASE WHEN row_id % 1000 = 0 THEN 0 ELSE y END AS y) FROM scored)
SELECT config, budget, {rd(MAPE, 2)} AS mape FROM z GROUP BY ALL"""
    o["k1d_score_summary"] = f"""WITH {SCORED}, {mean_std('config, budget', RMSE)} SELECT config, budget,
  {rd('mean', 4)} AS mean, {rd('std', 4)} AS std, {rd('std / 2', 4)} AS half_std FROM means"""
    o["k2_cross_validate"] = f"""WITH {PLANTED}, {folds_sql(1)}
SELECT f.fold, count(*) AS n, {rd('sqrt(avg(pow(f.y - (s.start + 0.5::DOUBLE * l.w), 2)))')} AS score
FROM folded f JOIN starts s ON s.model = f.fold JOIN f0_b0 b ON b.model = f.fold
JOIN f0_leaf l ON l.model = f.fold AND l.node_id = CASE WHEN {goes_left()} THEN 1 ELSE 2 END GROUP BY f.fold"""
    o["k2_cross_validate_private"] = private_folds_sql()
    o["r6_trace"] = f"""WITH {PLANTED}, {folds_sql(2)},
sums AS (SELECT model AS fold, 0 AS tree_id, sum(grad) AS g FROM f0_in GROUP BY model
  UNION ALL SELECT model, 1, sum(grad) FROM f1_in GROUP BY model),
lv AS (SELECT model AS fold, 0 AS tree_id, sum(w) AS w FROM f0_leaf GROUP BY model
  UNION ALL SELECT model, 1, sum(w) FROM f1_leaf GROUP BY model)
SELECT fold, tree_id, 0 AS class_id, {rd('g')} AS gradient_sum, {rd('w')} AS leaf_sum FROM sums JOIN lv USING (fold, tree_id)"""
    plain_cfg = f"{SCORED.replace('scored AS', 'scored_all AS')}, scored AS (SELECT * FROM scored_all WHERE config = 'plain')"
    o["k4_complexity_sweep"] = f"""WITH {plain_cfg}, {mean_std('label, n', MAPE)} SELECT label, {rd('avg(mean)', 5)} AS mean,
  {rd('avg(std / 2)', 5)} AS std FROM means WHERE n <> 300 GROUP BY label"""
    o["k4_complexity_scores"] = complexity_sql((300, 5000, 15000, 25000, 50000, 75000, 100000))
    o["k5_baseline_scores"] = f"""WITH {REG}, {BINARY}, top AS (SELECT y FROM bin GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT 'rmse' AS metric, {rd('avg(y)', 3)} AS prediction, {rd('stddev_pop(y)', 3)} AS score FROM reg
UNION ALL SELECT 'error_rate', (SELECT y FROM top), {rd('avg(CASE WHEN y <> (SELECT y FROM top) THEN 100.0::DOUBLE ELSE 0 END)', 3)} FROM bin"""

    means = f"WITH {SCORED}, {mean_std('config, budget', RMSE)}"
    cols = ", ".join(f"{rd(f'''max({m}) FILTER (WHERE config = '{c}')''', 4)} AS {c}_{m}"
                     for c in fx.CONFIGS for m in ("mean", "std"))
    flat = ", ".join(f"{rd(f'''(SELECT {m} FROM means WHERE config = 'plain')''', 4)} AS plain_{m}"
                     for m in ("mean", "std"))
    o["r1_result_series"] = f"{means} SELECT budget, {cols}, {flat} FROM means WHERE budget > 0 GROUP BY budget"
    o["r2_error_extent"] = f"""{means} SELECT {rd('min(mean) - arg_min(std, mean)', 4)} AS low,
  {rd('max(mean) + arg_max(std, mean)', 4)} AS high FROM means"""
    o["r3_histogram"] = f"""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 40 AS w FROM events),
b AS (SELECT CAST(least(floor((value - lo) / w), 39) AS INTEGER) AS bin, lo, w FROM events, e)
SELECT bin, {rd('lo + bin * w')} AS bin_lo, {rd('lo + (bin + 1) * w')} AS bin_hi, count(*) AS n FROM b GROUP BY bin, lo, w"""
    o["r4_complexity_curve"] = f"WITH {plain_cfg}, {mean_std('n, label', MAPE)} SELECT n, " + ", ".join(
        f"{rd(f'''max({m}) FILTER (WHERE label = '{c}')''', 5)} AS {c}_{m}"
        for c in ("loss", "cost") for m in ("mean", "std")) + " FROM means GROUP BY n"
    o["r5_compare_runs"] = f"""{means} SELECT a.budget, {rd('a.mean', 4)} AS mean_a, {rd('a.std', 4)} AS std_a,
  {rd('b.mean', 4)} AS mean_b, {rd('b.std', 4)} AS std_b, {rd('b.mean - a.mean', 4)} AS delta
FROM means a JOIN means b ON a.budget = b.budget AND a.config = 'clip' AND b.config = 'both'"""
    o["r7_compare_tables"] = f"""WITH {SCORED}, s AS (SELECT * FROM scored WHERE config = 'clip' AND budget = 1),
a AS (SELECT row_id, p AS p_a FROM s WHERE row_id % 13 <> 0),
b AS (SELECT row_id, CASE WHEN row_id % 19 = 0 THEN p + 1 ELSE p END AS p_b FROM s WHERE row_id % 17 <> 0),
m AS (SELECT * FROM a FULL JOIN b USING (row_id) WHERE p_a IS DISTINCT FROM p_b)
SELECT row_id, p_a, p_b, (SELECT count(*) FROM m) AS mismatches FROM m ORDER BY row_id LIMIT 50"""

    com = f"WITH {company()}"
    o["s1_feature_probability"] = f"{com} SELECT row_id, " + ", ".join(
        [f'{fp(f, rt.FEATURE_GIVEN_LOSS)} AS "{f}_loss"' for f in rt.FEATURE_GIVEN_LOSS]
        + [f'{fp(f, rt.FEATURE_PROBABILITY)} AS "{f}"' for f in ("company_has_2FA", "company_has_IDS")]
    ) + " FROM company"
    o["s2_cpt_lookup"] = f"{com} SELECT row_id, " + ", ".join(
        f"{cpt(t)} AS p_{t.lower()}" for t in rt.CONDITIONAL_TABLES) + " FROM company"
    o["s3_loss_probability"] = f"{com} SELECT row_id, {rd(loss_sql(), 9)} AS company_suffers_a_loss FROM company"
    o["s4_potential_cost"] = f"{com} SELECT row_id, {rd(cost_sql(), 2)} AS cost_of_loss FROM company"
    o["s5_loss_probability_old"] = f"{com} SELECT row_id, {old_loss_sql()} AS company_suffers_a_loss FROM company"
    o["s6_potential_cost_old"] = f"""{com}, t AS (SELECT row_id, {leaked_sql()} + {by_both(rt.CRISIS_COST)} AS base,
  {uni(SEED + '|breach', 'row_id')} AS u, CASE WHEN {breach_part(0)} = {breach_part(2)} THEN {breach_part(0)} - 1
  ELSE {breach_part(0)} END AS lo, {breach_part(1)} AS mode, {breach_part(2)} AS hi FROM company)
SELECT row_id, round(base + CASE WHEN u < (mode - lo) / (hi - lo) THEN lo + sqrt(u * (hi - lo) * (mode - lo))
  ELSE hi - sqrt((1 - u) * (hi - lo) * (hi - mode)) END, 2) AS cost_of_loss FROM t"""
    cols = ["company_size", "company_has_antivirus", "company_has_patching_process",
            "company_trains_employees_against_social_engineering"]
    o["s7_profile_distribution"] = f"""{com} SELECT {', '.join(cols)},
  round(count(*) / (SELECT count(*)::DOUBLE FROM company) * 100, 2) AS percent FROM company GROUP BY ALL"""

    def jitter(c):
        z = (f"sqrt(-2 * ln({uni(f'{SEED}|{c}|1', 'row_id', 'copy')})) * "
             f"cos(6.283185307179586::DOUBLE * {uni(f'{SEED}|{c}|2', 'row_id', 'copy')})")
        sd = f"({c} / 100 * 15.0::DOUBLE)"
        return (f"round(exp(ln({c} * {c} / sqrt({c} * {c} + {sd} * {sd})) + "
                f"sqrt(ln(1 + {sd} * {sd} / ({c} * {c}))) * {z}), 3)")
    o["s8_augment_rows"] = f"""{com}, b AS (SELECT row_id, {loss_sql()} AS company_suffers_a_loss,
  {cost_sql()} AS cost_of_loss FROM company), x AS (SELECT *, CAST(i AS INTEGER) AS copy FROM b, range(1, 4) r(i))
SELECT row_id, copy, greatest(0.0, least({jitter('company_suffers_a_loss')}, 1.0)) AS company_suffers_a_loss,
  {jitter('cost_of_loss')} AS cost_of_loss FROM x"""
    return o


def goes_left():
    return "CASE b.fi " + " ".join(
        f"WHEN {i} THEN f.{f} {'< b.v' if k == 'num' else '= b.c'}"
        for i, (f, k) in enumerate(ALL)) + " END"


def folds_sql(rounds):
    """Depth-1 boosting of three fold models; rows train the models of the other folds."""
    by = ("model", "node_id")
    out = [f"""cnt AS (SELECT count(*) AS n FROM planted), pos AS ({order_pos('row_id', 'planted')}),
folded AS (SELECT * EXCLUDE (pos, n), {fold_of('pos', 'n', 3)} AS fold FROM pos, cnt),
pairs AS (SELECT f.*, CAST(m AS INTEGER) AS model FROM folded f, range(3) r(m) WHERE m <> fold),
starts AS (SELECT model, avg(y) AS start FROM pairs GROUP BY model),
f_s0 AS (SELECT p.*, start AS pred FROM pairs p JOIN starts USING (model))"""]
    for t in range(rounds):
        out += [f"f{t}_in AS (SELECT *, pred - y AS grad, 0::BIGINT AS node_id FROM f_s{t})",
                grow(f"f{t}_in", f"f{t}", ALL, 1, by), leaf_table(f"f{t}_r1", f"f{t}_leaf", by),
                f"f_s{t + 1} AS (SELECT r.* EXCLUDE (pred, grad, node_id), r.pred + 0.5::DOUBLE * l.w AS pred "
                f"FROM f{t}_r1 r JOIN f{t}_leaf l USING (model, node_id))"]
    return ", ".join(out)


def multiclass_sql():
    """Two rounds of depth-1 trees for three classes."""
    out = ["m_s0 AS (SELECT *, " + ", ".join(
        f"(SELECT ln(avg(CASE WHEN y = {k} THEN 1.0::DOUBLE ELSE 0 END)) FROM multi) AS p{k}"
        for k in range(3)) + " FROM multi)"]
    for t in range(2):
        parts = " UNION ALL ".join(
            f"SELECT * EXCLUDE (z), {k} AS class_id, exp(p{k}) / z AS prob, "
            f"exp(p{k}) / z - (CASE WHEN y = {k} THEN 1 ELSE 0 END) AS grad, 0::BIGINT AS node_id "
            f"FROM (SELECT *, exp(p0) + exp(p1) + exp(p2) AS z FROM m_s{t})" for k in range(3))
        out += [f"m{t}_in AS ({parts})",
                grow(f"m{t}_in", f"m{t}", MULTI_FEATURES, 1, ("class_id", "node_id")),
                f"m{t}_leaf AS (SELECT class_id, node_id, -sum(grad) * (2::DOUBLE / 3) / "
                f"(sum(prob * (1 - prob)) + 0.1::DOUBLE) AS w FROM m{t}_r1 GROUP BY ALL)",
                f"m{t}_v AS (SELECT row_id, " + ", ".join(
                    f"max(w) FILTER (WHERE class_id = {k}) AS w{k}" for k in range(3))
                + f" FROM m{t}_r1 JOIN m{t}_leaf USING (class_id, node_id) GROUP BY row_id)",
                f"m_s{t + 1} AS (SELECT s.* REPLACE (" + ", ".join(
                    f"p{k} + 0.5::DOUBLE * w{k} AS p{k}" for k in range(3))
                + f") FROM m_s{t} s JOIN m{t}_v USING (row_id))"]
    return ", ".join(out)


def private_trees(rows, p, depth, budget, eta, make=hist):
    """CTEs of two private trees on disjoint halves of the rows of ``rows`` that have ``trains``; the
    last, ``{p}_s2``, has all rows with their prediction. Half of the budget goes to the levels, half to
    the leaves; the gain's sensitivity is 3."""
    out = [f"""{p}_pos AS ({order_pos(f"{draw(f'{SEED}|rows|0', 'row_id')}, row_id", f'(SELECT row_id FROM {rows} WHERE trains)')}),
{p}_s0 AS (SELECT r.*, CASE WHEN pos < (SELECT count(*) FROM {p}_pos) // 2 THEN 0 WHEN pos IS NOT NULL THEN 1 END AS tree_id,
  (SELECT avg(y) FROM {rows} WHERE trains) AS pred FROM {rows} r LEFT JOIN {p}_pos USING (row_id))"""]
    utility = f"{budget / (2 * depth)!r}::DOUBLE * gain / 6.0::DOUBLE"
    for t in range(2):
        gum = f"ln(-ln({uni(f'{SEED}|split|{t}', '0', 'node_id', 'fi', 'v', 'c')}))"
        bound = (1 - eta) ** t
        scale = f"{min(1.0 / 1.1, 2 * bound) / (budget / 2)!r}::DOUBLE"
        lap = (f"{scale} * (ln({uni(f'{SEED}|leaf|{t}|0|0', 'node_id', '1')}) - "
               f"ln({uni(f'{SEED}|leaf|{t}|0|0', 'node_id', '2')}))")
        q = f"{p}_{t}"
        out += [f"{q}_in AS (SELECT *, greatest(-1.0, least(pred - y, 1.0)) AS grad, 0::BIGINT AS node_id "
                f"FROM {p}_s{t} WHERE tree_id = {t})",
                grow(f"{q}_in", q, ALL, depth, order=f"{utility} - {gum} DESC",
                     where=f"{utility} > 0 AND nl + nr >= 2", hist=make),
                f"{q}_leaf AS (SELECT node_id, greatest(-{bound!r}::DOUBLE, least(-sum(grad) / (count(*) + 0.1::DOUBLE), "
                f"{bound!r}::DOUBLE)) + {lap} AS w FROM {q}_r{depth} GROUP BY node_id)",
                f"{q}_a0 AS (SELECT *, 0::BIGINT AS node_id FROM {p}_s{t})",
                *[routed(f"{q}_a{d}", f"{q}_b{d}", f"{q}_a{d + 1}", ALL, ["node_id"]) for d in range(depth)],
                f"{p}_s{t + 1} AS (SELECT r.* EXCLUDE (pred, node_id), r.pred + {eta!r}::DOUBLE * l.w AS pred "
                f"FROM {q}_a{depth} r JOIN {q}_leaf l USING (node_id))"]
    return out


def private_sql(depth=1, budget=4.0, scaling=0.0, grid=None):
    """Two trees of learning rate 1/2. With ``scaling`` that part of the budget pays for the bounds of
    the two numeric features, which are mapped onto the ``grid`` (lo, step, points)."""
    source, out = "planted", [f"WITH {PLANTED}"]
    if scaling:
        lo, step, size = grid
        out += [quantile_sql(["c_acctbal", "c_nationkey"], "planted", 95.0, scaling / 2, -1000.0, 10000.0),
                interval_sql(f"{SEED}|scaling")]
        maps = ", ".join(
            f"(greatest({a}.lower, least(CAST({c} AS DOUBLE), {a}.upper)) - {a}.lower) / ({a}.upper - {a}.lower) "
            f"* {step * size!r}::DOUBLE + {lo!r}::DOUBLE AS {c}" for a, c in (("a", "c_acctbal"), ("b", "c_nationkey")))
        out.append(f"scaled AS (SELECT p.* REPLACE ({maps}) FROM planted p, found a, found b "
                   "WHERE a.feature_idx = 0 AND b.feature_idx = 1)")
        source = "scaled"
    make = hist_on_grid(*grid) if grid else hist
    out += [f"whole AS (SELECT *, true AS trains FROM {source})",
            *private_trees("whole", "p", depth, budget - scaling, 0.5, make)]
    return ", ".join(out) + f" SELECT row_id, {rd('pred', 7)} AS prediction FROM p_s2"


def private_folds_sql(folds=3, depth=2, budget=2.0, eta=0.1):
    """Score per fold of two private trees on the others. The target lies in [-1, 1] already."""
    out = [f"""WITH {PLANTED}, cnt AS (SELECT count(*) AS n FROM planted),
pos AS ({order_pos(f"{draw(SEED, 'row_id')}, row_id", 'planted')}),
folded AS (SELECT * EXCLUDE (pos, n), {fold_of('pos', 'n', folds)} AS fold FROM pos, cnt)"""]
    scores = []
    for f in range(folds):
        out += [f"w{f} AS (SELECT *, fold <> {f} AS trains FROM folded)",
                *private_trees(f"w{f}", f"f{f}", depth, budget, eta)]
        scores.append(f"SELECT CAST({f} AS INTEGER) AS fold, count(*) AS n, {rd('sqrt(avg(pow(y - pred, 2)))', 7)} AS score "
                      f"FROM f{f}_s2 WHERE fold = {f}")
    return ", ".join(out) + " " + " UNION ALL ".join(scores)


def complexity_sql(sizes, folds=3, eta=0.1):
    """Percentage error per sample size and fold of one split, on targets scaled to [-1, 1]."""
    out, scores = [f"WITH {PLANTED}, costs AS (SELECT * REPLACE (y * 1000 + 2000 AS y) FROM planted)"], []
    for i, size in enumerate(sizes):
        out += [f"z{i} AS (SELECT * FROM costs ORDER BY row_id LIMIT {size})",
                f"zf{i} AS (SELECT * EXCLUDE (pos, n), {fold_of('pos', 'n', folds)} AS fold FROM (SELECT *, "
                f"row_number() OVER (ORDER BY {draw(SEED, 'row_id')}, row_id) - 1 AS pos, count(*) OVER () AS n FROM z{i}))"]
        for f in range(folds):
            q = f"z{i}_{f}"
            out += [f"{q}_m AS (SELECT 2 / (max(y) - min(y)) AS a, -1 - min(y) * (2 / (max(y) - min(y))) AS b "
                    f"FROM zf{i} WHERE fold <> {f})",
                    f"{q}_y AS (SELECT z.* REPLACE (y * a + b AS y), y AS cost FROM zf{i} z, {q}_m)",
                    f"{q}_s AS (SELECT avg(y) AS start FROM {q}_y WHERE fold <> {f})",
                    f"{q}_in AS (SELECT *, start - y AS grad, 0::BIGINT AS node_id FROM {q}_y, {q}_s WHERE fold <> {f})",
                    grow(f"{q}_in", q, ALL, 1), leaf_table(f"{q}_r1", f"{q}_leaf"),
                    f"{q}_all AS (SELECT *, 0::BIGINT AS node_id FROM {q}_y WHERE fold = {f})",
                    routed(f"{q}_all", f"{q}_b0", f"{q}_to", ALL, ["node_id"])]
            scores.append(f"SELECT CAST({size} AS INTEGER) AS n, 'cost' AS label, CAST({f} AS INTEGER) AS fold, "
                          f"{rd(f'avg(abs((cost - (start + {eta!r}::DOUBLE * w - b) / a) / cost)) * 100', 5)} AS score "
                          f"FROM {q}_to JOIN {q}_leaf USING (node_id), {q}_s, {q}_m")
    return ", ".join(out) + " " + " UNION ALL ".join(scores)


def pool_sql(mode, trees, depth, budget, eta, l2, clip=True, patience=0):
    """Trees that take their rows from a pool. ``fill``: rows whose gradient is small come first;
    ``drop``: others among the first are left to later trees; ``take`` with ``patience``: a tree is
    kept only if it lowers the error of held-out rows, else its rows go back and the next tree
    draws anew, until that many were not kept."""
    held = f"{draw(f'{SEED}|validation', 'row_id')}, row_id"
    out = [f"""WITH {PLANTED}, held AS (SELECT *, {f"row_number() OVER (ORDER BY {held}) - 1 < ceil(0.3::DOUBLE * (SELECT count(*) FROM planted))"
                                                 if patience else "false"} AS held FROM planted),
s0 AS (SELECT *, (SELECT avg(y) FROM held WHERE NOT held) AS pred, false AS used FROM held),
e0 AS (SELECT CAST('Infinity' AS DOUBLE) AS err, 0 AS lost)"""]
    budget /= patience + 1
    utility = f"{budget / (2 * depth)!r}::DOUBLE * gain / {2 * 3.0 * l2 ** 2!r}::DOUBLE"
    for t in range(trees):
        first = f"CASE WHEN abs(pred - y) > {l2!r}::DOUBLE THEN 1 ELSE 0 END, " if mode == "fill" else ""
        small = f"AND abs(pred - y) <= {l2!r}::DOUBLE" if mode == "drop" else ""
        gum = f"ln(-ln({uni(f'{SEED}|split|{t}', '0', 'node_id', 'fi', 'v', 'c')}))"
        bound = l2 * (1 - eta) ** t
        spread = min(l2 / 1.1, 2 * bound) if clip else l2 / 1.1
        lap = (f"{spread / (budget / 2)!r}::DOUBLE * (ln({uni(f'{SEED}|leaf|{t}|0|0', 'node_id', '1')}) - "
               f"ln({uni(f'{SEED}|leaf|{t}|0|0', 'node_id', '2')}))")
        value = "-sum(grad) / (count(*) + 0.1::DOUBLE)"
        if clip:
            value = f"greatest(-{bound!r}::DOUBLE, least({value}, {bound!r}::DOUBLE))"
        out += [f"""k{t}_pool AS (SELECT *, row_number() OVER (ORDER BY {first}{draw(f'{SEED}|rows|{t}', 'row_id')}, row_id) - 1 AS pos,
  count(*) OVER () AS n FROM s{t} WHERE NOT used AND NOT held)""",
                f"k{t}_in AS (SELECT * EXCLUDE (pos, n), greatest(-{l2!r}::DOUBLE, least(pred - y, {l2!r}::DOUBLE)) AS grad, "
                f"0::BIGINT AS node_id FROM k{t}_pool WHERE pos < n // {trees - t} {small})",
                grow(f"k{t}_in", f"k{t}", ALL, depth, order=f"{utility} - {gum} DESC",
                     where=f"{utility} > 0 AND nl + nr >= 2"),
                f"k{t}_leaf AS (SELECT node_id, {value} + {lap} AS w FROM k{t}_r{depth} GROUP BY node_id)",
                f"k{t}_a0 AS (SELECT *, 0::BIGINT AS node_id FROM s{t})",
                *[routed(f"k{t}_a{d}", f"k{t}_b{d}", f"k{t}_a{d + 1}", ALL, ["node_id"]) for d in range(depth)],
                f"k{t}_try AS (SELECT r.* EXCLUDE (node_id), r.pred + {eta!r}::DOUBLE * l.w AS tried "
                f"FROM k{t}_a{depth} r JOIN k{t}_leaf l USING (node_id))"]
        kept = "true"
        if patience:
            kept = f"(SELECT kept FROM e{t + 1})"
            out.append(f"""e{t + 1} AS (SELECT new < err AND lost < {patience} AS kept,
  CASE WHEN new < err AND lost < {patience} THEN new ELSE err END AS err,
  CASE WHEN new < err THEN lost ELSE lost + 1 END AS lost
  FROM e{t}, (SELECT avg(pow(tried - y, 2)) AS new FROM k{t}_try WHERE held))""")
        out.append(f"s{t + 1} AS (SELECT * EXCLUDE (tried) REPLACE (CASE WHEN {kept} THEN tried ELSE pred END AS pred, "
                   f"used OR ({kept} AND row_id IN (SELECT row_id FROM k{t}_in)) AS used) FROM k{t}_try)")
    return ", ".join(out) + f" SELECT row_id, {rd('pred', 7)} AS prediction FROM s{trees}"


def rejection_sql():
    """Three depth-1 trees, each kept only while the hold-out error falls; the hold-out rows
    are the first 30 percent by id, the start score is the mean of the others."""
    out = [f"""WITH {PLANTED}, cnt AS (SELECT count(*) AS n FROM planted), pos AS ({order_pos('row_id', 'planted')}),
s0 AS (SELECT * EXCLUDE (pos, n), pos < ceil(0.3::DOUBLE * n) AS held,
  (SELECT avg(y) FROM pos, cnt WHERE pos >= ceil(0.3::DOUBLE * n)) AS pred FROM pos, cnt),
e0 AS (SELECT CAST('Infinity' AS DOUBLE) AS err, true AS open)"""]
    for t in range(3):
        out += [f"j{t}_in AS (SELECT *, pred - y AS grad, 0::BIGINT AS node_id FROM s{t} WHERE NOT held)",
                grow(f"j{t}_in", f"j{t}", ALL, 1), leaf_table(f"j{t}_r1", f"j{t}_leaf"),
                f"j{t}_all AS (SELECT *, 0::BIGINT AS node_id FROM s{t})",
                routed(f"j{t}_all", f"j{t}_b0", f"j{t}_rall", ALL, ["node_id"]),
                f"j{t}_try AS (SELECT r.* EXCLUDE (node_id), r.pred + 0.5::DOUBLE * l.w AS tried "
                f"FROM j{t}_rall r JOIN j{t}_leaf l USING (node_id))",
                f"e{t + 1} AS (SELECT CASE WHEN open AND new < err THEN new ELSE err END AS err, open AND new < err AS open "
                f"FROM e{t}, (SELECT avg(pow(tried - y, 2)) AS new FROM j{t}_try WHERE held))",
                f"s{t + 1} AS (SELECT * EXCLUDE (tried) REPLACE (CASE WHEN (SELECT open FROM e{t + 1}) THEN tried ELSE pred END "
                f"AS pred) FROM j{t}_try)"]
    return ", ".join(out) + f" SELECT row_id, {rd('pred')} AS prediction FROM s3"
