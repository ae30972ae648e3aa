"""SQL for DuckDB that gives the rows of the catalog's queries, cell by cell and without the statistics that those use."""

from __future__ import annotations

from bitloom.sources.tables import SUPPLY

RANK, RANKS, COLUMN = 6, (4, 4, 4), 2
#: Mode length and multiplier of the arithmetic factors.
FACTORS = {"i": (SUPPLY.i, 37), "j": (SUPPLY.j, 53), "k": (SUPPLY.k, 71)}
CORE = {(a, b, c) for a in range(RANKS[0]) for b in range(RANKS[1]) for c in range(RANKS[2]) if (a * 5 + b * 3 + c * 7 + 1) % 6 == 0}

T = """t AS (SELECT DISTINCT CAST(l_suppkey % 30 AS BIGINT) AS i, CAST(l_partkey % 40 AS BIGINT) AS j,
  CAST((year(l_shipdate) * 12 + month(l_shipdate)) % 50 AS BIGINT) AS k FROM lineitem WHERE l_quantity >= 45)"""
G = """g AS (SELECT CAST(a.r AS BIGINT) AS a, CAST(b.r AS BIGINT) AS b, CAST(c.r AS BIGINT) AS c
  FROM range(4) a(r), range(4) b(r), range(4) c(r) WHERE (a.r * 5 + b.r * 3 + c.r * 7 + 1) % 6 = 0)"""


def f(c: str, rank: int = RANK, shift: int = 0) -> str:
    """f<c>: entries of a factor."""
    n, p = FACTORS[c]
    return f"f{c} AS (SELECT CAST(x.v AS BIGINT) AS idx, CAST(y.v AS BIGINT) AS r FROM range({n}) x(v), range({rank}) y(v) WHERE (x.v * {p} + y.v * 101 + {11 + 7 * shift}) % 97 < 30)"


def m(c: str, rank: int = RANK, shift: int = 0) -> str:
    """f<c> and m<c>: its bit rows."""
    n = FACTORS[c][0]
    return f"{f(c, rank, shift)}, m{c} AS (SELECT CAST(x.v AS BIGINT) AS idx, CAST(coalesce(sum(CAST(pow(2, r) AS BIGINT)), 0) AS BIGINT) AS m FROM range({n}) x(v) LEFT JOIN f{c} ON idx = x.v GROUP BY x.v)"


def listed(c: str) -> str:
    return f"coalesce(string_agg(CAST({c} AS VARCHAR), ',' ORDER BY {c}), '')"


def rows(c: str, where: str = "true") -> str:
    return f"WITH {f(c)} SELECT CAST(x.v AS BIGINT) AS idx, {listed('r')} AS cols FROM range({FACTORS[c][0]}) x(v) LEFT JOIN f{c} ON idx = x.v AND {where} GROUP BY x.v"


def columns(c: str, where: str = "true") -> str:
    return f"WITH {f(c)} SELECT CAST(y.v AS BIGINT) AS r, {listed('idx')} AS rows FROM range({RANK}) y(v) LEFT JOIN f{c} ON r = y.v AND {where} GROUP BY y.v"


MODEL = f"{f('i')}, {f('j')}, {f('k')}, x AS (SELECT DISTINCT fi.idx AS i, fj.idx AS j, fk.idx AS k FROM fi JOIN fj USING (r) JOIN fk USING (r))"
TK_MODEL = f"""{f('i', 4)}, {f('j', 4)}, {f('k', 4)}, {G}, x AS (SELECT DISTINCT fi.idx AS i, fj.idx AS j, fk.idx AS k
  FROM g JOIN fi ON fi.r = g.a JOIN fj ON fj.r = g.b JOIN fk ON fk.r = g.c)"""
MASKS = ", ".join(m(c) for c in "ijk")
TK_MASKS = ", ".join(m(c, 4) for c in "ijk")
CELL_ERROR = """SELECT CAST((SELECT count(*) FROM t) AS BIGINT) AS nnz, CAST((SELECT count(*) FROM x) AS BIGINT) AS recon_nnz,
  CAST((SELECT count(*) FROM t JOIN x USING (i, j, k)) AS BIGINT) AS hits,
  CAST((SELECT count(*) FROM t FULL JOIN x ON t.i = x.i AND t.j = x.j AND t.k = x.k WHERE t.i IS NULL OR x.i IS NULL) AS BIGINT) AS abs_error,
  (SELECT count(*) FROM t FULL JOIN x ON t.i = x.i AND t.j = x.j AND t.k = x.k WHERE t.i IS NULL OR x.i IS NULL) / 60000.0::DOUBLE AS rel_error"""


def deltas(mode: int, tucker: bool) -> str:
    """CTEs up to d (idx, m, d): each cell that only the column's bit can cover adds 1, or takes 1 if it is a nonzero."""
    row, p, q = {1: "ijk", 2: "jik", 3: "kij"}[mode]
    if tucker:
        at = dict(zip("ijk", "abc", strict=True))
        has = lambda c: f"(m{c}.m >> CAST({at[c]} AS INT)) % 2 = 1"
        w = f"SELECT m{p}.idx AS {p}, m{q}.idx AS {q}, CAST(bit_or(CAST(pow(2, {at[row]}) AS BIGINT)) AS BIGINT) AS w FROM m{p}, m{q}, g WHERE {has(p)} AND {has(q)} GROUP BY 1, 2"
    else:
        w = f"SELECT m{p}.idx AS {p}, m{q}.idx AS {q}, m{p}.m & m{q}.m AS w FROM m{p}, m{q}"
    b = 1 << COLUMN
    start = f"{T}, {TK_MASKS}, {G}" if tucker else f"{T}, {MASKS}"
    return f"""WITH {start}, w AS ({w}), d AS (SELECT m{row}.idx, any_value(m{row}.m) AS m,
  CAST(coalesce(sum(CASE WHEN w.w IS NULL THEN 0 WHEN t.i IS NULL THEN 1 ELSE -1 END), 0) AS BIGINT) AS d
  FROM m{row} LEFT JOIN w ON (w.w & {b}) <> 0 AND (m{row}.m & w.w & ~CAST({b} AS BIGINT)) = 0
  LEFT JOIN t ON t.{row} = m{row}.idx AND t.{p} = w.{p} AND t.{q} = w.{q} GROUP BY m{row}.idx)"""


CHOICE = f"""{deltas(1, False)}, c AS (SELECT idx, m, d, (m >> {COLUMN}) % 2 AS old, CASE WHEN d < 0 THEN 1 ELSE 0 END AS b FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, idx) AS place, count(*) OVER (PARTITION BY b) AS n FROM c),
  u AS (SELECT idx, d, CAST(old AS BIGINT) AS old, m AS was, CAST(CASE WHEN b = 0 AND place <= n - 15 THEN 1 ELSE b END AS BIGINT) AS bit FROM k)"""
NEW = f"CAST((was & ~CAST({1 << COLUMN} AS BIGINT)) | (bit * {1 << COLUMN}) AS BIGINT)"
#: For each row, whether its column r is set and how many used columns of the core it has.
SUPPORT = f"""{T}, {TK_MASKS}, {G}, u AS (SELECT CAST(bit_or(CAST(pow(2, a) AS BIGINT)) AS BIGINT) AS i,
  CAST(bit_or(CAST(pow(2, b) AS BIGINT)) AS BIGINT) AS j, CAST(bit_or(CAST(pow(2, c) AS BIGINT)) AS BIGINT) AS k FROM g)"""
FIRST = min(CORE)



SPLIT = "SELECT CAST(v AS BIGINT) AS part, CAST({s} + v * {n} // {p} AS BIGINT) AS lo, CAST({s} + (v + 1) * {n} // {p} - 1 AS BIGINT) AS hi FROM range({p}) x(v)"

SQL: dict[str, str] = {
    "parse_coo": f"WITH {T} SELECT i + 1 AS i, j + 1 AS j, k + 1 AS k FROM t",
    "parse_coo_strict": f"WITH {T} SELECT i + 1 AS i, j + 1 AS j, k + 1 AS k FROM t",
    "to_base0": f"WITH {T} SELECT i, j, k FROM t",
    "tensor_text": f"WITH {T} SELECT concat(i + 1, ',', j + 1, ',', k + 1) AS value FROM t",
    "factor_dense": f"WITH {f('i')} SELECT CAST(x.v AS BIGINT) AS idx, string_agg(CASE WHEN r IS NULL THEN '0' ELSE '1' END, '' ORDER BY y.v) AS value FROM range(30) x(v) CROSS JOIN range({RANK}) y(v) LEFT JOIN fi ON idx = x.v AND r = y.v GROUP BY x.v",
    "factor_sparse": f"WITH {f('j')} SELECT concat(idx + 1, chr(9), r + 1) AS value FROM fj",
    "core_sparse": f"WITH {G} SELECT concat(a + 1, chr(9), b + 1, chr(9), c + 1) AS value FROM g",
    "unfold_mode1": f'WITH {T} SELECT i AS "row", j + k * 40 AS col FROM t',
    "unfold_mode2": f'WITH {T} SELECT j AS "row", i + k * 30 AS col FROM t',
    "unfold_mode3": f'WITH {T} SELECT k AS "row", i + j * 30 AS col FROM t',
    "unfold_core": f'WITH {G} SELECT a AS "row", b + c * 4 AS col FROM g',
    "events_tensor": "SELECT DISTINCT CAST(user_id % 40 AS BIGINT) AS i, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT) AS j, CAST(hour(ts) AS BIGINT) AS k FROM events WHERE value >= 110",
    "nnz": f"WITH {T} SELECT count(*) AS n FROM t",
    "slice_counts": f"WITH {T} SELECT CAST(1 AS BIGINT) AS mode, i AS idx, count(*) AS cnt FROM t GROUP BY i UNION ALL SELECT 2, j, count(*) FROM t GROUP BY j UNION ALL SELECT 3, k, count(*) FROM t GROUP BY k",
    "row_pieces": f'WITH {T} SELECT k AS block, i AS "row", {listed("j")} AS cols FROM t GROUP BY k, i',
    "matrix_transpose": f"WITH {f('i')} SELECT r AS idx, idx AS r FROM fi",
    "matrix_rowwise": rows("i"),
    "matrix_colwise": columns("i"),
    "sparse_to_dense": f"WITH {f('k')} SELECT CAST(x.v AS BIGINT) AS idx, CAST(y.v AS BIGINT) AS r, CAST(CASE WHEN r IS NULL THEN 0 ELSE 1 END AS BIGINT) AS v FROM range(50) x(v) CROSS JOIN range({RANK}) y(v) LEFT JOIN fk ON idx = x.v AND r = y.v",
    "dense_to_sparse": f"WITH {f('k')} SELECT idx, r FROM fk",
    "bit_rows": f"WITH {m('j')} SELECT idx, m FROM mj",
    "bit_rows_to_sparse": f"WITH {f('j')} SELECT idx, r FROM fj",
    "num_unique_columns": f"WITH {f('j')} SELECT count(DISTINCT c) AS n FROM (SELECT {listed('idx')} AS c FROM fj GROUP BY r)",
    "bit_masks": "SELECT CAST(v * 2 AS BIGINT) AS m FROM range(8) x(v)",
    "set_bits": f"WITH {m('i')} SELECT idx, CAST((m & ~CAST(14 AS BIGINT)) | ((idx % 8) * 2) AS BIGINT) AS m, CAST(bit_count(xor(m, (m & ~CAST(14 AS BIGINT)) | ((idx % 8) * 2))) AS BIGINT) AS changed FROM mi",
    "get_bits": f"WITH {m('i')} SELECT idx, CAST((m // 4) % 8 AS BIGINT) AS v FROM mi",
    "num_zeros_table": "SELECT CAST(v AS BIGINT) AS v, CAST(5 - bit_count(v) AS BIGINT) AS zeros FROM range(32) x(v)",
    "split_bit_row": f"WITH {f('i')} SELECT idx, r // 3 AS part, CAST(sum(CAST(pow(2, r % 3) AS BIGINT)) AS BIGINT) AS v FROM fi GROUP BY idx, r // 3",
    "slice_rowwise": rows("i", "r BETWEEN 1 AND 3"),
    "colwise_in_range": columns("i", "idx BETWEEN 5 AND 14"),
    "mask_join": f"WITH {T}, {MASKS} SELECT i, j, k, mi.m AS m_i, mj.m AS m_j, mk.m AS m_k FROM t JOIN mi ON mi.idx = i JOIN mj ON mj.idx = j JOIN mk ON mk.idx = k",
    "cp_reconstruct": f"WITH {MODEL} SELECT i, j, k FROM x",
    "tucker_reconstruct": f"WITH {TK_MODEL} SELECT i, j, k FROM x",
    "recon_contains": f"WITH {T}, {TK_MODEL} SELECT t.i, t.j, t.k, CAST(CASE WHEN x.i IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has FROM t LEFT JOIN x ON t.i = x.i AND t.j = x.j AND t.k = x.k",
    "sum_abs_diff": f"WITH {T}, {MODEL}, o AS (SELECT t.i IS NOT NULL AS a, x.i IS NOT NULL AS b FROM t FULL JOIN x ON t.i = x.i AND t.j = x.j AND t.k = x.k) SELECT CAST(count_if(a <> b) AS BIGINT) AS abs_diff, CAST(count_if(a AND NOT b) AS BIGINT) AS only_a, CAST(count_if(b AND NOT a) AS BIGINT) AS only_b, CAST(count_if(a AND b) AS BIGINT) AS both FROM o",
    "sq_frobenius": f"WITH {T}, {MODEL} SELECT CAST(count(*) AS BIGINT) AS sq_diff FROM t FULL JOIN x ON t.i = x.i AND t.j = x.j AND t.k = x.k WHERE t.i IS NULL OR x.i IS NULL",
    "tensor_semi": f"WITH {T}, {MODEL} SELECT t.i, t.j, t.k FROM t SEMI JOIN x USING (i, j, k)",
    "tensor_anti": f"WITH {T}, {MODEL} SELECT t.i, t.j, t.k FROM t ANTI JOIN x USING (i, j, k)",
    "tensor_except": f"WITH {T}, {MODEL} SELECT i, j, k FROM x EXCEPT SELECT i, j, k FROM t",
    "tensor_intersect": f"WITH {T}, {MODEL} SELECT i, j, k FROM x INTERSECT SELECT i, j, k FROM t",
    "factor_row_summary": f"WITH {f('i', 4)}, {G} SELECT CAST(x.v AS BIGINT) AS idx, count(r) AS s FROM range(30) x(v) LEFT JOIN fi ON idx = x.v AND r IN (SELECT a FROM g) GROUP BY x.v",
    "row_summation": f"WITH {f('j')}, s AS (SELECT DISTINCT CAST(x.v AS BIGINT) AS m, idx FROM range({1 << RANK}) x(v) JOIN fj ON (x.v >> CAST(r AS INT)) % 2 = 1) SELECT m, {listed('idx')} AS rows FROM s GROUP BY m",
    "merge_rows": f"WITH {f('j')}, s AS (SELECT DISTINCT idx % 5 AS key, r FROM fj) SELECT key, {listed('r')} AS cols FROM s GROUP BY key",
    "row_distance": f"WITH {f('i')}, {f('j')} SELECT CAST(x.v AS BIGINT) AS idx, CAST(count_if((fi.r IS NULL) <> (fj.r IS NULL)) AS BIGINT) AS dist FROM range(30) x(v) CROSS JOIN range({RANK}) y(v) LEFT JOIN fi ON fi.idx = x.v AND fi.r = y.v LEFT JOIN fj ON fj.idx = x.v AND fj.r = y.v GROUP BY x.v",
    "cp_error": f"WITH {T}, {MODEL} {CELL_ERROR}",
    "tk_error": f"WITH {T}, {TK_MODEL} {CELL_ERROR}",
    "argmin_column": f"{deltas(1, False)} SELECT idx, CAST(CASE WHEN d < 0 THEN 1 ELSE 0 END AS BIGINT) AS bit FROM d",
    "zero_cap": f"{CHOICE} SELECT idx, bit FROM u",
    "cp_column_update": f"{CHOICE} SELECT idx, d, old, bit, {NEW} AS m FROM u",
    "cp_column_delta": f"{CHOICE} SELECT CAST(sum(d * (bit - old)) AS BIGINT) AS delta FROM u",
    "cp_bit_updates": f"{CHOICE} SELECT CAST(sum(bit_count(xor(was, {NEW}))) AS BIGINT) AS bit_updates FROM u",
    "tk_cell_masks": f"WITH {TK_MASKS}, {G} SELECT mj.idx AS j, mk.idx AS k, CAST(bit_or(CAST(pow(2, a) AS BIGINT)) AS BIGINT) AS w FROM mj, mk, g WHERE (mj.m >> CAST(b AS INT)) % 2 = 1 AND (mk.m >> CAST(c AS INT)) % 2 = 1 GROUP BY 1, 2",
    "core_gain_add": f"WITH {SUPPORT} SELECT CAST(count(*) > 0 AS BIGINT) AS gain FROM t JOIN mi ON mi.idx = t.i JOIN mj ON mj.idx = t.j JOIN mk ON mk.idx = t.k CROSS JOIN u WHERE mi.m % 2 = 1 AND mj.m % 2 = 1 AND mk.m % 2 = 1 AND ((mi.m & u.i) = 0 OR (mj.m & u.j) = 0 OR (mk.m & u.k) = 0)",
    "core_gain_remove": f"WITH {SUPPORT} SELECT CAST(count(*) > 0 AS BIGINT) AS gain FROM mi, mj, mk, u WHERE (mi.m >> {FIRST[0]}) % 2 = 1 AND (mj.m >> {FIRST[1]}) % 2 = 1 AND (mk.m >> {FIRST[2]}) % 2 = 1 AND bit_count(mi.m & u.i) = 1 AND bit_count(mj.m & u.j) = 1 AND bit_count(mk.m & u.k) = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.i = mi.idx AND t.j = mj.idx AND t.k = mk.idx)",
    "column_blocks": f'WITH {T}, p AS (SELECT v AS part, v * 2000 // 7 AS lo, (v + 1) * 2000 // 7 AS hi FROM range(7) x(v)) SELECT i AS "row", j + k * 40 AS col, CAST(part AS BIGINT) AS part, k AS block, j AS place FROM t JOIN p ON j + k * 40 >= lo AND j + k * 40 < hi',
    "input_ranges": f"WITH {T}, p AS (SELECT CAST(v AS BIGINT) AS part, CAST(v * 30 // 7 AS BIGINT) AS lo, CAST((v + 1) * 30 // 7 - 1 AS BIGINT) AS hi FROM range(7) x(v)) SELECT part, lo, hi, count(t.i) AS cnt FROM p LEFT JOIN t ON t.i BETWEEN lo AND hi GROUP BY part, lo, hi",
    "split_max_size": SPLIT.format(s=3, n=38, p=5),
    "split_num": SPLIT.format(s=3, n=38, p=9),
}
SQL |= {f"{'tk' if tk else 'cp'}_error_delta_mode{n}": f"{deltas(n, tk)} SELECT idx, d FROM d" for n in (1, 2, 3) for tk in (False, True)}
SQL["best_candidate"] = "WITH e AS (" + " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS candidate, (SELECT abs_error FROM (WITH {T}, {', '.join(f(c, shift=k) for c in 'ijk')}, x AS (SELECT DISTINCT fi.idx AS i, fj.idx AS j, fk.idx AS k FROM fi JOIN fj USING (r) JOIN fk USING (r)) {CELL_ERROR})) AS abs_error" for k in range(3)
) + ") SELECT candidate, abs_error FROM e ORDER BY abs_error, candidate LIMIT 1"


def factor_update() -> str:
    """All columns of mode 1 in turn, ties to 0, at most 28 of 30 zeros: each cell counted anew for each column."""
    steps = [f"WITH {T}, {MASKS}, w AS MATERIALIZED (SELECT mj.idx AS j, mk.idx AS k, mj.m & mk.m AS w FROM mj, mk), n0 AS (SELECT idx, m FROM mi)"]
    for r in range(RANK):
        b = 1 << r
        steps.append(f"""d{r} AS (SELECT n.idx, any_value(n.m) AS m, coalesce(sum(CASE WHEN w.w IS NULL THEN 0 WHEN t.i IS NULL THEN 1 ELSE -1 END), 0) AS d
  FROM n{r} n LEFT JOIN w ON (w.w & {b}) <> 0 AND (n.m & w.w & ~CAST({b} AS BIGINT)) = 0 LEFT JOIN t ON t.i = n.idx AND t.j = w.j AND t.k = w.k GROUP BY n.idx),
  k{r} AS (SELECT *, row_number() OVER (PARTITION BY d < 0 ORDER BY d, idx) AS place, count(*) OVER (PARTITION BY d < 0) AS n FROM d{r}),
  n{r + 1} AS MATERIALIZED (SELECT idx, (m & ~CAST({b} AS BIGINT)) | CASE WHEN d < 0 OR place <= n - 28 THEN {b} ELSE 0 END AS m FROM k{r})""")
    return ",\n  ".join(steps) + f" SELECT idx, CAST(m AS BIGINT) AS m FROM n{RANK}"


def core_sweep() -> str:
    """The elements of the core in turn, each decided on the cells of the tensor with the core as it is then."""
    cells = """x AS MATERIALIZED (SELECT mi.m AS x, mj.m AS y, mk.m AS z, t.i IS NOT NULL AS one FROM mi CROSS JOIN mj CROSS JOIN mk
  LEFT JOIN t ON t.i = mi.idx AND t.j = mj.idx AND t.k = mk.idx)"""
    steps = [f"WITH {T}, {TK_MASKS}, {G}, {cells}, g0 AS (SELECT a, b, c FROM g)"]
    for n, (a, b, c) in enumerate((a, b, c) for a in range(RANKS[0]) for b in range(RANKS[1]) for c in range(RANKS[2])):
        at = f"a = {a} AND b = {b} AND c = {c}"
        used = ", ".join(f"CAST(coalesce(bit_or(CAST(pow(2, {e}) AS BIGINT)), 0) AS BIGINT) AS {u}" for e, u in zip("abc", "pqr", strict=True))
        here = f"(x >> {a}) % 2 = 1 AND (y >> {b}) % 2 = 1 AND (z >> {c}) % 2 = 1"
        steps.append(f"""u{n} AS (SELECT {used}, count_if({at}) > 0 AS has FROM g{n}),
  f{n} AS MATERIALIZED (SELECT any_value(has) AS has, bool_or(CASE WHEN has THEN NOT one AND bit_count(x & p) = 1 AND bit_count(y & q) = 1 AND bit_count(z & r) = 1
    ELSE one AND ((x & p) = 0 OR (y & q) = 0 OR (z & r) = 0) END) FILTER ({here}) AS flip FROM x, u{n}),
  g{n + 1} AS MATERIALIZED (SELECT a, b, c FROM g{n} WHERE NOT ({at}) UNION ALL SELECT CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT) FROM f{n} WHERE has <> coalesce(flip, false))""")
    return ",\n  ".join(steps) + f" SELECT CAST(a AS INTEGER) AS r1, CAST(b AS INTEGER) AS r2, CAST(c AS INTEGER) AS r3 FROM g{n + 1}"


def wide_mask(c: str, n: str) -> str:
    p = FACTORS[c][1]
    ones = " + ".join(f"CASE WHEN (v * {p} + {r * 101 + 11}) % 97 < 30 THEN {1 << r} ELSE 0 END" for r in range(RANK))
    return f"m{c} AS MATERIALIZED (SELECT CAST(v AS BIGINT) AS idx, CAST({ones} AS BIGINT) AS m FROM range((SELECT {n} FROM l)) x(v))"


WIDE_T = """t AS MATERIALIZED (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j,
  CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1 AS BIGINT) AS k FROM lineitem)"""
WIDE = f"""{WIDE_T}, l AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk FROM t),
  {", ".join(wide_mask(c, f"n{c}") for c in "ijk")}"""
WIDE_D = f"""w AS MATERIALIZED (SELECT mi.m & mk.m AS w, count(*) AS n FROM mi, mk GROUP BY 1),
  h AS (SELECT mj.idx, sum(w.n) AS n FROM mj JOIN w ON (w.w & {1 << COLUMN}) <> 0 AND (mj.m & w.w & ~CAST({1 << COLUMN} AS BIGINT)) = 0 GROUP BY 1),
  o AS (SELECT t.j AS idx, count(*) AS n FROM t JOIN mi ON mi.idx = t.i JOIN mj ON mj.idx = t.j JOIN mk ON mk.idx = t.k
    WHERE (mi.m & mk.m & {1 << COLUMN}) <> 0 AND (mi.m & mj.m & mk.m & ~CAST({1 << COLUMN} AS BIGINT)) = 0 GROUP BY 1),
  d AS (SELECT mj.idx, mj.m, CAST(coalesce(h.n, 0) - 2 * coalesce(o.n, 0) AS BIGINT) AS d FROM mj LEFT JOIN h USING (idx) LEFT JOIN o USING (idx))"""

SQL["cp_factor_update"] = factor_update()
SQL["core_update"] = core_sweep()
SQL["wide_slice_counts"] = f"WITH {WIDE_T} SELECT CAST(1 AS BIGINT) AS mode, i AS idx, count(*) AS cnt FROM t GROUP BY i UNION ALL SELECT 2, j, count(*) FROM t GROUP BY j UNION ALL SELECT 3, k, count(*) FROM t GROUP BY k"
SQL["wide_error"] = f"""WITH {WIDE}, s AS (SELECT count(*) AS nnz, count_if((mi.m & mj.m & mk.m) <> 0) AS hits FROM t JOIN mi ON mi.idx = i JOIN mj ON mj.idx = j JOIN mk ON mk.idx = k),
  x AS (SELECT count(*) AS n FROM mi, mj, mk WHERE (mi.m & mj.m & mk.m) <> 0)
SELECT nnz, CAST(n AS BIGINT) AS recon_nnz, CAST(hits AS BIGINT) AS hits, CAST(nnz + n - 2 * hits AS BIGINT) AS abs_error, (nnz + n - 2 * hits) / CAST(ni * nj * nk AS DOUBLE) AS rel_error FROM s, x, l"""
SQL["wide_error_delta"] = f"WITH {WIDE}, {WIDE_D} SELECT idx, d FROM d"
SQL["wide_column_update"] = f"""WITH {WIDE}, {WIDE_D}, c AS (SELECT *, CASE WHEN d < 0 THEN 1 ELSE 0 END AS b FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, idx) AS place, count(*) OVER (PARTITION BY b) AS n FROM c),
  u AS (SELECT idx, d, CAST((m >> {COLUMN}) % 2 AS BIGINT) AS old, m, CAST(CASE WHEN b = 0 AND place <= n - nj // 2 THEN 1 ELSE b END AS BIGINT) AS bit FROM k, l)
SELECT idx, d, old, bit, CAST((m & ~CAST({1 << COLUMN} AS BIGINT)) | (bit * {1 << COLUMN}) AS BIGINT) AS m FROM u"""
