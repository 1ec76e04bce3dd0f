"""SQL counterparts of the registered queries, for a plain SQL database.

They share the constants and the derived click log with the queries, and nothing else: distances,
hashes, random numbers and training are written out in SQL.
"""

from __future__ import annotations

from millrace.functions import hashing, uniform
from millrace.plans.table_queries import (
    BUCKETS,
    CLICKLOG_COLUMNS,
    DECLARED_ROWS,
    FAR,
    FRACTION,
    K,
    MISSING_INT,
    MIXTURE,
    PART_MIXTURE_D,
    ROUNDS,
    SAMPLE_SIZE,
    SEED,
    SPARSE_THRESHOLD,
    WIDE_BUCKETS,
    WIDE_PARTS,
)
from millrace.sources.clicklog import CAT_COLS, INT_COLS

# --- points and training -------------------------------------------------------------------------

POINTS = "pts AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def _initial(k: int) -> str:
    return f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS INTEGER) AS cid,
         x AS c
  FROM (SELECT * FROM pts ORDER BY md5('{SEED}:' || vec_id), vec_id LIMIT {k}))"""


INIT = _initial(K)


def _distance(a: str, b: str) -> str:
    return f"list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip({a}, {b})])"


def _nearest(centers: str) -> str:
    return f"""SELECT vec_id, any_value(x) AS x, arg_min(cid, (d, cid)) AS cid, min(d) AS d
  FROM (SELECT vec_id, x, cid, {_distance('x', 'c')} AS d FROM pts, {centers})
  GROUP BY vec_id"""


def _rounds(n: int) -> str:
    """CTEs c1 … cn; `l{i}` is the long form of the centers after round i."""
    parts = []
    for i in range(1, n + 1):
        parts.append(f"a{i} AS ({_nearest(f'c{i - 1}')})")
        parts.append(
            f"""l{i} AS (
  SELECT cid, dim, sum(v) / count(*) AS m, count(*) AS n
  FROM (SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a{i})
  GROUP BY cid, dim)"""
        )
        parts.append(f"c{i} AS (SELECT cid, list(m ORDER BY dim) AS c FROM l{i} GROUP BY cid)")
    return ",\n".join(parts)


_WITH_TRAINING = f"WITH {POINTS},\n{INIT},\n{_rounds(ROUNDS)}"
_TRAINED = f"""{_WITH_TRAINING}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(m, 6) + 0.0 AS x FROM l{ROUNDS}"""

_BY_LABEL = f"""WITH {POINTS}, parts AS (
  SELECT label AS cid, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM pts)
SELECT cid, CAST(dim AS INTEGER) AS dim, round({{value}}, 6) + 0.0 AS x, count(*) AS n
FROM parts GROUP BY cid, dim"""

_PAIRS = f"""{POINTS}, pairs AS (
  SELECT l.vec_id, l.x AS a, r.x AS b FROM pts l JOIN pts r ON r.vec_id = l.vec_id + 1)"""


def _sparse(v: str) -> str:
    return f"[CASE WHEN abs(e) > {SPARSE_THRESHOLD} THEN e ELSE 0.0 END for e in {v}]"


def _pair_distance(a: str, b: str) -> str:
    return f"WITH {_PAIRS} SELECT vec_id, round({_distance(a, b)}, 6) + 0.0 AS d FROM pairs"


# --- click log -----------------------------------------------------------------------------------

CLICKLOG = "clicklog AS (SELECT " + ",\n".join(CLICKLOG_COLUMNS) + " FROM events)"
FILLED = (
    "filled AS (SELECT event_id, label, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in INT_COLS)
    + ", "
    + ", ".join(CAT_COLS)
    + " FROM clicklog)"
)


def _token(i: int) -> str:
    return f"'{i}:' || coalesce({CAT_COLS[i]}, '')"


TOKENS = (
    "tokens AS (SELECT event_id, unnest(["
    + ", ".join(_token(i) for i in range(len(CAT_COLS)))
    + "]) AS token FROM clicklog)"
)
TOKENS_DROP = (
    "tokens AS (SELECT event_id, token FROM (SELECT event_id, unnest(["
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {_token(i)} END" for i, c in enumerate(CAT_COLS))
    + "]) AS token FROM clicklog) WHERE token IS NOT NULL)"
)

_MASK = "4294967295::UBIGINT"


def _u(value: int) -> str:
    return f"{value}::UBIGINT"


def _rot(x: str, r: int) -> str:
    return f"((({x} << {r}) | ({x} >> {32 - r})) & {_MASK})"


def _byte(at: str) -> str:
    return f"substr(hx, CAST(2 * ({at}) + 1 AS INTEGER), 2)"


def _times(x: str, factor: int) -> str:
    return f"(({x} * {_u(factor)}) & {_MASK})"


def _mix_column(inner: str, column: str) -> str:
    """Nested selects that replace UBIGINT ``column`` by its mixed value."""
    one = f"SELECT * REPLACE ({_times(column, hashing.MIX_1)} AS {column}) FROM ({inner})"
    two = f"SELECT * REPLACE ({_rot(column, 15)} AS {column}) FROM ({one})"
    return f"SELECT * REPLACE ({_times(column, hashing.MIX_2)} AS {column}) FROM ({two})"


def _hash_ctes() -> str:
    """CTE `hashes(token, hash)`: 32-bit MurmurHash3 of every distinct token."""
    block = " || ".join(_byte(f"4 * b + {i}") for i in (3, 2, 1, 0))
    tail = "".join(
        f" + CASE WHEN n % 4 > {i} THEN (('0x' || {_byte(f'4 * (n // 4) + {i}')})::UBIGINT) "
        f"* {_u(256 ** i)} ELSE {_u(0)} END"
        for i in range(3)
    )
    step = _rot("xor(h, k)", 13)
    chunks = f"""SELECT token, n, hx, {_u(0)}{tail} AS t,
      [('0x' || {block})::UBIGINT for b in range(0, n // 4)] AS ks
    FROM (SELECT token, octet_length(encode(token)) AS n, hex(encode(token)) AS hx
          FROM (SELECT DISTINCT token FROM tokens))"""
    mixed = f"""SELECT * REPLACE ([{_times('k', hashing.MIX_2)} for k in
      [{_rot('k', 15)} for k in [{_times('k', hashing.MIX_1)} for k in ks]]] AS ks)
    FROM ({chunks})"""
    with_tail = _mix_column(mixed, "t")
    body = f"""SELECT token, xor(xor(list_reduce(ks, lambda h, k:
        ({step} * {_u(hashing.STEP_FACTOR)} + {_u(hashing.STEP_ADD)}) & {_MASK},
        {_u(hashing.HASH_SEED)}), t), n::UBIGINT) AS h
    FROM ({with_tail})"""
    f1 = f"SELECT token, {_times('xor(h, h >> 16)', hashing.FINAL_1)} AS h FROM ({body})"
    f2 = f"SELECT token, {_times('xor(h, h >> 13)', hashing.FINAL_2)} AS h FROM ({f1})"
    f3 = f"SELECT token, xor(h, h >> 16)::BIGINT AS h FROM ({f2})"
    return f"""hashes AS (SELECT token,
  CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM ({f3}))"""


HASHES = _hash_ctes()
ENTRIES = f"""entries AS (
  SELECT event_id, CAST(abs(hash) % {BUCKETS} AS INTEGER) AS idx,
         CAST(sum(CASE WHEN hash >= 0 THEN 1 ELSE -1 END) AS INTEGER) AS val
  FROM tokens JOIN hashes USING (token)
  GROUP BY 1, 2 HAVING sum(CASE WHEN hash >= 0 THEN 1 ELSE -1 END) <> 0)"""

STATS = (
    "stats AS (SELECT "
    + ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(INT_COLS, 1))
    + " FROM filled)"
)


def _z(j: int) -> str:
    return f"CASE WHEN s{j} = 0 THEN 0.0 ELSE (i{j} - m{j}) / s{j} END"


_INTS = range(1, len(INT_COLS) + 1)
ZSCORES = (
    "zscores AS (SELECT event_id, label, "
    + ", ".join(f"{_z(j)} AS z{j}" for j in _INTS)
    + " FROM filled, stats)"
)
_PREP = f"WITH {CLICKLOG}, {FILLED}, {TOKENS}, {HASHES}, {ENTRIES}, {STATS}, {ZSCORES}"
_LABEL = "CASE WHEN label <= 0 THEN -1 ELSE 1 END"
_SHIFT = len(INT_COLS) + 1
VECTORS = (
    "vectors AS (SELECT event_id, label, unnest(["
    + ", ".join(f"z{j}" for j in _INTS)
    + "]) AS val, CAST(unnest(["
    + ", ".join(str(j) for j in _INTS)
    + f"""]) AS INTEGER) AS idx FROM zscores
  UNION ALL
  SELECT event_id, label, val::DOUBLE, idx + {_SHIFT} FROM entries JOIN clicklog USING (event_id))"""
)


def _declared() -> str:
    parts = []
    for c in INT_COLS:
        mean = f"(sum({c})::DOUBLE / {DECLARED_ROWS})"
        square = f"(sum({c} * {c})::DOUBLE - 2 * {mean} * sum({c}) + count(*) * {mean} * {mean})"
        parts.append(f"round({mean}, 6) AS mean_{c}")
        parts.append(f"round(sqrt({square} / {DECLARED_ROWS}), 6) AS std_{c}")
    return ", ".join(parts)


# --- sampling and random numbers -----------------------------------------------------------------


def _uniform(key: str, part: int) -> str:
    digest = f"md5('{SEED}:' || {key} || '#{part}')"
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_POISSON = f"""(SELECT list(p) FROM (
  SELECT sum(exp(-{FRACTION}::DOUBLE) * pow({FRACTION}::DOUBLE, n) / factorial(CAST(n AS INTEGER)))
         OVER (ORDER BY n) AS p FROM range(18) r(n)))"""


def _copies(key: str) -> str:
    """How many cumulative Poisson probabilities the uniform reaches; the 18th is 1 but for 1e-13."""
    return f"len(list_filter({_POISSON}, lambda s: s <= {_uniform(key, 0)}))"


_WRAP = "18446744073709551616::HUGEINT"


def _signed(u: str) -> str:
    return f"CAST(CASE WHEN {u} >= 9223372036854775808::HUGEINT THEN {u} - {_WRAP} ELSE {u} END AS BIGINT)"


def _unsigned(s: str) -> str:
    return f"(CASE WHEN {s} < 0 THEN {s}::HUGEINT + {_WRAP} ELSE {s}::HUGEINT END)"


def _with_uniform(source: str, position: str) -> str:
    """Adds `u`, the uniform at ``position``, to the rows of ``source``."""

    def right(q: str, s: int) -> str:
        return f"SELECT * REPLACE (xor(w, w >> {s}) AS w) FROM ({q})"

    def left(q: str, s: int) -> str:
        moved = f"(({_unsigned('w')} % {2 ** (64 - s)}::HUGEINT) * {2 ** s}::HUGEINT)"
        q = f"SELECT *, {moved} AS wl FROM ({q})"
        return f"SELECT * EXCLUDE (wl) REPLACE (xor(w, {_signed('wl')}) AS w) FROM ({q})"

    def multiply(q: str, factor: int, add: int) -> str:
        product = f"(({_unsigned('w')} * {factor}::HUGEINT + {add}::HUGEINT) % {_WRAP})"
        q = f"SELECT *, {product} AS wl FROM ({q})"
        return f"SELECT * EXCLUDE (wl) REPLACE ({_signed('wl')} AS w) FROM ({q})"

    q = f"SELECT *, CAST({position} + {SEED} AS BIGINT) AS w FROM ({source})"
    q = multiply(q, uniform.FACTOR_1, uniform.OFFSET_1)
    a, b, c = uniform.SHIFTS_1
    q = right(left(right(q, a), b), c)
    q = multiply(q, uniform.FACTOR_2, 0)
    a, b, c = uniform.SHIFTS_2
    q = left(right(left(q, a), b), c)
    return f"SELECT * EXCLUDE (w), w::DOUBLE * {uniform.SCALE!r}::DOUBLE + 0.5 AS u FROM ({q})"


_PART_CENTERS = _with_uniform(
    f"""SELECT p_partkey, CAST(dim AS INTEGER) AS dim
      FROM part, range(1, {PART_MIXTURE_D + 1}) r(dim)""",
    f"p_partkey * {PART_MIXTURE_D} + dim - 1",
)
_PART_SIGMAS = _with_uniform(
    "SELECT p_partkey, (SELECT count(*) FROM part) AS k FROM part",
    f"k * {PART_MIXTURE_D} + p_partkey",
)

_M = MIXTURE
_SLOTS = 2 + 2 * _M.d
def _generated(source: str) -> str:
    """CTEs of the generator for the ids `o_orderkey` of ``source``."""
    return f"""
mc AS ({_with_uniform(
    f"SELECT cid, dim FROM range({_M.k}) r(cid), range(1, {_M.d + 1}) s(dim)",
    f"cid * {_M.d} + dim - 1")}),
ms AS ({_with_uniform(f"SELECT cid FROM range({_M.k}) r(cid)", f"{_M.k * _M.d} + cid")}),
draws AS ({_with_uniform(
    f"SELECT o_orderkey, slot FROM {source}, range({_SLOTS}) r(slot)",
    f"{_M.k * (_M.d + 1)} + o_orderkey * {_SLOTS} + slot")}),
heads AS (
  SELECT o_orderkey,
         CAST(least(floor(max(u) FILTER (slot = 0) * {_M.k}), {_M.k - 1}) AS BIGINT) AS true_cid,
         max(u) FILTER (slot = 1) >= {1.0 - _M.noise!r}::DOUBLE AS is_noise
  FROM draws GROUP BY o_orderkey),
pairs AS (
  SELECT o_orderkey, slot // 2 AS dim,
         max(u) FILTER (slot % 2 = 0) AS u1, max(u) FILTER (slot % 2 = 1) AS u2
  FROM draws WHERE slot >= 2 GROUP BY 1, 2)"""


_GENERATED = _generated("orders")
#: As many ids from 0 as there are orders.
_NUMBERED = _generated("(SELECT row_number() OVER () - 1 AS o_orderkey FROM orders) o")

# --- run log -------------------------------------------------------------------------------------

RUNLOG = """experiment AS (SELECT p_partkey AS id, p_brand AS suite, p_name AS name FROM part),
run AS (SELECT l_partkey AS experiment_id, l_linenumber AS run,
               CAST(floor(l_extendedprice) AS BIGINT) AS time FROM lineitem),
joined AS (SELECT suite, name, run, time FROM experiment, run WHERE id = experiment_id)"""

_PENDING = """pending AS (
  SELECT o_orderkey AS experiment_id, CAST(i AS BIGINT) AS run FROM orders, range(1, 8) r(i)
  EXCEPT
  SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')"""


ORACLES: dict[str, str] = {
    "kmeans_lloyd": _TRAINED,
    "kmeans_lloyd_sizes": f"{_WITH_TRAINING} SELECT cid, max(n) AS n FROM l{ROUNDS} GROUP BY cid",
    "kmeans_mllib": _TRAINED,
    "kmeans_cost": f"WITH {POINTS}, {INIT}, a AS ({_nearest('c0')}) SELECT round(sum(d), 6) AS cost FROM a",
    "nearest_center": f"WITH {POINTS}, {INIT}, a AS ({_nearest('c0')}) SELECT vec_id, cid, round(d, 6) AS d FROM a",
    "vector_sum_by_cluster": _BY_LABEL.format(value="sum(v)"),
    "vector_mean_by_cluster": _BY_LABEL.format(value="avg(v)"),
    "sqdist_dense": _pair_distance("a", "b"),
    "sqdist_sparse_sparse": _pair_distance(_sparse("a"), _sparse("b")),
    "sqdist_sparse_dense": _pair_distance(_sparse("a"), "b"),
    "vector_add_scale": f"""WITH {_PAIRS} SELECT vec_id, CAST(dim AS INTEGER) AS dim,
  round((v + w) * 0.5, 6) + 0.0 AS x
FROM (SELECT vec_id, unnest(a) AS v, unnest(b) AS w, generate_subscripts(a, 1) AS dim FROM pairs)""",
    "scan_dense_csv": f"""WITH {POINTS} SELECT CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS x
FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM pts)""",
    "dense_to_csv": f"""WITH {POINTS} SELECT vec_id, fields, false AS trailing_comma,
  CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS x
FROM (SELECT vec_id, CAST(len(x) AS INTEGER) AS fields, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM pts)""",
    "scan_indexed_centers": f"""WITH {POINTS}, {INIT}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS x
FROM (SELECT cid, unnest(c) AS v, generate_subscripts(c, 1) AS dim FROM c0)""",
    "indexed_centers_sink": f"""WITH {POINTS}, {INIT}
SELECT cid, fields, true AS opened, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS x
FROM (SELECT cid, CAST(len(c) + 1 AS INTEGER) AS fields, unnest(c) AS v, generate_subscripts(c, 1) AS dim FROM c0)""",
    "scan_clicklog_tsv": f"WITH {CLICKLOG} SELECT label, "
    + ", ".join(f"coalesce({c}, {MISSING_INT}) AS {c}" for c in INT_COLS)
    + ", "
    + ", ".join(f"coalesce({c}, '?') AS {c}" for c in CAT_COLS)
    + " FROM clicklog",
    "impute_zero": f"WITH {CLICKLOG}, {FILLED} SELECT event_id, {', '.join(INT_COLS)} FROM filled",
    "tag_categories": f"WITH {CLICKLOG} SELECT event_id, "
    + ", ".join(f"{_token(i)} AS t{i}" for i in range(len(CAT_COLS)))
    + " FROM clicklog",
    "tag_categories_drop": f"WITH {CLICKLOG}, {TOKENS_DROP} SELECT event_id, token FROM tokens",
    "binarize_label": f"WITH {CLICKLOG} SELECT event_id, {_LABEL} AS label FROM clicklog",
    "column_mean": f"WITH {CLICKLOG}, {FILLED} SELECT "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in INT_COLS)
    + " FROM filled",
    "column_stddev_pop": f"WITH {CLICKLOG}, {FILLED} SELECT "
    + ", ".join(f"round(stddev_pop({c}), 6) AS std_{c}" for c in INT_COLS)
    + " FROM filled",
    "column_stats_declared": f"WITH {CLICKLOG}, {FILLED} SELECT {_declared()} FROM filled",
    "zscore": f"WITH {CLICKLOG}, {FILLED}, {STATS}, {ZSCORES} SELECT event_id, "
    + ", ".join(f"round(z{j}, 6) + 0.0 AS z{j}" for j in _INTS)
    + " FROM zscores",
    "prepared_count": f"""SELECT CAST(sum({_copies('event_id')}) AS BIGINT) AS n_rows, true AS in_parts
FROM events""",
    "signed_hash_murmur3": f"""WITH {CLICKLOG}, {TOKENS}, {HASHES}
SELECT event_id, token, CAST(hash AS INTEGER) AS hash,
       CAST(abs(hash) % {WIDE_BUCKETS} AS INTEGER) AS idx,
       CASE WHEN hash >= 0 THEN 1 ELSE -1 END AS sign
FROM tokens JOIN hashes USING (token)""",
    "hash_collisions": f"WITH {CLICKLOG}, {TOKENS}, {HASHES}, {ENTRIES} SELECT * FROM entries",
    "hash_collisions_drop": f"WITH {CLICKLOG}, {TOKENS_DROP}, {HASHES}, {ENTRIES} SELECT * FROM entries",
    "assemble_sparse": f"{_PREP}, {VECTORS} SELECT event_id, idx, round(val, 6) + 0.0 AS val FROM vectors",
    "libsvm_lines": f"""{_PREP}, counts AS (
  SELECT event_id, string_agg((idx + {_SHIFT}) || ':' || val, ' ' ORDER BY idx) AS hashed
  FROM entries GROUP BY event_id)
SELECT concat_ws(' ', CAST({_LABEL} AS VARCHAR), """
    + ", ".join(f"'{j}:' || printf('%.6f', z{j})" for j in _INTS)
    + ", hashed) AS value FROM zscores LEFT JOIN counts USING (event_id)",
    "libsvm_roundtrip": f"{_PREP}, {VECTORS} SELECT {_LABEL} AS label, idx, round(val, 6) + 0.0 AS val FROM vectors",
    "sample_k": f"""SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT {SAMPLE_SIZE}""",
    "sample_poisson": f"""SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, unnest(range({_copies('o_orderkey')})) AS copy FROM orders)""",
    "counter_uniform": f"""SELECT o_orderkey, round(u, 12) AS u,
  CAST(least(floor(u * 100), 99) AS BIGINT) AS u100
FROM ({_with_uniform('SELECT o_orderkey FROM orders', 'o_orderkey')})""",
    "size_model": """SELECT p_partkey,
  CAST(ceil(ceil(p_retailprice * 1073741824.0::DOUBLE) / (p_size * 8)) AS BIGINT) AS n_rows FROM part""",
    "gen_centers": f"""SELECT p_partkey, dim, round(u * {_M.center_range} - {_M.center_range / 2}, 6) + 0.0 AS x
FROM ({_PART_CENTERS})""",
    "gen_sigma": f"SELECT p_partkey, round(u * {_M.sigma_limit}, 6) + 0.0 AS sigma FROM ({_PART_SIGMAS})",
    "gen_points": f"""WITH {_GENERATED}
SELECT o_orderkey, true_cid, CAST(pairs.dim AS INTEGER) AS dim,
  round(mc.u * {_M.center_range}::DOUBLE - {_M.center_range / 2}::DOUBLE + CASE WHEN is_noise
    THEN u1 * {_M.sigma_limit}::DOUBLE
    ELSE ms.u * {_M.sigma_limit}::DOUBLE * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) END, 6) + 0.0 AS x
FROM heads JOIN pairs USING (o_orderkey)
JOIN mc ON mc.cid = true_cid AND mc.dim = pairs.dim JOIN ms ON ms.cid = true_cid""",
    "gen_points_count": f"""WITH {_GENERATED}
SELECT true_cid, is_noise, count(*) AS n_rows FROM heads GROUP BY true_cid, is_noise""",
    "runtime_summary": f"""WITH {RUNLOG}
SELECT suite, name, min(time) AS min_time, max(time) AS max_time,
  CAST(sum(time) - min(time) - max(time) AS BIGINT) AS sum_minus_extremes, median(time) AS median
FROM joined GROUP BY suite, name ORDER BY suite, name""",
    "runtime_stats": f"""WITH {RUNLOG}
SELECT name, suite, CAST(round(avg(time) / 1000.0, 2) AS DECIMAL(18, 2)) AS average,
  median(time) / 1000.0 AS median, max(time)::DOUBLE / 1000.0 AS max,
  min(time)::DOUBLE / 1000.0 AS min, count(*) AS number_of_runs
FROM joined GROUP BY suite, name ORDER BY name, suite""",
    "runtime_listing": f"WITH {RUNLOG} SELECT name, suite, time AS runtime, run FROM joined",
    "pending_runs": f"WITH {_PENDING} SELECT experiment_id, run FROM pending",
    "pending_experiments": f"WITH {_PENDING} SELECT DISTINCT experiment_id FROM pending",
}
# Sparse points and centers, their first dimension moved far out.
_FAR = f"""{POINTS}, {INIT}, a AS (
  SELECT vec_id, arg_min(cid, (d, cid)) AS cid, min(d) AS d
  FROM (SELECT vec_id, cid, {_distance('x', 'c')} AS d
        FROM (SELECT vec_id, {_sparse(f'list_prepend(x[1] + {FAR}::DOUBLE, x[2:])')} AS x FROM pts),
             (SELECT cid, list_prepend(c[1] + {FAR}::DOUBLE, c[2:]) AS c FROM c0))
  GROUP BY vec_id)"""
_NULL_KEYED = """keyed AS (
  SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS key, o_totalprice FROM orders)"""
_TEXT_KEY = "coalesce(CAST(key AS VARCHAR), chr(0) || 'null')"


def _generated_points(generated: str, k: int = K) -> str:
    return f"""{generated}, drawn AS (
  SELECT o_orderkey AS vec_id, pairs.dim AS dim,
    mc.u * {_M.center_range}::DOUBLE - {_M.center_range / 2}::DOUBLE + CASE WHEN is_noise
      THEN u1 * {_M.sigma_limit}::DOUBLE
      ELSE ms.u * {_M.sigma_limit}::DOUBLE * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) END AS v
  FROM heads JOIN pairs USING (o_orderkey)
  JOIN mc ON mc.cid = true_cid AND mc.dim = pairs.dim JOIN ms ON ms.cid = true_cid),
pts AS MATERIALIZED (SELECT vec_id, list(v ORDER BY dim) AS x FROM drawn GROUP BY vec_id),
{_initial(k)}"""


_GENERATED_POINTS = _generated_points(_GENERATED)

# Points and training with all small values at zero; prepared click-log rows as points.
_SPARSE_TRAINED = f"""WITH pts AS (SELECT vec_id, {_sparse('embedding::DOUBLE[]')} AS x FROM embeddings),
{INIT},
{_rounds(ROUNDS)}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(m, 6) + 0.0 AS x FROM l{ROUNDS}"""
_LIBSVM_TRAINED = f"""{_PREP}, {VECTORS}, dims AS (
  SELECT event_id AS vec_id, d AS dim, coalesce(val, 0.0) AS v
  FROM (SELECT event_id, d FROM events, range(1, {len(INT_COLS) + BUCKETS + 1}) r(d))
  LEFT JOIN (SELECT event_id, idx AS d, val FROM vectors) USING (event_id, d)),
pts AS MATERIALIZED (SELECT vec_id, list(v ORDER BY dim) AS x FROM dims GROUP BY vec_id),
{INIT},
{_rounds(ROUNDS)}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(m, 6) + 0.0 AS x FROM l{ROUNDS} WHERE m <> 0"""

# Sampled click log: a row per copy, known by event and copy; statistics divide by the declared size.
_SAMPLED_ROWS = DECLARED_ROWS * FRACTION
_SAMPLED = f"""all_rows AS (SELECT {', '.join(CLICKLOG_COLUMNS)} FROM events),
clicklog AS (SELECT * REPLACE (event_id * 1000 + copy AS event_id) FROM (
  SELECT *, unnest(range({_copies('event_id')})) AS copy FROM all_rows))"""


def _declared_stats() -> str:
    parts = []
    for j, c in enumerate(INT_COLS, 1):
        mean = f"(sum({c})::DOUBLE / {_SAMPLED_ROWS})"
        square = f"(sum({c} * {c})::DOUBLE - 2 * {mean} * sum({c}) + count(*) * {mean} * {mean})"
        parts.append(f"{mean} AS m{j}, sqrt({square} / {_SAMPLED_ROWS}) AS s{j}")
    return f"stats AS (SELECT {', '.join(parts)} FROM filled)"


ORACLES |= {
    "nearest_center_sparse": f"WITH {_FAR} SELECT vec_id, cid, round(d, 6) AS d FROM a",
    "nearest_center_sparse_native": f"WITH {_FAR} SELECT vec_id, cid, round(d, 6) AS d FROM a",
    "kmeans_cost_sparse": f"WITH {_FAR} SELECT round(sum(d), 6) AS cost FROM a",
    "vector_sum_null_key": f"""WITH {POINTS}, parts AS (
  SELECT CASE WHEN vec_id % 7 <> 0 THEN label END AS cid, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM pts)
SELECT cid, CAST(dim AS INTEGER) AS dim, round(sum(v), 6) + 0.0 AS x, count(*) AS n FROM parts GROUP BY cid, dim""",
    "sample_k_null_key": f"""WITH {_NULL_KEYED} SELECT key FROM keyed
ORDER BY md5('{SEED}:' || {_TEXT_KEY}), key LIMIT {SAMPLE_SIZE}""",
    "sample_poisson_null_key": f"""WITH {_NULL_KEYED} SELECT key, o_totalprice FROM (
  SELECT key, o_totalprice, unnest(range({_copies(_TEXT_KEY)})) AS copy FROM keyed)""",
    "sample_poisson_native": "SELECT true AS all_known, true AS size_as_expected",
    "final_centers_sink": _TRAINED,
    "gen_initial_centers": f"""WITH {_GENERATED_POINTS}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS x
FROM (SELECT cid, unnest(c) AS v, generate_subscripts(c, 1) AS dim FROM c0)""",
    "train_generated": f"""WITH {_GENERATED_POINTS}, {_rounds(ROUNDS)}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(m, 6) + 0.0 AS x FROM l{ROUNDS}""",
}
ORACLES["nearest_center_native"] = ORACLES["nearest_center"]
ORACLES["vector_mean_by_cluster_native"] = ORACLES["vector_mean_by_cluster"]
_LINES = f"""counts AS (
  SELECT event_id, string_agg((idx + {_SHIFT}) || ':' || val, ' ' ORDER BY idx) AS hashed
  FROM entries GROUP BY event_id)
SELECT concat_ws(' ', CAST({_LABEL} AS VARCHAR), """ + (
    ", ".join(f"'{j}:' || printf('%.6f', z{j})" for j in _INTS)
    + ", hashed) AS value FROM zscores LEFT JOIN counts USING (event_id)"
)
ORACLES |= {
    "kmeans_lloyd_sparse": _SPARSE_TRAINED,
    "kmeans_lloyd_sparse_blocks": _SPARSE_TRAINED,
    "kmeans_lloyd_libsvm": _LIBSVM_TRAINED,
    "kmeans_lloyd_blocks": _TRAINED,
    "kmeans_fit_library": _TRAINED,
    "nearest_center_blocks": ORACLES["nearest_center"],
    "nearest_center_native_blocks": ORACLES["nearest_center"],
    "sqdist_sparse_long": ORACLES["sqdist_sparse_sparse"],
    "sqdist_dense_wide": _pair_distance(
        *(f"flatten([[e * i for e in {v}] for i in range(1, {WIDE_PARTS + 1})])" for v in "ab")
    ),
    "dimension_check": "SELECT vec_id, label % 3 = 0 AS dense, label % 3 = 0 AS sparse FROM embeddings",
    "materialize_once": "SELECT o_orderkey, o_totalprice FROM orders",
    "libsvm_lines_declared_sampled": (
        f"WITH {_SAMPLED}, {FILLED}, {TOKENS}, {HASHES}, {ENTRIES}, {_declared_stats()}, {ZSCORES}, {_LINES}"
    ),
    "gen_mixture": f"""WITH {_NUMBERED}
SELECT o_orderkey AS point_id, true_cid, CAST(pairs.dim AS INTEGER) AS dim,
  round(mc.u * {_M.center_range}::DOUBLE - {_M.center_range / 2}::DOUBLE + CASE WHEN is_noise
    THEN u1 * {_M.sigma_limit}::DOUBLE
    ELSE ms.u * {_M.sigma_limit}::DOUBLE * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) END, 6) + 0.0 AS x
FROM heads JOIN pairs USING (o_orderkey)
JOIN mc ON mc.cid = true_cid AND mc.dim = pairs.dim JOIN ms ON ms.cid = true_cid""",
    "train_mixture": f"""WITH {_generated_points(_NUMBERED, _M.k)}, {_rounds(ROUNDS)}
SELECT cid, CAST(dim AS INTEGER) AS dim, round(m, 6) + 0.0 AS x FROM l{ROUNDS}""",
}
