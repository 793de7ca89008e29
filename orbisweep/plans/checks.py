"""The same questions in plain SQL for an independent engine.

Screening is checked by comparing all pairs, grids by counting pairs of objects, running sums
and budgets by recursion: none of these shares its method with the Spark side.
"""

from __future__ import annotations

from .. import constants as C

TARGET = "TIMESTAMP '1999-06-15 12:00:00'"
GRID = "165.032e0"
STATE = ["x", "y", "z", "vx", "vy", "vz"]


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"({float(x)!r}::DOUBLE)"


def rnd(expr: str, n: int, name: str) -> str:
    return f"round({expr}, {n}) + 0e0 AS {name}"


# --- the derived tables -----------------------------------------------------------------

_KIND = (
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PAYLOAD' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'DEBRIS' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ROCKET BODY' ELSE 'UNKNOWN' END"
)
_MASSES = ", ".join(
    f"('{r}', '{t}', {kg}e0)" for r, row in C.MASS_TABLE_KG.items() for t, kg in zip(C.OBJECT_TYPES, row)
)
_AREA = "CASE rcs WHEN 'SMALL' THEN 0.05e0 WHEN 'MEDIUM' THEN 0.5e0 WHEN 'LARGE' THEN 5e0 ELSE 0.5e0 END"


def _angle(factor: int, modulus: int, full: float) -> str:
    return f"radians({full}e0 * (((o_orderkey * {factor}) % {modulus}) / {modulus}e0))"


OBJECTS = f"""
masses(mrcs, mtype, kg) AS (VALUES {_MASSES}),
angles AS (
  SELECT o_orderkey AS idx, o_custkey,
    6678.137e0 + ((o_orderkey * 7919) % 10007) / 10007e0 * 1500e0 AS a,
    {_angle(104729, 9973, 180)} AS i, {_angle(1299709, 9949, 360)} AS o, {_angle(15485863, 9941, 360)} AS u,
    {_KIND} AS type,
    CASE o_orderkey % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LARGE' ELSE '' END AS rcs
  FROM orders),
objects AS MATERIALIZED (
  SELECT idx, idx AS id, 'OBJ ' || idx AS name, 'C' || (o_custkey % 25) AS country, rcs, type,
    a * (cos(o) * cos(u) - sin(o) * sin(u) * cos(i)) AS x,
    a * (sin(o) * cos(u) + cos(o) * sin(u) * cos(i)) AS y,
    a * (sin(u) * sin(i)) AS z,
    sqrt({C.MU_EARTH}e0 / a) * (-(cos(o) * sin(u)) - sin(o) * cos(u) * cos(i)) AS vx,
    sqrt({C.MU_EARTH}e0 / a) * (cos(o) * cos(u) * cos(i) - sin(o) * sin(u)) AS vy,
    sqrt({C.MU_EARTH}e0 / a) * (cos(u) * sin(i)) AS vz,
    CASE rcs WHEN 'SMALL' THEN 0.2e0 WHEN 'LARGE' THEN 4e0 ELSE 0.8e0 END AS size_m,
    kg AS mass_kg, {_AREA} / kg AS area_to_mass
  FROM angles JOIN masses ON mtype = type AND mrcs = CASE rcs WHEN '' THEN 'NONE' ELSE rcs END)"""

POPULATION = """,
population AS (
  SELECT *, CASE WHEN idx % 11 = 0 THEN idx % 40 ELSE -1 END AS event, idx % 13 <> 0 AS alive,
    CASE WHEN idx % 11 = 0 THEN 'FRAGMENTS' ELSE type END AS category FROM objects)"""

_SCALED = ", ".join(f"{c} * (0.9e0 + (idx % 200) / 1000e0) AS {c}" for c in "xyz")
SINKING = f""",
sinking AS (SELECT * REPLACE ({_SCALED}) FROM objects)"""

ALT = f"sqrt(x*x + y*y + z*z) - {C.R_EARTH}e0"
INC = (
    "degrees(acos(greatest(-1e0, least(1e0, (x*vy - y*vx) / "
    "sqrt((y*vz - z*vy)**2 + (z*vx - x*vz)**2 + (x*vy - y*vx)**2)))))"
)
SHOWN = f""",
shown AS (
  SELECT * FROM (SELECT *, {ALT} AS alt_km, {INC} AS inc_deg FROM population WHERE alive)
  WHERE alt_km BETWEEN 0 AND 1000000 AND inc_deg BETWEEN 0 AND 180)"""

HISTORY = """
history AS (
  SELECT *, CASE WHEN n % 71 = 0 THEN NULL ELSE l_partkey::VARCHAR END AS norad_id,
    CASE WHEN n % 67 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.250000' END AS EPOCH,
    CASE WHEN n % 67 = 0 THEN NULL ELSE date_trunc('second', l_shipdate) END AS epoch_ts,
    CASE WHEN n % 61 = 0 THEN NULL ELSE '1 ' || l_orderkey END AS line1
  FROM (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem))"""
LATEST = HISTORY + f""",
latest AS (
  SELECT * FROM history WHERE norad_id IS NOT NULL AND epoch_ts <= {TARGET}
  QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY epoch_ts DESC, l_orderkey, l_linenumber) = 1)"""
_TYPES = "[" + ", ".join(f"'{t}'" for t in C.OBJECT_TYPES) + "]"
SATCAT = f"""
pages_ AS (
  SELECT p_partkey::VARCHAR AS NORAD_CAT_ID,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {_TYPES}[p_partkey % 4 + 1] END AS OBJECT_TYPE,
    CASE p_partkey % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LARGE' ELSE '' END AS RCS_SIZE,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE format('{{:.1f}}', p_retailprice) END AS RCSVALUE,
    p_brand AS OBJECT_ID, CASE WHEN c = 1 THEN 'LATE ' || p_type ELSE p_type END AS COUNTRY,
    p_partkey // 500 + c AS page, p_partkey AS pos
  FROM part, (VALUES (0), (1)) copies(c) WHERE c = 0 OR p_partkey % 7 = 0),
satcat AS (
  SELECT NORAD_CAT_ID, OBJECT_TYPE, RCS_SIZE, RCSVALUE, OBJECT_ID, COUNTRY FROM pages_
  QUALIFY row_number() OVER (PARTITION BY NORAD_CAT_ID ORDER BY page, pos) = 1)"""
_META = """
meta AS (
  SELECT l.*, coalesce(OBJECT_TYPE, '') AS object_type_, coalesce(OBJECT_ID, '') AS designator,
    coalesce(COUNTRY, '') AS country_, coalesce(RCS_SIZE, '') AS rcs_size_, coalesce(RCSVALUE, '') AS rcs_value_
  FROM latest l LEFT JOIN (SELECT * REPLACE (CASE WHEN NORAD_CAT_ID LIKE '%3' THEN 'X' || NORAD_CAT_ID ELSE NORAD_CAT_ID END AS NORAD_CAT_ID) FROM satcat) s ON norad_id = NORAD_CAT_ID)"""


# --- orbital mechanics ------------------------------------------------------------------


def _sum(terms, fn: str) -> str:
    parts = []
    for coefficient, *ks in terms:
        arg = " + ".join(f"{k}e0 * {n}" for k, n in zip(ks, ("md", "mm", "mmp", "mf")) if k)
        parts.append(f"{coefficient}e0 * {fn}({arg})")
    return " + ".join(parts)


def moon(src: str, name: str, jd: str, out=("mx", "my", "mz")) -> str:
    """CTEs that add the Moon position at `jd` to the rows of `src`."""
    wrap = lambda n: "((({c} + {r} * mt) % 360e0) + 360e0) % 360e0".format(
        c=d(C.MOON_ANGLES[n][0]), r=d(C.MOON_ANGLES[n][1])
    )
    angles = ", ".join(f"radians({wrap(n)}) AS m{n}" for n in ("d", "m", "mp", "f"))
    drop = "mt, mlp, md, mm, mmp, mf, mlon, mlat, mdist, meps, mxe, mye, mze"
    return f""",
{name}0 AS (SELECT *, (({jd}) - 2451545e0) / 36525e0 AS mt FROM {src}),
{name}1 AS (SELECT *, {wrap("lp")} AS mlp, {angles} FROM {name}0),
{name}2 AS (SELECT *, radians(mlp + {_sum(C.MOON_LONGITUDE_SIN, "sin")}) AS mlon,
  radians({_sum(C.MOON_LATITUDE_SIN, "sin")}) AS mlat,
  {C.MOON_DISTANCE_KM}e0 + {_sum(C.MOON_DISTANCE_COS, "cos")} AS mdist,
  radians({C.OBLIQUITY_DEG[0]}e0 + {C.OBLIQUITY_DEG[1]}e0 * mt) AS meps FROM {name}1),
{name}3 AS (SELECT *, mdist * cos(mlat) * cos(mlon) AS mxe, mdist * cos(mlat) * sin(mlon) AS mye,
  mdist * sin(mlat) AS mze FROM {name}2),
{name} AS (SELECT * EXCLUDE ({drop}), mxe AS {out[0]}, mye * cos(meps) - mze * sin(meps) AS {out[1]},
  mye * sin(meps) + mze * cos(meps) AS {out[2]} FROM {name}3)"""


def accel(r: tuple, m: tuple) -> list[str]:
    """Three acceleration components as closed expressions of position and Moon names."""
    x, y, z = r
    r2 = f"({x}*{x} + {y}*{y} + {z}*{z})"
    r5 = f"({r2} * {r2} * sqrt({r2}))"
    gap = [f"({p} - {q})" for p, q in zip(m, r)]
    d2 = "(" + " + ".join(f"{g}*{g}" for g in gap) + ")"
    m2 = "(" + " + ".join(f"{q}*{q}" for q in m) + ")"
    k = d(1.5 * C.J2 * C.MU_EARTH * C.R_EARTH**2)
    out = []
    for n, c in enumerate(r):
        polar = ("1e0", "1e0", "3e0")[n]
        out.append(
            f"-{C.MU_EARTH}e0 * {c} / ({r2} * sqrt({r2})) + {k} / {r5} * {c} * (5e0*{z}*{z}/{r2} - {polar}) "
            f"+ {C.MU_MOON}e0 * ({gap[n]} / ({d2} * sqrt({d2})) - {m[n]} / ({m2} * sqrt({m2})))"
        )
    return out


def rk4(src: str, name: str, h: str, out: list[str], state=STATE) -> str:
    """CTEs that add the state one step of `h` later; Moon names are m0*, m1*, m2*."""
    r, v = state[:3], state[3:]
    moons = [[f"m{n}{a}" for a in "xyz"] for n in range(3)]
    text, last = "", src
    ks = []
    for stage, (m, part) in enumerate([(0, None), (1, "0.5e0"), (1, "0.5e0"), (2, "1e0")]):
        if part is None:
            pos, vel = list(r), list(v)
        else:
            pos, vel = [f"q{stage}{a}" for a in "xyz"], [f"w{stage}{a}" for a in "xyz"]
            pv, pa = ks[-1]
            cols = [f"{b} + {part}*({h})*{k} AS {n}" for b, k, n in zip(list(r) + list(v), pv + pa, pos + vel)]
            text += f",\n{name}p{stage} AS (SELECT *, {', '.join(cols)} FROM {last})"
            last = f"{name}p{stage}"
        acc = [f"g{stage}{a}" for a in "xyz"]
        cols = [f"{e} AS {n}" for e, n in zip(accel(tuple(pos), tuple(moons[m])), acc)]
        text += f",\n{name}a{stage} AS (SELECT *, {', '.join(cols)} FROM {last})"
        last = f"{name}a{stage}"
        ks.append((vel, acc))
    temps = [t for s in range(4) for t in [f"g{s}{a}" for a in "xyz"]] + [
        t for s in range(1, 4) for t in [f"q{s}{a}" for a in "xyz"] + [f"w{s}{a}" for a in "xyz"]
    ]
    final = []
    for n, (b, o) in enumerate(zip(list(r) + list(v), out)):
        k = [(vel + acc)[n] for vel, acc in ks]
        final.append(f"{b} + ({h})/6e0 * ({k[0]} + 2e0*{k[1]} + 2e0*{k[2]} + {k[3]}) AS {o}")
    return text + f",\n{name} AS (SELECT * EXCLUDE ({', '.join(temps)}), {', '.join(final)} FROM {last})"


def step_moons(src: str, name: str, t: str, h: str) -> str:
    text, last = "", src
    for n, part in enumerate(("0e0", "0.5e0", "1e0")):
        jd = f"{d(C.DEFAULT_EPOCH_JD)} + ({t} + {part} * ({h})) / 86400e0"
        text += moon(last, f"{name}{n}", jd, tuple(f"m{n}{a}" for a in "xyz"))
        last = f"{name}{n}"
    return text, last


def one_step(src: str, name: str, t: str, h: str, out: list[str]) -> str:
    text, last = step_moons(src, name + "m", t, h)
    text += rk4(last, name + "r", h, out)
    drop = ", ".join(f"m{n}{a}" for n in range(3) for a in "xyz")
    return text + f",\n{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}) FROM {name}r)"


NEXT = [f"n{c}" for c in STATE]


def run(src: str, steps: int, h: str, keep_path: bool = False) -> str:
    """CTEs s0..sn of a run; objects below ground stay where they are and are dead."""
    text = f",\ns0 AS (SELECT *, TRUE AS live FROM {src})"
    for n in range(steps):
        text += one_step(f"s{n}", f"go{n}", f"{n} * {h}", h, NEXT)
        moved = ", ".join(f"CASE WHEN live THEN n{c} ELSE {c} END AS {c}" for c in STATE)
        text += (
            f",\ns{n + 1} AS (SELECT * REPLACE (live AND sqrt(x*x + y*y + z*z) >= {C.R_EARTH}e0 AS live) FROM "
            f"(SELECT * EXCLUDE ({', '.join(NEXT)}) REPLACE ({moved}) FROM go{n}))"
        )
    return text


def rounded_state(prefix: str = "") -> str:
    return ", ".join(rnd(prefix + c, 3 if len(c) == 1 else 6, c) for c in STATE)


# --- screening --------------------------------------------------------------------------

DT, THRESHOLD, SCALE = 60.0, 25.0, 2500.0


def _pairs() -> str:
    """All pairs of both steps that pass the linear filter, by comparing everything."""
    h = f"{DT}e0"
    text = "WITH RECURSIVE" + OBJECTS
    for n in range(2):
        src = "objects" if n == 0 else "b1"
        text += one_step(src, f"e{n}", f"{n} * {h}", h, NEXT)
        moved = ", ".join(f"n{c} AS {c}" for c in STATE)
        text += f",\nb{n + 1} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(NEXT)}) REPLACE ({moved}) FROM e{n})"
    both = " UNION ALL ".join(
        f"SELECT {n} AS step, idx, size_m, {', '.join(STATE + NEXT)} FROM e{n} "
        f"WHERE sqrt(nx*nx + ny*ny + nz*nz) >= {C.R_EARTH}e0" for n in range(2)
    )
    text += f",\nstates AS MATERIALIZED ({both})"
    dr, dv = [f"(b.{c} - a.{c})" for c in "xyz"], [f"(b.v{c} - a.v{c})" for c in "xyz"]
    dot = lambda p, q: "(" + " + ".join(f"{s}*{t}" for s, t in zip(p, q)) + ")"
    text += f""",
dots AS (
  SELECT a.step, a.idx AS i, b.idx AS j, {dot(dv, dv)} AS dv2, {dot(dr, dv)} AS rv, {dot(dr, dr)} AS r2
  FROM states a JOIN states b ON a.step = b.step AND a.idx < b.idx),
near AS (
  SELECT *, CASE WHEN rv >= 0 THEN r2 WHEN -rv >= dv2 * {h} THEN r2 + 2e0 * rv * {h} + dv2 * {h} * {h}
    ELSE r2 - rv * rv / dv2 END AS gap2,
    {THRESHOLD}e0 + 0.001e0 + 0.000002e0 * sqrt(dv2) * {DT**3}e0 AS gate FROM dots),
passed AS MATERIALIZED (
  SELECT step, i, j, CASE WHEN dv2 < 0.0001e0 THEN 'CO_ORBITING' ELSE 'REFINE' END AS outcome
  FROM near WHERE gap2 <= gate * gate AND (dv2 < 0.0001e0 OR NOT (rv >= 0 AND dv2 > 0.000002e0 * r2)))"""
    return text


def _refined() -> str:
    """Golden section by recursion, one iteration per level."""
    h = f"{DT}e0"
    rel = ", ".join(
        [f"b.{c} - a.{c} AS p0{c}" for c in "xyz"]
        + [f"(b.v{c} - a.v{c}) * {h} AS m0{c}" for c in "xyz"]
        + [f"b.n{c} - a.n{c} AS p1{c}" for c in "xyz"]
        + [f"(b.nv{c} - a.nv{c}) * {h} AS m1{c}" for c in "xyz"]
    )

    def hermite(s, c):
        return (
            f"(p0{c} * (2e0*{s}*{s}*{s} - 3e0*{s}*{s} + 1e0) + m0{c} * ({s}*{s}*{s} - 2e0*{s}*{s} + {s}) "
            f"+ p1{c} * (3e0*{s}*{s} - 2e0*{s}*{s}*{s}) + m1{c} * ({s}*{s}*{s} - {s}*{s}))"
        )

    def rate(s, c):
        return (
            f"(p0{c} * (6e0*{s}*{s} - 6e0*{s}) + m0{c} * (3e0*{s}*{s} - 4e0*{s} + 1e0) "
            f"+ p1{c} * (6e0*{s} - 6e0*{s}*{s}) + m1{c} * (3e0*{s}*{s} - 2e0*{s}))"
        )

    f = lambda s: " + ".join(f"{hermite(s, c)} * {hermite(s, c)}" for c in "xyz")
    keep = ", ".join(f"{p}{c}" for p in ("p0", "m0", "p1", "m1") for c in "xyz")
    g = f"{C.GOLDEN}e0"
    return f""",
curves AS MATERIALIZED (
  SELECT p.step, p.i, p.j, {rel}, a.size_m AS size_i, b.size_m AS size_j
  FROM passed p JOIN states a ON a.step = p.step AND a.idx = p.i JOIN states b ON b.step = p.step AND b.idx = p.j
  WHERE outcome = 'REFINE'),
search AS (
  SELECT step, i, j, size_i, size_j, {keep}, 0 AS n, 0e0 AS lo, 1e0 AS hi FROM curves
  UNION ALL
  SELECT step, i, j, size_i, size_j, {keep}, n + 1, CASE WHEN fl < fr THEN lo ELSE l END, CASE WHEN fl < fr THEN r ELSE hi END
  FROM (SELECT *, {f("l")} AS fl, {f("r")} AS fr FROM (
    SELECT *, hi - {g} * (hi - lo) AS l, lo + {g} * (hi - lo) AS r FROM search WHERE n < 60))),
minima AS (SELECT *, 0.5e0 * (lo + hi) AS s FROM search WHERE n = 60),
approaches AS MATERIALIZED (
  SELECT step, i, j, step * {h} + s * {h} AS t, sqrt({f("s")}) AS miss_km,
    sqrt({" + ".join(f"{rate('s', c)} * {rate('s', c)}" for c in "xyz")}) / {h} AS v_rel_km_s, size_i, size_j
  FROM minima WHERE s > 1e-9 AND s < 1e0 - 1e-9),
found AS (
  SELECT *, miss_km < 0.0005e0 * {SCALE}e0 * (size_i + size_j) AS collision FROM approaches WHERE miss_km <= {THRESHOLD}e0)"""


# --- breakups ---------------------------------------------------------------------------


def _u(stream: int, which: int, event: str = "event", item: str = "k") -> str:
    text = f"md5(concat_ws(':', '1', {event}, {item}, '{stream}'))"
    return f"('0x' || substr({text}, {1 + 13 * which}, 13))::BIGINT / 4503599627370496e0"


def _normal(u1: str, u2: str) -> str:
    return f"sqrt(-2e0 * ln(1e0 - {u1})) * cos({d(2 * C.PI)} * {u2})"


def _ramp(x: str, shape) -> str:
    x0, y0, x1, y1 = (d(v) for v in shape)
    return f"({y0} + ({y1} - {y0}) * least(1e0, greatest(0e0, ({x} - {x0}) / ({x1} - {x0}))))"


def _events() -> str:
    heavy = lambda c: ", ".join(
        f"CASE WHEN a.mass_kg >= b.mass_kg THEN {p}.{c} ELSE {q}.{c} END AS {n}_{c}" for n, p, q in (("t", "a", "b"), ("p", "b", "a"))
    )
    cols = ", ".join(heavy(c) for c in ["idx", "name", "mass_kg", "size_m", *STATE])
    return "WITH RECURSIVE" + OBJECTS + f""",
parents AS (
  SELECT s_suppkey AS event, ((s_suppkey * 7) % 60)::DOUBLE AS t, 60e0 - (s_suppkey * 7) % 60 AS remaining_s, {cols}
  FROM supplier JOIN objects a ON a.idx = s_suppkey * 5 + 1 JOIN objects b ON b.idx = s_suppkey * 7 + 3),
speeds AS (SELECT *, sqrt((t_vx - p_vx)**2 + (t_vy - p_vy)**2 + (t_vz - p_vz)**2) AS v FROM parents),
energies AS (SELECT *, 500e0 * p_mass_kg * v * v / t_mass_kg AS energy FROM speeds),
classes AS (
  SELECT *, energy >= 40 AS catastrophic,
    CASE WHEN energy >= 40 THEN t_mass_kg ELSE greatest(0e0, p_mass_kg * v * v - p_mass_kg) END AS t_budget,
    p_mass_kg AS p_budget FROM energies),
events_ AS MATERIALIZED (
  SELECT *, t_budget + p_budget AS m, 0.1e0 * pow(t_budget + p_budget, 0.75e0) * {d(0.1 ** -1.71)} AS expected FROM classes)"""


def _draws() -> str:
    (b0, b1), (a0, a1), (i0, i1, i2), (v0, v1, v2) = C.POISSON_B, C.POISSON_A, C.POISSON_ALPHA, C.POISSON_SQUEEZE
    arrivals = f"""
tries AS (
  SELECT *, {_u(0, 0, item="try")} - 0.5e0 AS u, {_u(0, 1, item="try")} AS v, {b0}e0 + {b1}e0 * sqrt(expected) AS b
  FROM (SELECT event, expected, unnest(range(0, 40)) AS try FROM events_ WHERE expected >= 10)),
hats AS (
  SELECT *, 0.5e0 - abs(u) AS edge, {a0}e0 + {a1}e0 * b AS a FROM tries),
tried AS (
  SELECT *, floor((2e0 * a / edge + b) * u + expected + 0.43e0) AS c FROM hats WHERE edge > 0 AND v > 0),
counts AS (
  SELECT event, arg_min(c, try)::BIGINT AS n FROM tried
  WHERE c >= 0 AND (edge >= 0.07 AND v <= {v0}e0 - {v1}e0 / (b - {v2}e0)
    OR NOT (edge < 0.013 AND v > edge)
      AND ln(v) + ln({i0}e0 + {i1}e0 / (b - {i2}e0)) - ln(a / (edge * edge) + b) <= c * ln(expected) - expected - lgamma(c + 1e0)) GROUP BY event
  UNION ALL
  SELECT event, count(*) FILTER (total <= u) AS n FROM (
    SELECT event, {_u(0, 0, item="0")} AS u, sum(exp(-expected) * pow(expected, j) / gamma(j + 1e0)) OVER (PARTITION BY event ORDER BY j) AS total
    FROM (SELECT event, expected, unnest(range(0, 64)) AS j FROM events_ WHERE expected > 0 AND expected < 10)) GROUP BY event)"""
    side = lambda c: f"CASE WHEN side = 0 THEN t_{c} ELSE p_{c} END"
    mean = f"CASE WHEN mode < {_ramp('lg', C.AM_ALPHA)} THEN {_ramp('lg', C.AM_MU1)} + {_ramp('lg', C.AM_SIGMA1)} * z ELSE {_ramp('lg', C.AM_MU2)} + {_ramp('lg', C.AM_SIGMA2)} * z END"
    small = f"{_ramp('lg', C.AM_SMALL_MU)} + (CASE WHEN lg <= -3.5e0 THEN 0.2e0 ELSE 0.2e0 + 0.1333e0 * (lg + 3.5e0) END) * z"
    return f""",{arrivals},
items AS (
  SELECT e.*, k, CASE WHEN {_u(1, 0, 'e.event')} < t_budget / m THEN 0 ELSE 1 END AS side
  FROM (SELECT event, unnest(range(1, n + 1)) AS k FROM counts) c JOIN events_ e ON e.event = c.event),
sized AS (
  SELECT *, 0.1e0 * pow(1e0 - {_u(1, 1)} * (1e0 - pow({side('size_m')} / 0.1e0, -1.71e0)), {d(-1 / 1.71)}) AS size_m,
    {_u(2, 0)} AS bridge, {_u(2, 1)} AS mode, {_normal(_u(3, 0), _u(3, 1))} AS z
  FROM items WHERE {side('size_m')} > 0.1e0),
logs AS (SELECT *, log10(size_m) AS lg FROM sized),
chis AS (
  SELECT *, CASE WHEN size_m >= 0.11e0 OR (size_m > 0.08e0 AND bridge < (size_m - 0.08e0) / 0.03e0)
    THEN {mean} ELSE {small} END AS chi FROM logs),
kicks AS (
  SELECT *, 0.540424e0 * size_m * size_m AS area, 0.540424e0 * size_m * size_m / pow(10e0, chi) AS mass_kg,
    least(v * 1000e0, pow(10e0, 0.9e0 * chi + 2.9e0 + 0.4e0 * {_normal(_u(4, 0), _u(4, 1))})) / 1000e0 AS dv,
    2e0 * {_u(5, 0)} - 1e0 AS cz, {d(2 * C.PI)} * {_u(5, 1)} AS phi FROM chis),
draws AS MATERIALIZED (
  SELECT event, t, remaining_s, k, side, {side('budget')} AS budget, size_m, mass_kg, pow(10e0, chi) AS area_to_mass,
    CASE WHEN area < 0.1e0 THEN 'SMALL' WHEN area < 1e0 THEN 'MEDIUM' ELSE 'LARGE' END AS rcs,
    {side('x')} AS x, {side('y')} AS y, {side('z')} AS z,
    {side('vx')} + dv * sqrt(greatest(0e0, 1e0 - cz*cz)) * cos(phi) AS vx,
    {side('vy')} + dv * sqrt(greatest(0e0, 1e0 - cz*cz)) * sin(phi) AS vy,
    {side('vz')} + dv * cz AS vz FROM kicks)"""


def _kept() -> str:
    """The greedy mass budget, one item of every (event, side) per level of recursion."""
    return """,
queue AS MATERIALIZED (
  SELECT event, side, k, mass_kg, budget, row_number() OVER (PARTITION BY event, side ORDER BY k) AS n FROM draws),
greedy AS (
  SELECT event, side, k, mass_kg, budget, n, mass_kg <= budget AS taken, CASE WHEN mass_kg <= budget THEN mass_kg ELSE 0e0 END AS used
  FROM queue WHERE n = 1
  UNION ALL
  SELECT q.event, q.side, q.k, q.mass_kg, q.budget, q.n, g.used + q.mass_kg <= q.budget,
    CASE WHEN g.used + q.mass_kg <= q.budget THEN g.used + q.mass_kg ELSE g.used END
  FROM greedy g JOIN queue q ON q.event = g.event AND q.side = g.side AND q.n = g.n + 1),
kept AS MATERIALIZED (
  SELECT d.*, 0.5e0 * (vx*vx + vy*vy + vz*vz) - %se0 / sqrt(x*x + y*y + z*z) >= 0 AS escaped
  FROM draws d JOIN greedy g ON g.event = d.event AND g.k = d.k WHERE g.taken)""" % C.MU_EARTH


_NUMBERED = """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY event ORDER BY k) - 1 AS seq, row_number() OVER (ORDER BY event, k) - 1 AS serial
  FROM kept WHERE NOT escaped)"""

_REPORT = """,
report AS (
  SELECT e.*, coalesce(n, 0) AS fragments, coalesce(kg, 0e0) AS fragments_mass_kg, coalesce(gone, 0) AS escaped
  FROM events_ e LEFT JOIN (
    SELECT event, count(*) FILTER (NOT escaped) AS n, sum(mass_kg) FILTER (NOT escaped) AS kg, count(*) FILTER (escaped) AS gone
    FROM kept GROUP BY event) f ON f.event = e.event)"""


# --- grids ------------------------------------------------------------------------------


def _cells(src: str, width: str, name: str = "celled") -> str:
    return f""",
{name} AS (
  SELECT *, (((cx + 1048576) << 42) | ((cy + 1048576) << 21) | (cz + 1048576)) AS cell_key FROM (
    SELECT *, floor(x / {width})::BIGINT AS cx, floor(y / {width})::BIGINT AS cy, floor(z / {width})::BIGINT AS cz FROM {src}))"""


def _touching(a: str = "a", b: str = "b") -> str:
    return " AND ".join(f"{b}.c{c} BETWEEN {a}.c{c} - 1 AND {a}.c{c} + 1" for c in "xyz")


EVENT_S = "epoch_us(ts) / 1000000e0 - 1704067200e0"
_HOURS = f"""
hours AS (SELECT floor(({EVENT_S}) / 3600e0)::BIGINT AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)"""
_EMA = """
ordered AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
ema AS (
  SELECT user_id, n, value AS e FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.n, CASE WHEN e > 0 THEN 0.9e0 * e + 0.1e0 * o.value ELSE o.value END
  FROM ema m JOIN ordered o ON o.user_id = m.user_id AND o.n = m.n + 1)"""
_LAST_EMA = f"""WITH RECURSIVE{_EMA}
SELECT user_id, {rnd("e", 6, "ema")} FROM ema QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""

_LINES_OK = "idx % 103 <> 0 AND idx % 107 <> 0"


def geodetic(source: str, out: str, jd: str, steps: int = 9) -> str:
    """CTEs `out`: rows of `source` with lat, lon, height; the latitude by fixed-point steps."""
    poly = lambda n: "radians((%s * t + %s * t * t + %s * t * t * t) / 3600e0)" % tuple(d(c) for c in C.PRECESSION_ARCSEC[n])
    angle = ["radians({} + {} * t)".format(*map(d, a)) for a in C.NUTATION_ANGLES_DEG]
    arg = lambda m: " + ".join(f"{c}e0 * {a}" for c, a in zip(m, angle) if c)
    psi = " + ".join(f"{d(c)} * sin({arg(m)})" for m, c, _ in C.NUTATION_ARCSEC)
    eps = " + ".join(f"{d(c)} * cos({arg(m)})" for m, _, c in C.NUTATION_ARCSEC)
    s0, s1, s2, s3 = map(d, C.SIDEREAL_SECONDS)
    e2 = d(C.WGS84_E2)
    text = f""",
{out}_t AS (SELECT ({jd} - 2451545e0) / 36525e0 AS t),
{out}_a AS (SELECT {poly("zeta")} AS pz, {poly("theta")} AS pt, {poly("z")} AS pl, radians(({psi}) / 3600e0) AS psi, radians(({eps}) / 3600e0) AS de,
  radians({d(C.OBLIQUITY_DEG[0])} + {d(C.OBLIQUITY_DEG[1])} * t) AS ob,
  {s0} + {s1} * t + {s2} * t * t + {s3} * t * t * t AS sec FROM {out}_t),
{out}_1 AS (SELECT *, x * cos(pz) - y * sin(pz) AS x1, y * cos(pz) + x * sin(pz) AS y1, radians(((sec % 86400e0) + 86400e0) % 86400e0 / 240e0) + psi * cos(ob) AS spin
  FROM {source}, {out}_a),
{out}_2 AS (SELECT *, x1 * cos(pt) - z * sin(pt) AS x2, z * cos(pt) + x1 * sin(pt) AS z2 FROM {out}_1),
{out}_3 AS (SELECT *, x2 * cos(pl) - y1 * sin(pl) AS x3, y1 * cos(pl) + x2 * sin(pl) AS y3 FROM {out}_2),
{out}_4 AS (SELECT *, x3 - (y3 * cos(ob) + z2 * sin(ob)) * psi AS x4, y3 + x3 * cos(ob) * psi - z2 * de AS y4, z2 + x3 * sin(ob) * psi + y3 * de AS z4 FROM {out}_3),
{out}_5 AS (SELECT *, x4 * cos(spin) + y4 * sin(spin) AS fx, y4 * cos(spin) - x4 * sin(spin) AS fy FROM {out}_4),
{out}_l0 AS (SELECT *, sqrt(fx * fx + fy * fy) AS w, atan2(z4, sqrt(fx * fx + fy * fy) * (1e0 - {e2})) AS lat FROM {out}_5)"""
    for k in range(steps):
        text += f""",
{out}_l{k + 1} AS (SELECT * REPLACE (atan2(z4 + {e2} * {d(C.WGS84_A_KM)} / sqrt(1e0 - {e2} * sin(lat) ** 2) * sin(lat), w) AS lat) FROM {out}_l{k})"""
    return text + f""",
{out} AS (SELECT *, degrees(lat) AS lat_deg, degrees(atan2(fy, fx)) AS lon_deg,
  w * cos(lat) + z4 * sin(lat) - {d(C.WGS84_A_KM)} * sqrt(1e0 - {e2} * sin(lat) ** 2) AS height_km FROM {out}_l{steps})"""


#: Digits of a line's first 68 columns; a minus sign counts 1.
_SUM = "(list_sum(list_transform(string_split({0}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT WHEN c = '-' THEN 1 ELSE 0 END)) % 10)"


def _element_sets() -> str:
    number = "lpad((l_partkey % 100000)::VARCHAR, 5, '0')"
    shifted = lambda factor, modulus: f"format('{{:8.4f}}', ((n * {factor}) % {modulus}) / 10000e0)"
    return f"""
el_1 AS (
  SELECT *, l_orderkey * 8 + l_linenumber AS n FROM lineitem),
el_2 AS (
  SELECT *, '1 ' || {number} || 'U 98067A   ' || strftime(l_shipdate, '%y') || format('{{:012.8f}}', dayofyear(l_shipdate) + (n % 9973) / 10000e0)
    || '  .00001000  00000-0 ' || ' ' || (10000 + (n * 13) % 80000) || '-4' || ' 0 ' || lpad((n % 1000)::VARCHAR, 4, ' ') AS a,
    '2 ' || {number} || ' ' || {shifted(104729, 1799000)} || ' ' || {shifted(1299709, 3600000)} || ' ' || lpad(((n * 31) % 150000)::VARCHAR, 7, '0') || ' '
    || {shifted(15485863, 3600000)} || ' ' || {shifted(611953, 3600000)} || ' '
    || format('{{:11.8f}}', CASE WHEN n % 47 = 0 THEN 2e0 ELSE 11e0 END + ((n * 7919) % 45000000) / 10000000e0) || lpad((n % 100000)::VARCHAR, 5, ' ') AS b
  FROM el_1),
el_3 AS (
  SELECT *, a || ({_SUM.format("a")} + (n % 53 = 0)::INT) % 10 AS c, b || {_SUM.format("b")} AS e FROM el_2),
el AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity,
    CASE WHEN n % 61 <> 0 THEN CASE WHEN n % 59 = 0 THEN substr(c, 1, 60) ELSE c END END AS one,
    CASE WHEN n % 67 = 0 THEN '3' || substr(e, 2) ELSE e END AS two FROM el_3),
el_status AS (
  SELECT *, CASE WHEN one IS NULL THEN 'missing' WHEN length(one) <> 69 OR length(two) <> 69 THEN 'length'
    WHEN one[1:2] <> '1 ' OR two[1:2] <> '2 ' OR one[3:7] <> two[3:7] THEN 'line'
    WHEN {_SUM.format("one[1:68]")}::VARCHAR <> one[69] OR {_SUM.format("two[1:68]")}::VARCHAR <> two[69] THEN 'checksum' ELSE 'ok' END AS status FROM el),
decoded AS (
  SELECT l_orderkey, l_linenumber, l_quantity, status, CASE WHEN status = 'ok' THEN one END AS o, CASE WHEN status = 'ok' THEN two END AS t FROM el_status)"""


def _snapshot() -> str:
    return """,
snap AS (
  SELECT idx, id, x, CASE WHEN idx % 13 = 0 THEN 0 WHEN idx % 17 <> 0 THEN 1 END AS flag,
    sqrt(x*x + y*y + z*z) AS r FROM objects
  UNION ALL
  SELECT c_custkey + 1000000000, c_custkey + 10000000, c_acctbal, 1,
    sqrt(c_acctbal**2 + (c_acctbal + 1)**2 + (c_acctbal + 2)**2) FROM customer)"""


def _fates() -> str:
    """Every collision in time order, one step of a recursion each; a step carries all objects."""
    return f"""WITH RECURSIVE{OBJECTS},
hits AS (
  SELECT (s_suppkey * 37 % 6001) / 100e0 AS t, s_suppkey - s_suppkey % 5 AS i, s_suppkey + 100000000 + s_suppkey % 2 AS j FROM supplier),
c AS (
  SELECT row_number() OVER (ORDER BY t, i, j) AS n, i, j, a.mass_kg AS mi, 0.01e0 * (b.idx % 7 + 1) AS mj,
    sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2 + (a.vz - b.vz) ** 2) AS v
  FROM hits JOIN objects a ON a.idx = i JOIN objects b ON b.idx = j - 100000000),
r AS (
  SELECT 0::BIGINT AS n, idx, TRUE AS alive, any_value(kg) AS kg FROM (SELECT i AS idx, mi AS kg FROM c UNION ALL SELECT j, mj FROM c) GROUP BY idx
  UNION ALL
  SELECT n + 1, idx, alive AND NOT (hit AND (idx = least_ OR idx = most AND broken)),
    CASE WHEN hit AND idx = most AND NOT broken THEN greatest(kg - greatest(0e0, kp * v * v - kp), 0e0) ELSE kg END
  FROM (
    SELECT *, CASE WHEN ki >= kj THEN i ELSE j END AS most, CASE WHEN ki >= kj THEN j ELSE i END AS least_, least(ki, kj) AS kp,
      500e0 * least(ki, kj) * v * v / greatest(ki, kj) >= {d(C.CATASTROPHIC_J_PER_G)} AS broken
    FROM (
      SELECT r.*, c.i, c.j, c.v, bool_and(alive) FILTER (idx = i OR idx = j) OVER () AS hit,
        max(kg) FILTER (idx = i) OVER () AS ki, max(kg) FILTER (idx = j) OVER () AS kj
      FROM r JOIN c ON c.n = r.n + 1)))
SELECT idx, alive::INT AS alive, {rnd("kg", 6, "mass_kg")} FROM r WHERE n = (SELECT count(*) FROM c)"""


def sql() -> dict[str, str]:
    objects = "WITH" + OBJECTS
    population = objects + POPULATION
    shown = population + SHOWN
    sinking = objects + SINKING
    pairs, found = _pairs(), _pairs() + _refined()
    events = _events()
    draws = events + _draws()
    kept = draws + _kept()
    out = {}

    # sources
    out["catalog_scan"] = f"""{objects}
SELECT idx, id, name, type, country, rcs, size_m, {", ".join(rnd(c, 3 if len(c) == 1 else 5, c) for c in STATE)}
FROM objects WHERE {_LINES_OK} AND idx % 97 <> 0 AND idx % 101 <> 0"""
    out["catalog_dropped"] = f"""{objects}
SELECT count(*) FILTER (idx % 97 <> 0 AND idx % 101 <> 0) AS loaded,
  count(*) FILTER (idx % 97 = 0 OR idx % 101 = 0) AS dropped FROM objects WHERE {_LINES_OK}"""
    out["epoch_jd"] = f"""
SELECT event_id, {rnd(f"CASE WHEN event_id % 5 = 0 THEN {d(C.DEFAULT_EPOCH_JD)} ELSE floor(epoch_us(ts) / 1000000e0) / 86400e0 + 2440587.5e0 END", 6, "epoch_jd")}
FROM events"""
    out["object_type_map"] = f"""{objects}
SELECT CASE WHEN idx % 97 = 0 THEN idx::VARCHAR WHEN idx % 101 = 0 THEN 'n/a' ELSE idx::VARCHAR END AS id,
  arg_max(CASE WHEN idx % 97 = 0 THEN 'row' WHEN type = 'UNKNOWN' THEN 'TBA' ELSE type END, idx) AS type
FROM objects WHERE {_LINES_OK} GROUP BY 1"""
    out["snapshot_replay"] = f"""{objects}{_snapshot()},
base AS (
  SELECT idx, id, name, rcs, size_m, -1 AS event, x FROM objects UNION ALL
  SELECT s_suppkey + 1000000000, s_suppkey + 10000000, s_name, 'MEDIUM', 0.3e0, 3, s_acctbal FROM supplier)
SELECT coalesce(b.idx, s.idx) AS idx, coalesce(b.id, s.id) AS id,
  CASE WHEN b.idx IS NULL THEN 'FRAG ' || (s.id - 10000000) ELSE b.name END AS name,
  CASE WHEN b.idx IS NULL THEN 'SMALL' ELSE b.rcs END AS rcs,
  CASE WHEN b.idx IS NULL THEN 'added' WHEN s.idx IS NULL THEN 'removed' ELSE 'matched' END AS status,
  (coalesce(s.flag, 1) <> 0)::INT AS alive, coalesce(b.size_m, 0.1e0) AS size_m, coalesce(b.event, 0) AS event,
  {rnd("coalesce(s.x, b.x)", 3, "x")}
FROM base b FULL JOIN snap s ON b.idx = s.idx"""
    out["snapshot_scan"] = f"""{objects}{_snapshot()}
SELECT id, {rnd(f"r - {C.R_EARTH}e0", 3, "alt_km")} FROM snap WHERE coalesce(flag, 1) = 1"""
    out["snapshot_listing"] = """
SELECT 'output/snapshot_' || s_suppkey || '.csv' AS path, s_suppkey AS number FROM supplier WHERE s_suppkey % 9 <> 0"""
    out["mass_table_override"] = f"""WITH masses(rcs, type, kg) AS (VALUES {_MASSES}),
cells AS (
  SELECT ['SMALL', 'MEDIUM', 'LARGE', 'NONE'][p_partkey % 4 + 1] AS rcs, {_TYPES}[p_size % 4 + 1] AS type,
    arg_max(p_size + 0.5e0, p_partkey) AS kg FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1, 2)
SELECT m.rcs, m.type, coalesce(c.kg, m.kg) AS mass_kg FROM masses m LEFT JOIN cells c USING (rcs, type)"""
    out["satcat_dedupe"] = f"WITH{SATCAT} SELECT * FROM satcat"
    good = "page % 7 <> 3 AND page % 11 <> 5 AND page % 13 <> 6"
    out["satcat_json"] = f"""WITH{SATCAT.replace("FROM pages_" + chr(10), f"FROM pages_ WHERE {good}" + chr(10))} SELECT * FROM satcat"""
    out["satcat_page_report"] = f"""WITH{SATCAT}
SELECT page, CASE WHEN page % 7 = 3 THEN 'torn' WHEN page % 11 = 5 THEN 'error' WHEN page % 13 = 6 THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN {good} THEN count(*) ELSE 0 END AS records FROM pages_ GROUP BY page"""
    out["gp_window_filter"] = f"""WITH{HISTORY}
SELECT norad_id, EPOCH, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM history
WHERE norad_id IS NOT NULL AND epoch_ts::DATE BETWEEN DATE '1999-05-25' AND DATE '1999-06-15'"""
    out["asof_latest"] = f"""WITH{LATEST}
SELECT norad_id, EPOCH, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM latest"""
    out["asof_skip_counts"] = f"""WITH{HISTORY}
SELECT count(*) FILTER (norad_id IS NULL OR epoch_ts IS NULL) AS skipped_bad,
  count(*) FILTER (norad_id IS NOT NULL AND epoch_ts > {TARGET}) AS skipped_future,
  count(*) FILTER (norad_id IS NOT NULL AND epoch_ts <= {TARGET}) AS usable FROM history"""
    out["tle_metadata_join"] = f"""WITH{LATEST},{SATCAT},{_META}
SELECT norad_id, object_type_ AS object_type, designator AS intl_designator, country_ AS country,
  rcs_size_ AS rcs_size, rcs_value_ AS rcs_value FROM meta"""
    fixed = lambda e, n: f"format('{{:.{n}f}}', {e})"
    line = " || ' | ' || ".join(
        ["norad_id", "'OBJ ' || norad_id", "object_type_", "designator", "country_", "rcs_size_", "rcs_value_", "EPOCH",
         fixed("lat_deg", 4), fixed("lon_deg", 4), fixed("height_km", 2)]
        + [fixed(c, 3) for c in STATE[:3]] + [fixed(c, 5) for c in STATE[3:]]
        + [fixed("l_quantity", 2), fixed("l_tax * 100 + 90", 2), "line1", "'2 ' || l_linenumber"]
    )
    target_jd = f"(epoch_us({TARGET}) / 86400000000e0 + 2440587.5e0)"
    out["catalog_format"] = f"""{objects}{geodetic("objects", "placed", target_jd)},{LATEST},{SATCAT},{_META}
SELECT norad_id, {line} AS line FROM meta JOIN placed o ON o.idx::VARCHAR = norad_id
WHERE line1 IS NOT NULL"""
    out["geodetic_point"] = f"""{objects}{geodetic("objects", "placed", d(C.DEFAULT_EPOCH_JD))}
SELECT idx, {rnd("lat_deg", 4, "lat_deg")}, {rnd("lon_deg", 4, "lon_deg")}, {rnd("height_km", 3, "height_km")} FROM placed"""
    year = "(CASE WHEN o[19:20]::INT >= 57 THEN 1900 ELSE 2000 END + o[19:20]::INT)"
    out["element_lines"] = f"""WITH{_element_sets()}
SELECT l_orderkey, l_linenumber, status, o[3:7]::BIGINT AS number, trim(o[10:17]) AS designator,
  (make_date({year}, 1, 1) - DATE '1970-01-01')::DOUBLE + 2440587.5e0 + floor(trim(o[21:32])::DOUBLE) - 1e0 AS epoch_day,
  {rnd("trim(o[21:32])::DOUBLE - floor(trim(o[21:32])::DOUBLE)", 6, "epoch_fraction")},
  {rnd("('0.' || o[55:59] || 'e' || o[60:61])::DOUBLE", 9, "drag")},
  {rnd("trim(t[9:16])::DOUBLE", 4, "inclination")}, {rnd("trim(t[18:25])::DOUBLE", 4, "node")}, {rnd("('0.' || t[27:33])::DOUBLE", 7, "eccentricity")},
  {rnd("trim(t[35:42])::DOUBLE", 4, "perigee")}, {rnd("trim(t[44:51])::DOUBLE", 4, "anomaly")}, {rnd("trim(t[53:63])::DOUBLE", 8, "motion")},
  trim(t[64:68])::BIGINT AS revolution FROM decoded"""
    out["collision_fates"] = _fates()
    out["element_line_faults"] = f"""WITH{_element_sets()} SELECT status, count(*) AS n FROM decoded GROUP BY 1"""
    out["id_batches"] = """
SELECT p_partkey AS id, ((row_number() OVER (ORDER BY p_partkey) - 1) // 300)::BIGINT AS batch FROM part"""
    out["duplicate_ids"] = f"WITH{SATCAT} SELECT NORAD_CAT_ID AS id, count(*) AS n FROM pages_ GROUP BY 1 HAVING count(*) > 1"
    out["duplicate_totals"] = f"""WITH{SATCAT},
n AS (SELECT count(*) AS n FROM pages_ GROUP BY NORAD_CAT_ID)
SELECT sum(n)::BIGINT AS objects, count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicated FROM n"""

    # projections
    out["type_normalize"] = f"""{objects}
SELECT idx, type, CASE rcs WHEN '' THEN 'NONE' ELSE rcs END AS rcs_key FROM objects"""
    moon_xyz = ", ".join(rnd(c, 2, c) for c in ("mx", "my", "mz"))
    out["moon_position"] = f"""WITH e AS (SELECT event_id, epoch_us(ts) / 86400000000e0 + 2440587.5e0 AS jd FROM events)
{moon("e", "m", "jd")} SELECT event_id, {moon_xyz} FROM m"""
    out["moon_path"] = f"""WITH e AS (SELECT DISTINCT floor(({EVENT_S}) / 3600e0) * 3600e0 AS t_s FROM events)
{moon("e", "m", f"{d(C.DEFAULT_EPOCH_JD)} + t_s / 86400e0")}
SELECT t_s, {", ".join(rnd(m, 2, f"{a}_km") for m, a in zip(("mx", "my", "mz"), "xyz"))} FROM m"""
    acc = ", ".join(rnd(e, 12, n) for e, n in zip(accel(("x", "y", "z"), ("mx", "my", "mz")), ("ax", "ay", "az")))
    out["acceleration"] = f"{objects}{moon('objects', 'm', d(C.DEFAULT_EPOCH_JD))} SELECT idx, {acc} FROM m"
    out["rk4_step"] = f"{objects}{one_step('objects', 'g', '0e0', '60e0', NEXT)} SELECT idx, {rounded_state('n')} FROM g"
    picked = ", ".join(
        rnd(f"CASE WHEN h > 0 THEN n{c} ELSE {c} END", 3 if len(c) == 1 else 6, c) for c in STATE
    )
    out["propagate_state"] = f"""{objects},
o AS (SELECT *, (idx % 1000) * 10e0 AS t, (idx % 61)::DOUBLE - 1e0 AS h FROM objects)
{one_step("o", "g", "t", "h", NEXT)} SELECT idx, {picked} FROM g"""
    slow = ", ".join(f"{c} * (0.97e0 + (idx % 50) / 1000e0) AS {c}" for c in ("vx", "vy", "vz"))
    out["orbital_elements"] = f"""{objects},
o AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, vx*vx + vy*vy + vz*vz AS v2, x*vx + y*vy + z*vz AS rv
  FROM (SELECT * REPLACE ({slow}) FROM objects)),
el AS (SELECT *, 1e0 / (2e0 / r - v2 / {C.MU_EARTH}e0) AS a,
  sqrt(((v2 / {C.MU_EARTH}e0 - 1e0 / r) * x - rv / {C.MU_EARTH}e0 * vx)**2 + ((v2 / {C.MU_EARTH}e0 - 1e0 / r) * y - rv / {C.MU_EARTH}e0 * vy)**2
    + ((v2 / {C.MU_EARTH}e0 - 1e0 / r) * z - rv / {C.MU_EARTH}e0 * vz)**2) AS e FROM o)
SELECT idx, {rnd("a", 3, "a")}, {rnd("e", 6, "e")}, {rnd(INC, 4, "inc_deg")}, {rnd(f"a * (1e0 - e) - {C.R_EARTH}e0", 3, "perigee_alt")},
  {rnd(f"a * (1e0 + e) - {C.R_EARTH}e0", 3, "apogee_alt")}, {rnd(f"{d(2 * C.PI)} * sqrt(a**3 / {C.MU_EARTH}e0) / 60e0", 6, "period_min")} FROM el"""
    out["alt_inc"] = f"{sinking} SELECT idx, {rnd(ALT, 3, 'alt_km')}, {rnd(INC, 4, 'inc_deg')} FROM sinking"
    s = "((idx % 101) / 100e0)"
    herm = ", ".join(
        rnd(f"{c} * (1e0 - {s})**2 * (1e0 + 2e0*{s}) + v{c} * 60e0 * {s} * (1e0 - {s})**2 + n{c} * {s}**2 * (3e0 - 2e0*{s}) - nv{c} * 60e0 * {s}**2 * (1e0 - {s})", 3, c)
        for c in "xyz"
    ) + ", " + ", ".join(
        rnd(f"(6e0*{s}*(1e0 - {s}) * (n{c} - {c}) + v{c} * 60e0 * (1e0 - {s}) * (1e0 - 3e0*{s}) + nv{c} * 60e0 * {s} * (3e0*{s} - 2e0)) / 60e0", 6, f"v{c}")
        for c in "xyz"
    )
    out["hermite_interpolate"] = f"{objects}{one_step('objects', 'g', '0e0', '60e0', NEXT)} SELECT idx, {herm} FROM g"
    out["format_distance"] = """
SELECT event_id, CASE WHEN km < 1 THEN format('{:.0f} m', km * 1000) ELSE format('{:.2f} km', km) END AS text
FROM (SELECT event_id, value / 100e0 + 0.00025e0 AS km FROM events)"""
    out["csv_quote"] = """SELECT event_id, '"' || replace(props, '"', '""') || '"' AS quoted FROM events"""
    out["to_jd"] = f"SELECT event_id, {rnd('floor(epoch_us(ts) / 1000000e0) / 86400e0 + 2440587.5e0', 6, 'jd')} FROM events"
    out["jd_to_utc"] = """
SELECT event_id, strftime(make_timestamp((round((2460310.5e0 + event_id * 0.0625e0 + 0.00001e0 - 2440587.5e0) * 86400e0) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S UTC') AS utc
FROM events"""
    shapes = {"alpha": C.AM_ALPHA, "mu1": C.AM_MU1, "sigma1": C.AM_SIGMA1, "mu2": C.AM_MU2, "sigma2": C.AM_SIGMA2}
    out["ramp"] = f"""SELECT event_id, {", ".join(rnd(_ramp("lg", v), 9, n) for n, v in shapes.items())}
FROM (SELECT event_id, log10(value / 100e0) AS lg FROM events)"""

    # filters and lookups
    out["reentry"] = f"{sinking} SELECT idx, (sqrt(x*x + y*y + z*z) >= {C.R_EARTH}e0)::INT AS alive FROM sinking"
    out["viewer_filter"] = f"""{shown}
SELECT idx, name, category, {rnd("alt_km", 3, "alt_km")}, {rnd("inc_deg", 4, "inc_deg")} FROM shown
WHERE category IN ('PAYLOAD', 'DEBRIS', 'FRAGMENTS') AND alt_km BETWEEN 400 AND 1600 AND inc_deg BETWEEN 20 AND 120
  AND (name ILIKE '%j 1%' OR id::VARCHAR LIKE '%j 1%') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = idx)"""
    out["name_search"] = "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'"
    out["category_counts"] = f"""{shown}
SELECT coalesce(category, 'ALL') AS category, count(*) AS n FROM shown GROUP BY GROUPING SETS ((category), ())"""
    out["regime_counts"] = f"""{objects},
alts AS (SELECT sqrt(x*x + y*y + z*z) * (1e0 + idx % 6) - {C.R_EARTH}e0 AS h FROM objects)
SELECT regime, count(h) AS n FROM (VALUES ('LEO', 0e0, 2000e0), ('MEO', 2000e0, 35000e0), ('GEO', 35000e0, 36500e0)) r(regime, lo, hi)
LEFT JOIN alts ON h BETWEEN lo AND hi GROUP BY regime"""
    out["occlusion"] = f"""{objects}
SELECT idx, (al < 0 AND sqrt((x - al * 0.6e0)**2 + (y - al * 0.48e0)**2 + (z - al * 0.64e0)**2) < {C.R_EARTH}e0)::INT AS hidden
FROM (SELECT *, x * 0.6e0 + y * 0.48e0 + z * 0.64e0 AS al FROM objects)"""
    out["pick_nearest"] = f"""{objects},
ray AS (SELECT *, sqrt(1e0 + 0.05e0 * 0.05e0 + 0.15e0 * 0.15e0) AS len FROM objects),
hit AS (
  SELECT *, ((x - 20000e0) * -1e0 + (y - 1000e0) * -0.05e0 + (z + 3000e0) * 0.15e0) / len AS along,
    (x - 20000e0)**2 + (y - 1000e0)**2 + (z + 3000e0)**2 AS gap2 FROM ray)
SELECT idx, id, name, {rnd("along - sqrt(160000e0 - (gap2 - along * along))", 3, "distance")} FROM hit
WHERE gap2 - along * along <= 160000e0 AND along > 0 ORDER BY along - sqrt(160000e0 - (gap2 - along * along)), idx LIMIT 1"""
    out["impact_target"] = f"""{objects}
SELECT idx, idx % 500 AS id, name, {rounded_state()} FROM objects WHERE idx % 500 = 123 ORDER BY idx DESC LIMIT 1"""
    out["snapshot_types"] = f"""{objects}{_snapshot()},
types AS (
  SELECT CASE WHEN idx % 97 = 0 THEN idx::VARCHAR WHEN idx % 101 = 0 THEN 'n/a' ELSE idx::VARCHAR END AS tid,
    CASE WHEN idx % 97 = 0 THEN 'row' WHEN type = 'UNKNOWN' THEN 'TBA' ELSE type END AS type
  FROM objects WHERE {_LINES_OK})
SELECT id, coalesce(nullif(type, ''), 'UNKNOWN') AS type FROM snap LEFT JOIN types ON tid = id::VARCHAR"""
    out["assign_masses"] = f"""{population}
SELECT idx, CASE WHEN event < 0 THEN mass_kg ELSE 0.25e0 END AS mass_kg,
  {rnd("CASE WHEN event < 0 THEN area_to_mass ELSE 0.5e0 END", 9, "area_to_mass")} FROM population"""

    # grid
    celled = objects + _cells("objects", GRID)
    live = population + _cells("(SELECT * FROM population WHERE alive)", GRID)
    out["grid_cells"] = f"{celled} SELECT idx, cx, cy, cz, cell_key FROM celled"
    out["cell_unpack"] = f"{celled} SELECT idx, cx AS ux, cy AS uy, cz AS uz FROM celled"
    out["cell_size"] = f"""{objects}
SELECT {rnd("greatest(1e0, 20e0 * v + 5e0 + 0.000002e0 * 2e0 * v * 1000e0)", 6, "cell_km")}
FROM (SELECT max(sqrt(vx*vx + vy*vy + vz*vz)) AS v FROM objects)"""
    out["cell_occupancy"] = f"{live} SELECT cell_key, count(*) AS n FROM celled GROUP BY cell_key"
    out["cell_summary"] = f"""{live}, n AS (SELECT count(*) AS n FROM celled GROUP BY cell_key)
SELECT sum(n)::BIGINT AS objects, count(*) AS cells, max(n) AS busiest, sum(n * (n - 1) // 2)::BIGINT AS inner_pairs FROM n"""
    out["cell_offsets"] = f"""{celled}, n AS (SELECT cell_key, count(*) AS n FROM celled GROUP BY cell_key)
SELECT cell_key, n, (sum(n) OVER (ORDER BY cell_key) - n)::BIGINT AS "begin" FROM n"""
    # every touching pair of objects, counted at the object of the lower cell
    out["grid_pairs"] = f"""{celled}, pairs AS (
  SELECT a.cell_key, count(*) AS pairs FROM celled a JOIN celled b ON {_touching()}
    AND (a.cell_key < b.cell_key OR (a.cell_key = b.cell_key AND a.idx < b.idx)) GROUP BY a.cell_key)
SELECT c.cell_key, n, coalesce(pairs, 0) AS pairs
FROM (SELECT cell_key, count(*) AS n FROM celled GROUP BY cell_key) c LEFT JOIN pairs USING (cell_key)"""
    out["cell_neighbourhood"] = f"""{objects}{_cells("objects", "400e0")}
SELECT a.idx AS seed, b.idx AS idx FROM celled a JOIN supplier ON s_suppkey = a.idx JOIN celled b ON {_touching()}"""
    seen = shown + _cells("shown", GRID)
    out["occupied_cells"] = f"{seen} SELECT DISTINCT cell_key, cx, cy, cz FROM celled"
    out["nearest_cells"] = f"""{seen}, c AS (SELECT DISTINCT cell_key, cx, cy, cz FROM celled),
g AS (SELECT cell_key, sqrt(((cx + 0.5e0) * {GRID} - 20000e0)**2 + ((cy + 0.5e0) * {GRID} - 1000e0)**2 + ((cz + 0.5e0) * {GRID} + 3000e0)**2) AS gap FROM c)
SELECT cell_key, {rnd("gap", 3, "dist_km")} FROM g ORDER BY gap, cell_key LIMIT 300"""

    # screening
    out["pair_filter"] = f"{pairs} SELECT step::BIGINT AS step, i, j, outcome FROM passed"
    times = f"{rnd('t', 2, 't')}, {rnd('miss_km', 6, 'miss_km')}, {rnd('v_rel_km_s', 5, 'v_rel_km_s')}"
    out["tca_refine"] = f"{found} SELECT step::BIGINT AS step, i, j, {times} FROM approaches"
    out["conjunctions"] = f"""{found}
SELECT {rnd("t", 2, "t_s")}, i AS id1, j AS id2, 'OBJ ' || i AS name1, 'OBJ ' || j AS name2,
  {rnd("miss_km", 6, "miss_km")}, {rnd("v_rel_km_s", 5, "v_rel_km_s")}, collision::INT AS collision FROM found"""
    out["collisions"] = f"{found} SELECT i, j, {rnd('miss_km', 6, 'miss_km')} FROM found WHERE collision"
    out["miss_histogram"] = f"""{found}
SELECT b AS below_km, (SELECT count(*) FROM found WHERE miss_km < b) AS n FROM (VALUES (0.1e0), (1e0), (2e0), (5e0)) bins(b)"""
    out["closest_approach"] = f"{found} SELECT i, j, {times} FROM found ORDER BY found.miss_km, found.t, i, j LIMIT 1"
    out["conjunction_totals"] = f"""{found}
SELECT count(*) AS conjunctions, count(*) FILTER (collision) AS collisions FROM found"""
    wide = "2e0 * max(sqrt(vx*vx + vy*vy + vz*vz))"
    stats = f"""{pairs},
widths AS (SELECT step, greatest({C.MIN_CELL_KM}e0, {wide} * 60e0 + 25e0 + {d(C.GRAVITY_GRADIENT)} * ({wide}) * {d(60.0**3)}) AS w FROM states GROUP BY step),
gridded AS (SELECT s.*, w FROM states s JOIN widths USING (step)){_cells("gridded", "w")},
grid AS (
  SELECT a.step, count(*) AS candidates FROM celled a JOIN celled b ON a.step = b.step AND a.idx < b.idx AND {_touching()} GROUP BY a.step),
stats AS (
  SELECT g.step::BIGINT AS step, candidates, coalesce(refined, 0) AS refined, coalesce(co, 0) AS co_orbiting FROM grid g LEFT JOIN (
    SELECT step, count(*) FILTER (outcome = 'REFINE') AS refined, count(*) FILTER (outcome <> 'REFINE') AS co FROM passed GROUP BY step) p
    ON p.step = g.step)"""
    out["screening_stats"] = f"{stats} SELECT * FROM stats"
    out["screening_report"] = f"""{stats}
SELECT count(*) AS steps, sum(candidates)::BIGINT AS candidates, {rnd("avg(candidates)", 4, "mean_candidates")}, sum(refined)::BIGINT AS refined,
  max(co_orbiting) AS most_co_orbiting FROM stats"""
    out["collision_envelope"] = f"{population} SELECT max(size_m) * (0.001e0 * 100e0) AS threshold_km FROM population"

    # runs
    out["final_state"] = f"{sinking}{run('sinking', 3, '60e0')} SELECT idx, {rounded_state()}, live::INT AS alive FROM s3"
    sampled = " UNION ALL ".join(f"SELECT {60.0 * n}e0 AS t_s, live FROM s{n}" for n in (0, 2, 4))
    out["population_samples"] = f"""{sinking}{run('sinking', 4, '60e0')}
SELECT t_s, count(*) AS objects, count(*) FILTER (live) AS alive FROM ({sampled}) GROUP BY t_s"""
    path = " UNION ALL ".join(f"SELECT {60.0 * n}e0 AS t_s, id, name, x, y, z FROM s{n}" for n in range(4))
    tracked = objects + ", tracked AS (SELECT * FROM objects WHERE idx IN (SELECT c_custkey FROM customer))" + run("tracked", 3, "60e0")
    out["trajectories"] = f"""{tracked}
SELECT t_s, id, name, {", ".join(rnd(c, 3, f"{c}_km") for c in "xyz")} FROM ({path})"""
    out["trajectory_arrays"] = f"""{tracked}
SELECT id, name, count(*) AS n_points, {rnd("arg_min(x, t_s)", 3, "first_x")}, {rnd("arg_max(x, t_s)", 3, "last_x")} FROM ({path}) GROUP BY id, name"""
    out["plot_extent"] = f"{objects} SELECT {rnd('max(greatest(abs(x), abs(y), abs(z))) * 1.05e0', 3, 'extent_km')} FROM objects"
    axis = f"1e0 / (2e0 / sqrt(x*x + y*y + z*z) - (vx*vx + vy*vy + vz*vz) / {C.MU_EARTH}e0)"
    out["catalog_fate"] = f"""{sinking}{run("sinking", 3, "60e0")},
ends AS (
  SELECT f.idx, f.live AND f.idx % 13 <> 0 AS alive, f.r < {C.R_EARTH}e0 AS sunk, abs(f.a - g.a) AS da
  FROM (SELECT *, {axis} AS a, sqrt(x*x + y*y + z*z) AS r FROM s3) f JOIN (SELECT idx, {axis} AS a FROM sinking) g ON g.idx = f.idx)
SELECT count(*) FILTER (NOT alive AND sunk) AS lost, count(*) FILTER (NOT alive AND NOT sunk) AS destroyed,
  {rnd("max(da) FILTER (alive)", 4, "max_da_km")}, arg_max(idx, da) FILTER (alive) AS max_da_id FROM ends"""
    out["population"] = f"""{population}
SELECT count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND event < 0) AS alive_catalog,
  count(*) FILTER (alive AND event >= 0) AS alive_fragments FROM population"""

    # breakups
    out["breakup_energy"] = f"""{events}
SELECT event, t_idx AS target, p_idx AS projectile, {rnd("v", 6, "v_rel_km_s")}, {rnd("energy", 3, "energy_j_per_g")},
  catastrophic::INT AS catastrophic, {rnd("m", 4, "sbm_mass_kg")}, {rnd("expected", 4, "expected_fragments")} FROM events_"""
    out["impact_energy"] = f"""{objects}
SELECT idx, {rnd("500e0 * 10e0 * ((idx % 15) + 0.5e0)**2 / greatest(mass_kg, 0.000001e0)", 4, "energy_j_per_g")} FROM objects"""
    u = "(((idx * 7919) % 10007) / 10007e0)"
    out["size_inverse_cdf"] = f"""{objects}
SELECT idx, {rnd(f"0.1e0 * pow(1e0 - {u} * (1e0 - pow(size_m / 0.1e0, -1.71e0)), {d(-1 / 1.71)})", 9, "fragment_m")} FROM objects"""
    out["escape_filter"] = f"""{objects}
SELECT idx, (0.5e0 * (vx*vx + vy*vy + vz*vz) * (1e0 + (idx % 80) / 100e0)**2 - {C.MU_EARTH}e0 / sqrt(x*x + y*y + z*z) >= 0)::INT AS escaped
FROM objects"""
    out["breakup_draws"] = f"""{draws}
SELECT event, count(*) AS n, {rnd("sum(size_m)", 5, "size_sum")}, {rnd("max(mass_kg)", 5, "heaviest")} FROM draws GROUP BY event"""
    out["mass_budget"] = f"""{kept}
SELECT event, side::BIGINT AS side, count(*) AS n, {rnd("sum(mass_kg)", 4, "mass_kg")} FROM kept GROUP BY event, side"""
    out["breakup_fragments"] = f"""{kept}
SELECT event, k, side::BIGINT AS side, rcs, {rnd("size_m", 6, "size_m")}, {rnd("mass_kg", 5, "mass_kg")},
  {rnd("vx", 5, "vx")}, {rnd("vy", 5, "vy")}, {rnd("vz", 5, "vz")}, escaped::INT AS escaped FROM kept"""
    out["breakup_fragments_sql"] = f"SELECT * EXCLUDE (escaped) FROM ({out['breakup_fragments']})"
    out["fragment_ids"] = f"{kept}{_NUMBERED} SELECT event, k, seq, serial + 10000000 AS id FROM numbered"
    settled = ", ".join(
        rnd(f"CASE WHEN remaining_s > 0 THEN n{c} ELSE {c} END", 2 if len(c) == 1 else 5, c) for c in STATE
    )
    out["fragment_states"] = f"""{kept}{_NUMBERED}{one_step("numbered", "g", "t", "remaining_s", NEXT)}
SELECT serial + 1000000000 AS idx, serial + 10000000 AS id, 'FRAG ' || event || '-' || seq AS name, rcs,
  (sqrt(nx*nx + ny*ny + nz*nz) >= {C.R_EARTH}e0)::INT AS alive, event, {settled} FROM g"""
    out["breakup_events"] = f"""{kept}{_REPORT}
SELECT event, t_idx AS target_idx, p_idx AS projectile_idx, t_name AS target_name, p_name AS projectile_name,
  catastrophic::INT AS catastrophic, fragments, {rnd("fragments_mass_kg", 3, "fragments_mass_kg")}, escaped FROM report"""
    out["breakup_log"] = f"""{kept}{_REPORT}
SELECT {rnd("t", 3, "t_s")}, event, t_idx::VARCHAR AS target_id, coalesce(p_idx::VARCHAR, '') AS projectile_id, fragments, escaped, 0 AS truncated FROM report"""
    out["breakup_totals"] = f"""{kept}{_REPORT}
SELECT count(*) AS events, count(*) FILTER (catastrophic) AS catastrophic, sum(escaped)::BIGINT AS escaped,
  sum(fragments)::BIGINT AS fragments FROM report"""
    # the horizontal velocity turns in the plane of the local horizon: split v into its parts
    out["impact_geometry"] = f"""{objects},
k AS (SELECT *, x / r AS kx, y / r AS ky, z / r AS kz FROM (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM objects)),
up AS (SELECT *, kx*vx + ky*vy + kz*vz AS vk FROM k),
flat AS (SELECT *, vx - vk*kx AS hx, vy - vk*ky AS hy, vz - vk*kz AS hz FROM up),
ang AS (
  SELECT *, CASE WHEN {_u(9, 0, "idx", "0")} < 0.5e0 THEN -1e0 ELSE 1e0 END *
    CASE WHEN 9.5e0 >= 2e0 * sqrt(hx*hx + hy*hy + hz*hz) THEN {d(C.PI)} ELSE 2e0 * asin(9.5e0 / (2e0 * sqrt(hx*hx + hy*hy + hz*hz))) END AS th
  FROM flat)
SELECT idx AS event, (mass_kg >= 10)::INT AS object_is_target,
  {rnd("vk*kx + hx*cos(th) + (ky*hz - kz*hy)*sin(th)", 6, "vx")}, {rnd("vk*ky + hy*cos(th) + (kz*hx - kx*hz)*sin(th)", 6, "vy")},
  {rnd("vk*kz + hz*cos(th) + (kx*hy - ky*hx)*sin(th)", 6, "vz")} FROM ang"""
    at = "((f.t - f.step * 60e0) / 60e0)"
    def mid(p):
        pos = [rnd(f"{p}.{c} * (1e0 - {at})**2 * (1e0 + 2e0*{at}) + {p}.v{c} * 60e0 * {at} * (1e0 - {at})**2 + {p}.n{c} * {at}**2 * (3e0 - 2e0*{at}) - {p}.nv{c} * 60e0 * {at}**2 * (1e0 - {at})", 2, f"{p}_{c}") for c in "xyz"]
        vel = [rnd(f"(6e0*{at}*(1e0 - {at}) * ({p}.n{c} - {p}.{c}) + {p}.v{c} * 60e0 * (1e0 - {at}) * (1e0 - 3e0*{at}) + {p}.nv{c} * 60e0 * {at} * (3e0*{at} - 2e0)) / 60e0", 4, f"{p}_v{c}") for c in "xyz"]
        return ", ".join(pos + vel)
    out["collision_parents"] = found + " UNION ALL ".join(
        f" SELECT f.i, f.j, {mid('i')}, {mid('j')} FROM found f JOIN e{n} i ON i.idx = f.i JOIN e{n} j ON j.idx = f.j WHERE f.collision AND f.step = {n}"
        for n in range(2))

    # reports over time
    kinds = ", ".join(f"count(*) FILTER (type = '{t}') AS {t.lower().replace(' ', '_')}" for t in C.OBJECT_TYPES)
    out["rcs_type_pivot"] = f"""{objects}
SELECT CASE rcs WHEN '' THEN 'NONE' ELSE rcs END AS rcs, {kinds} FROM objects GROUP BY 1"""
    hours = f"WITH{_HOURS} SELECT hour, n, {rnd('total', 4, 'total')} FROM hours"
    out["hourly_tumbling"] = hours
    out["hourly_stream"] = hours
    out["cascade_cumulative"] = f"""WITH{_HOURS}
SELECT hour, n, (sum(n) OVER (ORDER BY hour))::BIGINT AS cum_n, {rnd("sum(total) OVER (ORDER BY hour)", 3, "cum_total")} FROM hours"""
    out["ema_value"] = _LAST_EMA
    out["ema_stream"] = _LAST_EMA
    out["sample_n"] = f"{objects} SELECT idx, name FROM objects ORDER BY md5('42:' || idx), idx LIMIT 500"
    life = int(C.EVENT_LIFETIME_S * 3600)
    out["aged_events"] = f"""
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place
FROM events QUALIFY place <= {C.RECENT_EVENTS} AND ts > max(ts) OVER (PARTITION BY event_type) - INTERVAL {life} SECOND"""
    out["recent_events"] = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"
    out["category_regimes"] = f"""{objects}{one_step("objects", "g", "0e0", "60e0", NEXT)},
now AS (SELECT type AS category, {", ".join(f"n{c} AS {c}" for c in STATE)} FROM g),
alts AS (SELECT category, {ALT} AS h, {INC} AS inc FROM now WHERE sqrt(x*x + y*y + z*z) >= {C.R_EARTH}e0)
SELECT category, CASE WHEN h BETWEEN 0 AND 2000 THEN 'LEO' WHEN h BETWEEN 2000 AND 35000 THEN 'MEO' WHEN h BETWEEN 35000 AND 36500 THEN 'GEO' ELSE 'OTHER' END AS regime,
  count(*) AS n, {rnd("avg(h)", 3, "mean_alt_km")}, {rnd("avg(inc)", 4, "mean_inc_deg")} FROM alts GROUP BY 1, 2"""
    return out
