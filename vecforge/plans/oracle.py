"""The same queries as DuckDB SQL, written relationally and without the library's code paths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vecforge.operators.stats import T_ABOVE, T_BELOW
from vecforge.operators.text import NEEDLE, QUESTION

EPS = "1.1920928955078125e-07::DOUBLE"
PLAIN, VARIED = "1.0::DOUBLE", "((1 + vec_id % 7) * 0.3::DOUBLE)"
SWEEP = "[1, 2, 3, 4, 6, 8, 10, 14, 19, 24, 38, 76]"


def r(e: str, n: int = 6) -> str:
    return f"(round(({e})::DOUBLE, {n}) + 0.0)"


def narrow(e: str, bits: int, low: int, most: str, beyond: str) -> str:
    """Round a positive expression to a float format."""
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2({e})), {low}) - {bits})"
    value = f"round_even({e} / {unit}, 0) * {unit}"
    return f"(CASE WHEN {e} = 0 THEN 0.0::DOUBLE WHEN {value} > {most} THEN {beyond} ELSE {value} END)"


def signed(e: str, rounded: Callable[[str], str]) -> str:
    return f"(CASE WHEN {e} < 0 THEN -{rounded(f'abs({e})')} ELSE {rounded(f'abs({e})')} END)"


def fp16(e: str) -> str:
    return narrow(e, 10, -14, "65504", "'inf'::DOUBLE")


def bf16(e: str) -> str:
    return narrow(e, 7, -126, "3.3895313892515355e38", "'inf'::DOUBLE")


def e4m3(e: str) -> str:
    return narrow(e, 3, -6, "448", "448.0::DOUBLE")


def rotate(v: str, d: int = 64, root: bool = True) -> str:
    out = f"list_transform(range({d}), lambda i: list_sum(list_transform(range({d}), lambda j: {v}[j + 1] * (1 - 2 * (bit_count((i & j)::BIGINT)::INT % 2)))))"
    return f"list_transform({out}, lambda w: w / sqrt({d}.0::DOUBLE))" if root else out


def points(name: str, source: str, size: int) -> str:
    """Nearest points of even sum of the blocks b of ``source`` (vec_id, k, b): (vec_id, k, d)."""
    idx = f"range(1, {size + 1})"
    return f"""
{name}1 AS (SELECT vec_id, k, b, list_transform(b, lambda y: round_even(y, 0)) AS p FROM {source}),
{name}2 AS (SELECT *, list_transform({idx}, lambda i: b[i] - p[i]) AS o FROM {name}1),
{name}3 AS (SELECT *, list_position(list_transform(o, lambda z: abs(z)), list_max(list_transform(o, lambda z: abs(z)))) AS f, list_sum(p)::BIGINT % 2 <> 0 AS odd FROM {name}2),
{name} AS (SELECT vec_id, k, b, list_transform({idx}, lambda i: CASE WHEN odd AND i = f THEN p[i] + CASE WHEN o[i] >= 0 THEN 1 ELSE -1 END ELSE p[i] END) AS d FROM {name}3)"""


def encoded(variant: str, q: int, factor: str = PLAIN, dims: int = 64, unit: bool = True, turn: bool = True, per: str = "vector", where: str = "") -> str:
    """CTEs ending in enc (vec_id, label, x, norm16, tops, z): the points as doubles, z in coordinate order."""
    size = 8 if variant == "e8" else 4
    n = dims // size
    y = rotate("u", dims) if turn else "u"
    top = {
        "vector": f"list_transform(range({n}), lambda k: t)",
        "block": f"list_transform(range({n}), lambda k: {fp16(f'greatest(list_max(list_transform(y[k * {size} + 1 : k * {size} + {size}], lambda a: abs(a))), {EPS})')})",
        "global": f"list_transform(range({n}), lambda k: gm)",
    }[per]
    search = {"d4": points("dn", "blk", 4) + ", near AS (SELECT vec_id, k, d FROM dn)"}
    search["e8"] = f"""{points("whole", "blk", 8)},
shifted AS (SELECT vec_id, k, list_transform(b, lambda y: y - 0.5::DOUBLE) AS b FROM blk), {points("half", "shifted", 8)},
near AS (SELECT w.vec_id, w.k, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: (w.b[i] - w.d[i]) * (w.b[i] - w.d[i]))) <= list_sum(list_transform(range(1, 9), lambda i: (w.b[i] - h.d[i] - 0.5) * (w.b[i] - h.d[i] - 0.5))) THEN w.d ELSE list_transform(h.d, lambda z: z + 0.5::DOUBLE) END AS d FROM whole w JOIN half h USING (vec_id, k))"""
    search["zn"] = "near AS (SELECT vec_id, k, list_transform(b, lambda y: round_even(y, 0)) AS d FROM blk)"
    return f"""
vec AS (SELECT vec_id, label, list_transform(embedding[1:{dims}], lambda a: a::DOUBLE * {factor}) AS x FROM embeddings {where}),
nrm AS (SELECT *, greatest(sqrt(list_sum(list_transform(x, lambda a: a * a))), {EPS}) AS nm FROM vec),
uni AS (SELECT *, {"list_transform(x, lambda a: a / nm)" if unit else "x"} AS u FROM nrm),
rot AS (SELECT *, {y} AS y FROM uni),
mx AS (SELECT *, {fp16(f"greatest(list_max(list_transform(y, lambda a: abs(a))), {EPS})")} AS t FROM rot),
gl AS (SELECT max(greatest(list_max(list_transform(y, lambda a: abs(a))), {EPS})) AS gm FROM rot WHERE label = 0),
tp AS (SELECT *, {top} AS tops FROM mx, gl),
blk AS (SELECT vec_id, k, list_transform(y[k * {size} + 1 : k * {size} + {size}], lambda a: a / (tops[k + 1] / {q}.0::DOUBLE)) AS b FROM tp, (SELECT unnest(range({n})) AS k)),
{search[variant]},
zs AS (SELECT vec_id, flatten(list(list_transform(d, lambda a: greatest(-{q}, least({q}, a))) ORDER BY k)) AS z FROM near GROUP BY vec_id),
enc AS (SELECT tp.vec_id, tp.label, tp.x, {fp16("nm") if unit else "1.0::DOUBLE"} AS norm16, tops, z FROM tp JOIN zs USING (vec_id))"""


def decoded(variant: str, q: int, factor: str = PLAIN, dims: int = 64, turn: bool = True, **more) -> str:
    """CTEs ending in dec (vec_id, label, x, y)."""
    size = 8 if variant == "e8" else 4
    back = rotate("w", dims) if turn else "w"
    return f"""{encoded(variant, q, factor, dims, turn=turn, **more)},
val AS (SELECT *, list_transform(range({dims}), lambda i: z[i + 1] * (tops[i // {size} + 1] / {q}.0::DOUBLE)) AS w FROM enc),
dec AS (SELECT vec_id, label, x, list_transform({back}, lambda a: a * norm16) AS y FROM val)"""


def coordinates(source: str, keys: str, vec: str) -> str:
    return f"""SELECT {keys}, i::INT AS "at", {r(f'{vec}[i + 1] + 2.3e-9::DOUBLE', 7)} AS value FROM {source}, (SELECT unnest(range(64)) AS i)"""


def error(x: str = "x", y: str = "y", dims: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {dims + 1}), lambda i: ({x}[i] - {y}[i]) * ({x}[i] - {y}[i])))"


def dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {x}[i] * {y}[i]))"


def fp8_block(mode: str, factor: str = VARIED) -> str:
    value = signed("s", e4m3) if mode == "e4m3" else "round_even(s / (448.0::DOUBLE / 127.0::DOUBLE), 0) * (448.0::DOUBLE / 127.0::DOUBLE)"
    return f"""vec AS (SELECT vec_id, label, list_transform(embedding, lambda a: a::DOUBLE * {factor}) AS x FROM embeddings),
sc AS (SELECT *, greatest(list_max(list_transform(x, lambda a: abs(a))), 1e-4::DOUBLE) / 448.0::DOUBLE AS scale FROM vec),
ins AS (SELECT *, list_transform(x, lambda a: greatest(-448.0::DOUBLE, least(448.0::DOUBLE, a / scale))) AS w FROM sc),
fp8 AS (SELECT vec_id, label, x, list_transform(w, lambda s: ({value}) * scale) AS y FROM ins)"""


def t_value(table: dict[int, float], df: str, above: bool) -> str:
    rows = ", ".join(f"({k}, {v}::DOUBLE)" for k, v in table.items())
    if above:
        return f"coalesce((SELECT arg_min(t, k) FROM (VALUES {rows}) p(k, t) WHERE k >= {df}), 1.96)"
    return f"CASE WHEN {df} > 100 THEN 1.96 ELSE (SELECT arg_max(t, k) FROM (VALUES {rows}) p(k, t) WHERE k <= greatest({df}, 1)) END"


def mean_ci(source: str, keys: str, above: bool = False) -> str:
    """SELECT of keys, mean, ci95, std, n over ``source`` (keys, v)."""
    t = t_value(T_ABOVE if above else T_BELOW, "n - 1", above)
    return f"""SELECT {keys}, {r('mean')} AS mean, {r(f'CASE WHEN n <= 1 THEN 0.0 ELSE ({t}) * std / sqrt(n) END')} AS ci95, {r('CASE WHEN n <= 1 THEN 0.0 ELSE std END')} AS std, n
FROM (SELECT {keys}, avg(v) AS mean, coalesce(stddev_samp(v), 0.0) AS std, count(*) AS n FROM {source} WHERE v IS NOT NULL GROUP BY {keys}) g"""


VECTORS = "vec AS (SELECT vec_id, label, list_transform(embedding, lambda a: a::DOUBLE) AS x FROM embeddings)"
LATTICE = {"d4": "(d // 4) * ceil(4 * log2(2 * q + 1) - 1) + 32", "e8": "(d // 8) * ceil(8 * log2(2 * q + 1)) + 32"}
GRID = " UNION ALL ".join(f"SELECT '{v}' AS variant, unnest({q}) AS q" for v, q in (("d4", [2, 4, 5, 10, 19, 38, 76, 152]), ("e8", [1, 2, 4, 5, 10, 19, 37, 38, 76, 152]), ("tq", [2, 3, 4, 6, 8]), ("fp8", [0]), ("bf16", [0])))
RECORDS = """rec AS (SELECT user_id % 32 AS passage, CASE WHEN event_id % 2 = 0 THEN 'd4' ELSE 'tq' END AS codec,
  (CASE WHEN event_id % 2 = 0 THEN CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 38 ELSE 152 END ELSE CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 8 END END)::INT AS param,
  value AS a, value * 0.5::DOUBLE + event_id % 5 AS b, CASE WHEN event_id % 17 = 0 THEN 'engine died' END AS fatal FROM events),
good AS (SELECT *, codec || '_' || param AS channel FROM rec WHERE fatal IS NULL)"""
LATENCIES = "lat AS (SELECT CASE event_id % 3 WHEN 0 THEN 'd4' WHEN 1 THEN 'e8' ELSE 'bf16' END AS codec, (event_id % 4)::INT AS param, value AS us FROM events)"
Q_SWEEP = f"""raw AS (SELECT event_type AS stream, ({SWEEP}[event_id % 12 + 1])::INT AS q, value FROM events),
own AS (SELECT stream, q, value / (q * q) AS v FROM raw),
base AS (SELECT stream, avg(v * q * q) / 200 AS baseline FROM own GROUP BY stream),
sw AS (SELECT g.stream, q, mean, ({t_value(T_BELOW, 'n - 1', False)}) * std / sqrt(n) AS ci95, baseline
  FROM (SELECT stream, q, avg(v) AS mean, coalesce(stddev_samp(v), 0.0) AS std, count(*) AS n FROM own GROUP BY stream, q) g JOIN base USING (stream))"""
LAYERS = "lay AS (SELECT i AS layer_id, CASE WHEN i % 6 = 5 THEN 512 ELSE 256 END AS d, CASE WHEN i % 5 = 0 THEN 8 ELSE 2 END AS heads FROM (SELECT unnest(range(24)) AS i))"
TRIALS = """low AS (SELECT *, lower(text || CASE conv_id % 4 WHEN 0 THEN ' Eat a SANDWICH near Dolores' WHEN 1 THEN ' sandwich' ELSE ' Dolores Park!' END) AS t FROM conversations),
tri AS (SELECT (4096 * (1 + turn % 3))::INT AS ctx_len, ([0.1::DOUBLE, 0.5, 0.9])[conv_id % 3 + 1] AS depth, role AS channel,
  ((contains(t, 'sandwich') AND contains(t, 'dolores')) OR contains(t, 'dolores park'))::INT AS n_correct, 1 AS n_trials FROM low)"""
KV = "kv AS (SELECT vec_id, label AS layer_id, vec_id AS token_idx, 'K' AS tensor, embedding AS vec FROM embeddings UNION ALL SELECT vec_id, label, vec_id, 'V', list_reverse(embedding) FROM embeddings)"
LIVE = """live AS (SELECT label AS layer_id, vec_id AS token_idx, embedding AS vec FROM embeddings),
n_live AS (SELECT layer_id, count(*) AS n FROM live GROUP BY layer_id),
n_kept AS (SELECT layer_id, count(*) AS n FROM live WHERE layer_id < 6 AND NOT (layer_id % 3 = 0 AND token_idx >= 400) GROUP BY layer_id),
st AS (SELECT l.layer_id, CASE WHEN k.n IS NULL THEN 'missing' WHEN k.n = l.n THEN 'replaced' ELSE 'mismatch' END AS status FROM n_live l LEFT JOIN n_kept k USING (layer_id))"""
POSITIONS = "ps AS (SELECT (vec_id % 10)::INT AS label, vec_id // 10 AS pos, list_transform(embedding, lambda a: a::DOUBLE) AS value, list_transform(list_reverse(embedding), lambda a: a::DOUBLE) AS score FROM embeddings)"
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nearest(words: str) -> str:
    """words: CTE cw (seg_id, c)."""
    return f"""WITH vec AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE * {VARIED}) AS x FROM embeddings),
un AS (SELECT vec_id, x, greatest(sqrt({dot('x', 'x')}), {EPS}) AS nm FROM vec), {words},
prod AS (SELECT vec_id, x, nm, seg_id, c, list_sum(list_transform(range(1, 65), lambda i: x[i] / nm * c[i])) AS t FROM un, cw),
best AS (SELECT * FROM prod QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(t), 12) DESC, seg_id) = 1)
SELECT vec_id, seg_id::INT AS seg_id, {r('t')} AS t, {r('list_sum(list_transform(range(1, 65), lambda i: (x[i] - t * nm * c[i]) * (x[i] - t * nm * c[i])))')} AS error FROM best"""


def number_list(x: np.ndarray) -> str:
    """Numbers, or rows of numbers, as a list of doubles."""
    return "[" + ", ".join(number_list(row) if np.ndim(row) else f"{float(row)!r}::DOUBLE" for row in x) + "]"


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codewords(x: np.ndarray) -> str:
    return f"cw AS (SELECT unnest(range({len(x)})) AS seg_id, unnest({number_list(x)}) AS c)"


SIGN = "(1 - 2 * (bit_count((i & j)::BIGINT)::INT % 2))"
ROWS48 = f"cw AS (SELECT i AS seg_id, list_transform(range(64), lambda j: {SIGN} / 8.0::DOUBLE) AS c FROM (SELECT unnest(range(48)) AS i))"
ROWS64 = ROWS48.replace("range(48)", "range(64)")
VERTICES = "cw AS (SELECT i AS seg_id, list_transform(range(64), lambda j: CASE WHEN j < 7 AND (i >> least(j, 62)) & 1 = 1 THEN -0.125::DOUBLE ELSE 0.125::DOUBLE END) AS c FROM (SELECT unnest(range(128)) AS i))"
PLANES = "cw AS (SELECT p * 8 + a AS seg_id, list_transform(range(64), lambda j: CASE WHEN j = 2 * p THEN cos(a * pi() / 8) WHEN j = 2 * p + 1 THEN sin(a * pi() / 8) ELSE 0.0::DOUBLE END) AS c FROM (SELECT unnest(range(32)) AS p), (SELECT unnest(range(8)) AS a))"


def three_streams() -> str:
    """Hidden states of eight numbers through the sliding, the overlapping ratio-4 and the ratio-128 stream."""
    rng = np.random.default_rng(0)
    ape4, ape128 = rng.normal(size=(4, 256)) * 0.02, rng.normal(size=(128, 128)) * 0.02
    w = [np.random.default_rng(i).normal(size=(k * 128, 8)) / np.sqrt(8) for i, k in enumerate((1, 2, 2, 1, 1))]
    ctes = ["h AS (SELECT vec_id AS pos, list_transform(embedding[1:8], lambda a: a::DOUBLE) AS h FROM embeddings)"]
    ctes += [f"m AS (SELECT {', '.join(f'{number_list(x)} AS w{i}' for i, x in enumerate(w))}, {number_list(ape4)} AS a4, {number_list(ape128)} AS a128)"]
    times = lambda i: f"list_transform(w{i}, lambda q: list_sum(list_transform(range(1, 9), lambda k: q[k] * h[k])))"
    ctes += [f"s0 AS (SELECT 'sliding' AS stream, pos, pos AS turn, 10000.0::DOUBLE AS theta, {times(0)} AS y FROM h, m)"]
    ctes += [f"p4 AS (SELECT pos // 4 AS b, {times(1)} AS v, {times(2)} AS g, a4[pos % 4 + 1] AS ape FROM h, m)", f"p128 AS (SELECT pos // 128 AS b, {times(3)} AS v, {times(4)} AS g, a128[pos % 128 + 1] AS ape FROM h, m)"]
    ctes += ["c4 AS (SELECT b, i, 1 AS own, v[i + 129] AS v, g[i + 129] + ape[i + 129] AS s FROM p4, (SELECT unnest(range(128)) AS i) UNION ALL SELECT b + 1, i, 0, v[i + 1], g[i + 1] + ape[i + 1] FROM p4, (SELECT unnest(range(128)) AS i))"]
    ctes += ["c128 AS (SELECT b, i, 1 AS own, v[i + 1] AS v, g[i + 1] + ape[i + 1] AS s FROM p128, (SELECT unnest(range(128)) AS i))"]
    for n in (4, 128):
        ctes += [f"d{n} AS (SELECT b, i, sum(v * exp(s)) / sum(exp(s)) AS v FROM c{n} GROUP BY b, i HAVING sum(own) = {n})"]
        ctes += [f"s{n} AS (SELECT 'pool{n}' AS stream, b AS pos, b * {n} AS turn, 160000.0::DOUBLE AS theta, list(v ORDER BY i) AS y FROM d{n} GROUP BY b)"]
    ctes += ["al AS (SELECT * FROM s0 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s128)"]
    ctes += ["nn AS (SELECT stream, pos, turn, theta, list_transform(y, lambda a: a / sqrt(list_sum(list_transform(y, lambda z: z * z)) / 128 + 1e-6::DOUBLE)) AS u FROM al)"]
    ctes += ["sc AS (SELECT *, greatest(list_max(list_transform(u[1:64], lambda a: abs(a))), 1e-4::DOUBLE) / 448.0::DOUBLE AS scale FROM nn)"]
    angle = "turn * pow(theta, -2 * ((i - 64) // 2) / 64.0::DOUBLE)"
    part = "greatest(-448.0::DOUBLE, least(448.0::DOUBLE, u[i + 1] / scale))"
    value = f"CASE WHEN i < 64 THEN {signed(part, e4m3)} * scale WHEN i % 2 = 0 THEN u[i + 1] * cos({angle}) - u[i + 2] * sin({angle}) ELSE u[i] * sin({angle}) + u[i + 1] * cos({angle}) END"
    return f"""WITH {", ".join(ctes)} SELECT stream, pos, i::INT AS "at", {r(f'{value} + 2.3e-9::DOUBLE', 7)} AS value FROM sc, (SELECT unnest(range(128)) AS i)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["codec_bits"] = f"""WITH g AS ({GRID}), gd AS (SELECT *, unnest([64, 128, 256, 512]) AS d FROM g),
b AS (SELECT variant, d::INT AS d, q::INT AS q, (CASE variant WHEN 'd4' THEN {LATTICE['d4']} WHEN 'e8' THEN {LATTICE['e8']} WHEN 'tq' THEN d * q + 32 WHEN 'fp8' THEN 8 * d + d // 64 * 16 ELSE 16 * d END)::BIGINT AS bits, (16 * d)::BIGINT AS raw FROM gd)
SELECT variant, d, q, bits, raw, {r('raw::DOUBLE / bits')} AS ratio, {r('1 - bits::DOUBLE / raw')} AS saved, {r('100 * (1 - bits::DOUBLE / raw)')} AS saving_percent FROM b"""
    out["codebook_bits"] = "SELECT n, (CASE WHEN n <= 1 THEN 1 ELSE ceil(log2(n)) END)::BIGINT AS bits FROM (SELECT unnest(range(1, 4097)) AS n)"
    out["iso_bit_match"] = "SELECT q::INT AS q, max(p)::INT AS q_e8 FROM (SELECT unnest(range(1, 200)) AS q) LEFT JOIN (SELECT unnest(range(1, 500)) AS p) ON ceil(8 * log2(2 * p + 1)) <= 2 * ceil(4 * log2(2 * q + 1) - 1) GROUP BY q"
    out["narrow_floats"] = f"SELECT event_id, {r(signed('value', fp16))} AS fp16, {r(signed('value', bf16))} AS bf16, {r(signed('value', e4m3))} AS e4m3, {r(signed('(-value / 1e6::DOUBLE)', fp16), 12)} AS small, pow(2.0::DOUBLE, event_id % 20 + 117 - 127) AS e8m0 FROM events"
    out["hadamard_rotate"] = f"WITH {VECTORS}, rot AS (SELECT vec_id, {rotate('x')} AS y FROM vec) {coordinates('rot', 'vec_id', 'y')}"
    out["hadamard_plain"] = f"WITH {VECTORS} SELECT vec_id, {r('list_sum(x)')} AS first, 0.0::DOUBLE AS off FROM vec"
    for q in (4, 10, 38, 152):
        for v, f in (("d4", 1), ("e8", 2)):
            out[f"{v}_encode_q{q}"] = f"WITH {encoded(v, q)} SELECT vec_id, array_to_string(list_transform(z, lambda a: (a * {f})::INT), ',') AS z, norm16, tops[1] AS top16 FROM enc"
    out["d4_encode_varied_norms"] = f"WITH {encoded('d4', 38, VARIED)} SELECT vec_id, array_to_string(list_transform(z, lambda a: a::INT), ',') AS z, norm16, tops[1] AS top16 FROM enc"
    out["tq_encode_b4"] = f"WITH {encoded('zn', 7)} SELECT vec_id, array_to_string(list_transform(z, lambda a: a::INT), ',') AS z, norm16, tops[1] AS top16 FROM enc"
    for name, args in {"d4_roundtrip": ("d4", 38), "e8_roundtrip": ("e8", 37), "tq_roundtrip_b6": ("zn", 31)}.items():
        out[name] = f"WITH {decoded(*args, VARIED)} {coordinates('dec', 'vec_id', 'y')}"
    for name, args in {"no_unit_norm": {"unit": False}, "no_hadamard": {"turn": False}, "per_block_qmax": {"per": "block"}, "scalar_quantise": {"variant": "zn"}, "global_qmax": {"per": "global"}}.items():
        out[f"ablation_{name}"] = f"WITH {decoded(**({'variant': 'd4', 'q': 38, 'factor': VARIED} | args))} {coordinates('dec', 'vec_id', 'y')}"
    out["bf16_roundtrip"] = f"WITH vec AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE * {VARIED}) AS x FROM embeddings), f AS (SELECT vec_id, list_transform(x, lambda a: {signed('a', bf16)}) AS y FROM vec) {coordinates('f', 'vec_id', 'y')}"
    out["fp8_e4m3_roundtrip"] = f"WITH {fp8_block('e4m3')} {coordinates('fp8', 'vec_id', 'y')}"
    out["fp8_uniform_roundtrip"] = f"WITH {fp8_block('uniform127')} {coordinates('fp8', 'vec_id', 'y')}"
    parts = []
    for name, args in {"v14_full": {}, "no_unit_norm": {"unit": False}, "no_hadamard": {"turn": False}, "global_qmax": {"per": "global"}, "per_block_qmax": {"per": "block"}, "scalar_quantise": {"variant": "zn"}}.items():
        parts.append(f"SELECT '{name}' AS variant, m FROM (WITH {decoded(**({'variant': 'd4', 'q': 38, 'factor': VARIED} | args))} SELECT avg({error()}) / greatest(avg({dot('x', 'x')}), 1e-12) AS m FROM dec)")
    out["ablation_table"] = f"WITH m AS ({' UNION ALL '.join(parts)}) SELECT variant, 432::BIGINT AS bits, {r('m', 8)} AS rel_mse, {r('m / (SELECT b.m FROM m b WHERE b.variant = $$v14_full$$)', 4)} AS to_full FROM m"
    out["dispatch_by_length"] = f"""SELECT vec_id, 64 AS dims, {r(error(), 9)} AS error FROM (WITH {decoded('d4', 38, where='WHERE vec_id % 2 = 0')} SELECT * FROM dec)
UNION ALL SELECT vec_id, 32 AS dims, {r(error(dims=32), 9)} AS error FROM (WITH {decoded('e8', 10, dims=32, where='WHERE vec_id % 2 = 1')} SELECT * FROM dec)"""
    bf = f"list_transform(x, lambda a: {signed('a', bf16)})"
    out["kv_masked_roundtrip"] = f"""WITH {decoded('d4', 38)}, rv AS (SELECT vec_id, list_reverse(embedding) AS embedding, label FROM embeddings),
k AS (SELECT x, y FROM dec), kb AS (SELECT x, {bf} AS y FROM dec),
v AS (SELECT x, y FROM ({f"WITH {decoded('d4', 38)} SELECT x, y FROM dec".replace('FROM embeddings', 'FROM rv')})), vb AS (SELECT list_reverse(x) AS x, list_reverse(y) AS y FROM kb),
al AS (SELECT 'K' AS mode, 'K' AS tensor, x, y FROM k UNION ALL SELECT 'K', 'V', x, y FROM vb UNION ALL SELECT 'V', 'K', x, y FROM kb UNION ALL SELECT 'V', 'V', x, y FROM v UNION ALL SELECT 'KV', 'K', x, y FROM k UNION ALL SELECT 'KV', 'V', x, y FROM v)
SELECT mode, tensor, {r(f"avg({error()}) / greatest(avg({dot('x', 'x')}), 1e-12)", 8)} AS rel_mse FROM al GROUP BY mode, tensor"""
    mse = f"avg({error()}) / greatest(avg({dot('x', 'x')}), 1e-12)"
    out["rel_mse_by_label"] = f"WITH {decoded('d4', 38, VARIED)} SELECT label, 432::BIGINT AS bits, {r(mse, 9)} AS rel_mse FROM dec GROUP BY label"
    out["rel_mse_centred"] = f"""WITH {decoded('e8', 10, VARIED)}, e AS (SELECT label, i, x[i + 1] AS a, y[i + 1] AS b FROM dec, (SELECT unnest(range(64)) AS i)),
c AS (SELECT label, i, sum((a - b) * (a - b)) AS num, var_pop(a) * count(*) AS den FROM e GROUP BY label, i) SELECT label, {r('sum(num) / greatest(sum(den), 1e-12)', 9)} AS rel_mse FROM c GROUP BY label"""
    cos = f"{dot('x', 'y')} / (greatest(sqrt({dot('x', 'x')}), 1e-12) * greatest(sqrt({dot('y', 'y')}), 1e-12))"
    out["cosine_stats"] = f"WITH {decoded('d4', 4, VARIED)}, c AS (SELECT label, {cos} AS c FROM dec) SELECT label, {r('avg(c)', 8)} AS cos_mean, {r('min(c)', 8)} AS cos_min, {r('avg(c)', 8)} AS product_mean FROM c GROUP BY label"
    out["shaping_gain"] = f"""WITH a AS (SELECT label, avg({error()}) AS e FROM (WITH {decoded('d4', 10, VARIED)} SELECT * FROM dec) GROUP BY label),
b AS (SELECT label, avg({error()}) AS e FROM (WITH {decoded('e8', 10, VARIED)} SELECT * FROM dec) GROUP BY label)
SELECT label, {r('10 * log10(greatest(a.e, 1e-12) / greatest(b.e, 1e-12))')} AS gain_db FROM a JOIN b USING (label)"""
    out["layer_weighted_mse"] = f"WITH {decoded('d4', 10, VARIED)}, p AS (SELECT label, sum({error()}) AS num, sum({dot('x', 'x')}) AS den FROM dec GROUP BY label) SELECT {r('sum((label + 1) * num) / sum((label + 1) * den)', 9)} AS rel_mse FROM p"
    out["layer_mean_cosine"] = f"WITH {decoded('d4', 10, VARIED)}, p AS (SELECT label % 2 AS side, label, avg({cos}) AS c FROM dec GROUP BY label) SELECT side, {r('avg(c)', 8)} AS cos FROM p GROUP BY side"
    out["codec_differences"] = f"WITH {VECTORS}, e AS (SELECT unnest(list_transform(x, lambda a: abs(a - {signed('a', bf16)}))) AS d FROM vec) SELECT sum((d <> 0)::INT)::BIGINT AS differing, {r('max(d)', 9)} AS largest, {r('avg(d)', 9)} AS mean FROM e"

    def audit(factor: str, by: str, short: bool) -> str:
        base = f"""WITH vec AS (SELECT vec_id, label, list_transform(embedding, lambda a: a::DOUBLE * {factor}) AS x FROM embeddings), rot AS (SELECT *, {rotate('x')} AS y FROM vec),
e AS (SELECT {by} AS g, i, x[i + 1] AS x, y[i + 1] AS y FROM rot, (SELECT unnest(range(64)) AS i)),
f AS (SELECT g, i, kurtosis_pop(x) AS k, var_pop(x) AS v, var_pop(y) AS w, avg(x) AS mu, count(*) AS n FROM e GROUP BY g, i)"""
        two = f"{r('avg(abs(k))')} AS excess_kurtosis_abs, {r('greatest(max(v), 1e-12) / greatest(min(v), 1e-12)')} AS isotropy_variance_ratio"
        if short:
            return f"{base} SELECT {two} FROM f"
        return f"""{base}, t AS (SELECT g, i, quantile_cont(abs((e.x - mu) / greatest(sqrt(v), 1e-6))::DOUBLE, 0.99) / 2.326 - 1 AS tail FROM e JOIN f USING (g, i) GROUP BY g, i)
SELECT g AS label, {two}, {r('greatest(max(w), 1e-12) / greatest(min(w), 1e-12)')} AS hadamard_post_variance_ratio, {r('sqrt(avg(tail * tail))')} AS rms_wasserstein2_over_sigma_per_dim, max(n) AS num_vectors, count(*) AS dims FROM f JOIN t USING (g, i) GROUP BY g"""

    out["nongaussian_audit"] = audit(VARIED, "label", False)
    out["short_audit"] = audit(PLAIN, "0", True)
    lp = lambda s: ", ".join(f"-abs(value - {30 * k} + {s}::DOUBLE * (event_id % 3)) / 50 - 0.1::DOUBLE * {k}" for k in range(3))
    out["perplexity_top1"] = f"""WITH l AS (SELECT user_id % 8 AS passage, event_id % 3 + 1 AS gold, CASE WHEN event_id % 11 <> 0 THEN [{lp(0.0)}] END AS ref, CASE WHEN event_id % 11 <> 0 THEN [{lp(7.0)}] END AS alt FROM events),
m AS (SELECT passage, coalesce(ref[gold], 0.0) AS lr, coalesce(alt[gold], 0.0) AS la, coalesce(list_position(ref, list_max(ref)) = list_position(alt, list_max(alt)), false)::INT AS same FROM l),
p AS (SELECT passage, exp(-avg(lr)) AS pr, exp(-avg(la)) AS pa, avg(same) AS s FROM m GROUP BY passage)
SELECT passage::INT AS passage, {r('pr', 8)} AS ppl_ref, {r('pa', 8)} AS ppl_alt, {r('s', 8)} AS top1_pair, {r('(pa - pr) / greatest(pr, 1e-9)', 8)} AS delta_ppl, {r('abs((pa - pr) / greatest(pr, 1e-9))', 8)} AS abs_delta, {r('exp(least(20.0, ln(pa)))', 8)} AS clipped FROM p"""
    out["sweep_ci95"] = f"WITH {RECORDS}, u AS (SELECT channel, 'a' AS metric, a AS v FROM good UNION ALL SELECT channel, 'b', b FROM good) {mean_ci('u', 'channel, metric')}"
    out["small_sample_ci95"] = f"""WITH u AS (SELECT floor(sqrt(event_id::DOUBLE))::BIGINT AS g, value AS v FROM events), a AS ({mean_ci('u', 'g', True)}), b AS ({mean_ci('u', 'g')})
SELECT g, a.mean, a.ci95, b.ci95 AS below, a.n FROM a JOIN b USING (g)"""
    out["channel_means"] = f"WITH {RECORDS} SELECT channel, {r('avg(a)')} AS a, {r('avg(b)')} AS b, any_value(codec) AS codec, any_value(param) AS param FROM good GROUP BY channel"
    out["head_to_head"] = f"""WITH {RECORDS}, m AS (SELECT codec, param, avg(a) AS a FROM good GROUP BY codec, param)
SELECT b, q, {r('t.a')} AS scalar, {r('d.a')} AS d4, {r('d.a / t.a')} AS ratio FROM (VALUES (4, 10), (6, 38), (8, 152)) p(b, q) JOIN m t ON t.codec = 'tq' AND t.param = b JOIN m d ON d.codec = 'd4' AND d.param = q"""
    out["latency_percentiles"] = f"""WITH {LATENCIES}, s AS (SELECT codec, param, avg(us) AS mean, stddev_samp(us) AS sd, list(us ORDER BY us) AS l, count(*) AS n FROM lat GROUP BY codec, param)
SELECT codec, param, {r('mean')} AS mean, {r('sd')} AS stdev, {r('l[1]')} AS min, {r('l[n // 2 + 1]')} AS p50, {r('l[least(n - 1, floor(0.99::DOUBLE * n)::BIGINT) + 1]')} AS p99, {r('l[n]')} AS max, {r('mean / 16384')} AS per_vector, {r('16384.0::DOUBLE / mean')} AS million_per_sec FROM s"""
    out["matched_q_latency"] = f"WITH {LATENCIES}, m AS (SELECT codec, param, avg(us) AS us FROM lat GROUP BY codec, param) SELECT param, {r('e.us')} AS e8, {r('d.us')} AS d4, {r('e.us / d.us')} AS ratio FROM m e JOIN m d USING (param) WHERE e.codec = 'e8' AND d.codec = 'd4'"
    out["overhead_over_baseline"] = f"WITH {LATENCIES}, m AS (SELECT codec, avg(us) AS us FROM lat GROUP BY codec) SELECT codec, {r('us')} AS us, {r('us / (SELECT us FROM m WHERE codec = $$bf16$$)')} AS overhead FROM m"
    out["slowdown_summary"] = f"WITH {LATENCIES}, m AS (SELECT codec AS variant, avg(us / 10) AS ppl, avg(us / 100 + param) AS s FROM lat GROUP BY codec) SELECT variant, {r('ppl')} AS ppl, {r('s')} AS decode_s, {r('s / (SELECT s FROM m WHERE variant = $$bf16$$)')} AS slowdown FROM m"
    out["max_compression_threshold"] = f"""WITH {Q_SWEEP}, vw AS (SELECT stream, q, mean, baseline, 'point' AS view, mean AS v FROM sw UNION ALL SELECT stream, q, mean, baseline, 'ci', mean + ci95 FROM sw),
th AS (SELECT * FROM (VALUES (0.001::DOUBLE), (1.0::DOUBLE), (1.05::DOUBLE), (1.2::DOUBLE)) t(multiplier)),
al AS (SELECT stream, view, multiplier, min(q) FILTER (v <= multiplier * baseline) AS q, arg_min(mean, q) FILTER (v <= multiplier * baseline) AS m FROM vw, th GROUP BY stream, view, multiplier) SELECT stream, view, multiplier, q, {r('m')} AS mean FROM al"""
    out["admissibility_marks"] = f"WITH {Q_SWEEP} SELECT stream, q, {r('mean / baseline')} AS ratio, CASE WHEN mean / baseline <= 1.0::DOUBLE THEN 'A' WHEN mean / baseline <= 1.05::DOUBLE THEN 'B' WHEN mean / baseline <= 1.2::DOUBLE THEN 'C' ELSE '-' END AS mark FROM sw"
    out["iso_quality_winner"] = f"""WITH {RECORDS}, m AS (SELECT codec AS family, channel, avg(a) AS change, 1000.0::DOUBLE / any_value(param) AS ratio FROM good GROUP BY codec, channel)
SELECT family, t::DOUBLE AS threshold, arg_max(channel, ratio) AS channel, {r('max(ratio)')} AS ratio FROM m, (SELECT unnest(range(1, 200, 7)) AS t) WHERE change <= t GROUP BY family, t"""
    out["ratio_to_fp8"] = f"""WITH a AS (SELECT label, {mse} AS m FROM (WITH {decoded('e8', 38, VARIED)} SELECT * FROM dec) GROUP BY label), b AS (SELECT label, {mse} AS m FROM (WITH {fp8_block('e4m3')} SELECT * FROM fp8) GROUP BY label)
SELECT label, {r('a.m / b.m')} AS ratio FROM a JOIN b USING (label)"""
    out["stream_metric_aggregate"] = f"WITH u AS (SELECT event_type AS stream, 'rel_mse' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'cos_sim', 1 / (1 + abs(value)) FROM events) {mean_ci('u', 'stream, metric', True)}"
    out["head_size_majority"] = "WITH h AS (SELECT CASE WHEN p_size % 5 = 0 THEN 256 WHEN p_size % 3 = 0 THEN 512 ELSE 128 END AS head_dim FROM part) SELECT head_dim, count(*) AS n FROM h GROUP BY head_dim ORDER BY n DESC, head_dim LIMIT 1"
    stores = []
    for v, q in (("d4", 10), ("d4", 38), ("e8", 10), ("e8", 38)):
        bits = LATTICE[v].replace("q", str(q))
        stores.append(f"SELECT '{v}' AS variant, {q} AS q, sum(d * 16 // 8 * 2 * heads * 131072::BIGINT)::BIGINT AS baseline_bytes, sum(CASE WHEN layer_id >= 2 AND layer_id < 22 THEN ({bits})::BIGINT // 8 * 2 ELSE d * 16 // 8 * 2 END * heads * 131072::BIGINT)::BIGINT AS coded_bytes FROM lay")
    out["storage_128k"] = f"""WITH {LAYERS}, s AS ({' UNION ALL '.join(stores)}) SELECT variant, q, baseline_bytes, coded_bytes, {r('baseline_bytes::DOUBLE / coded_bytes')} AS ratio,
CASE WHEN coded_bytes >= 1073741824 THEN printf('%.2f GiB', coded_bytes / 1073741824.0::DOUBLE) ELSE printf('%.0f MiB', coded_bytes / 1048576.0::DOUBLE) END AS label FROM s"""
    out["deployment_bits"] = f"WITH {LAYERS} SELECT {r('sum((' + LATTICE['e8'].replace('q', '38') + ') * heads) / sum(heads)')} AS bits FROM lay"
    out["niah_score"] = f"WITH {TRIALS} SELECT ctx_len, depth, channel, sum(n_correct)::BIGINT AS n_correct, sum(n_trials)::BIGINT AS n_trials FROM tri GROUP BY ALL"
    out["niah_rollup"] = f"WITH {TRIALS} SELECT channel, ctx_len, depth, sum(n_correct)::BIGINT AS n_correct, sum(n_trials)::BIGINT AS n_trials FROM tri GROUP BY ROLLUP (channel, ctx_len, depth)"
    out["niah_by_channel"] = f"WITH {TRIALS} SELECT channel, sum(n_correct)::BIGINT AS n_correct, sum(n_trials)::BIGINT AS n_trials, {r('sum(n_correct)::DOUBLE / sum(n_trials)')} AS accuracy FROM tri GROUP BY channel"
    cell = lambda d: r(f"sum(n_correct) FILTER (depth = {d}::DOUBLE)::DOUBLE / sum(n_trials) FILTER (depth = {d}::DOUBLE)")
    out["niah_heat_map"] = f"WITH {TRIALS} SELECT ctx_len, channel, {cell(0.1)} AS d0_1, {cell(0.5)} AS d0_5, {cell(0.9)} AS d0_9 FROM tri GROUP BY ctx_len, channel"
    out["nearest_hadamard_rows"], out["nearest_hadamard_vertices"], out["nearest_planes"] = nearest(ROWS48), nearest(VERTICES), nearest(PLANES)
    out["nearest_random"] = nearest(codewords(unit_rows(np.random.default_rng(0xC0DE).normal(size=(256, 64)))))
    turn = np.linalg.qr(np.random.default_rng(0xDADA).normal(size=(64, 64)))[0]
    arcs = [np.cos(a * np.pi / 4) * turn[:, 2 * p] + np.sin(a * np.pi / 4) * turn[:, 2 * p + 1] for p in range(32) for a in range(4)]
    axes = [np.cos(a * np.pi / 8) * np.eye(64)[2 * p] + np.sin(a * np.pi / 8) * np.eye(64)[2 * p + 1] for p in range(32) for a in range(8)]
    out["nearest_planes_scales"] = nearest(codewords(unit_rows(np.array(axes + arcs))))
    out["codebook_head_to_head"] = f"""WITH near AS ({nearest(ROWS64)}), {ROWS64}, vec AS (SELECT vec_id, label, list_transform(embedding, lambda a: a::DOUBLE * {VARIED}) AS x FROM embeddings),
j AS (SELECT label, x, c, {dot('x', 'x')} AS n2, {dot('x', 'c')} AS t FROM vec JOIN near USING (vec_id) JOIN cw USING (seg_id)),
k AS (SELECT label, n2, list_sum(list_transform(range(1, 65), lambda i: (x[i] - t * c[i]) * (x[i] - t * c[i]))) AS e, abs(t) / sqrt(n2) AS cos FROM j)
SELECT label, {r('avg(e)')} AS mse, {r('avg(e) / greatest(avg(n2), 1e-12)')} AS rel_mse, {r('avg(cos)')} AS cos_mean, {r('min(cos)')} AS cos_min, count(*) AS n FROM k GROUP BY label"""
    w = WORDS.format("text")
    out["passage_assembly"] = f"""WITH RECURSIVE d AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, text, len({w}) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
f AS (SELECT lang, 0::BIGINT AS i, ''::VARCHAR AS whole, 0::BIGINT AS rows, 0::BIGINT AS words, 0::BIGINT AS est, false AS done FROM (SELECT DISTINCT lang FROM d)
UNION ALL SELECT d.lang, d.i, CASE WHEN f.done THEN d.text ELSE f.whole || d.text END, CASE WHEN f.done THEN 1 ELSE f.rows + 1 END, 0, CASE WHEN f.done THEN 0 ELSE f.est END + floor(d.n * 1.3::DOUBLE)::BIGINT,
  CASE WHEN f.done THEN 0 ELSE f.est END + floor(d.n * 1.3::DOUBLE)::BIGINT >= 400 FROM f JOIN d ON d.lang = f.lang AND d.i = f.i + 1),
g AS (SELECT lang, i, rows, len({WORDS.format("whole")}) AS words, md5(whole) AS md5 FROM f WHERE done)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY i) - 1)::INT AS passage, rows::INT AS rows, words::INT AS words, md5 FROM g WHERE words >= 400"""
    out["haystack_rows"] = f"""WITH d AS (SELECT lang, doc_id, floor(len({w}) * 1.3::DOUBLE)::BIGINT AS e FROM documents WHERE trim(text) <> '' AND len({w}) > 0),
b AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT lang, count(*) AS rows, sum(e)::BIGINT AS estimate FROM b WHERE before < 10192 GROUP BY lang"""
    needle, question = WORDS.format(lit(NEEDLE)), WORDS.format(lit(QUESTION))
    out["needle_prompt"] = f"""WITH d AS (SELECT doc_id, {w} AS ids, {needle} AS nd, {question} AS qs FROM documents), c AS (SELECT *, ids[1 : 300 - len(nd)] AS h FROM d),
a AS (SELECT *, floor(len(h) * ([0.1::DOUBLE, 0.5, 0.9])[doc_id % 3 + 1])::BIGINT AS pt FROM c), p AS (SELECT doc_id, list_concat(list_concat(CASE WHEN pt = 0 THEN [] ELSE h[1 : pt] END, nd), h[pt + 1 :]) AS b, qs FROM a)
SELECT doc_id, len(b)::INT AS question_at, (len(b) + len(qs))::INT AS n, md5(array_to_string(list_concat(b, qs), ' ')) AS md5 FROM p"""
    out["cut_token_ids"] = f"WITH d AS (SELECT doc_id, {w} AS ids, text FROM documents) SELECT doc_id, 192 AS n, md5(array_to_string(ids[1:192], ' ')) AS md5, length(left(text, 128))::INT AS head_chars FROM d WHERE len(ids) >= 192"
    out["layer_id_parse"] = "SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN p_partkey ELSE 0 END)::INT AS layer_id, (CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 10000 ELSE 0 END)::INT AS module_layer_id FROM part"
    out["name_parsing"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'e8' ELSE 'd4' END AS variant, p_size AS q, (p_size + p_partkey)::INT AS total, CASE WHEN p_partkey % 2 = 0 THEN 'e8_q' ELSE 'd4_q' END || p_size AS channel FROM part"
    sq = "list_sum(list_transform(v, lambda a: a * a))"
    rev = f"WITH {decoded('d4', 38)} SELECT vec_id, label, y FROM dec".replace("FROM embeddings", "FROM rv")
    out["boundary_skip"] = f"""WITH {decoded('d4', 38)}, rv AS (SELECT vec_id, list_reverse(embedding) AS embedding, label FROM embeddings), b AS (SELECT * FROM ({rev})),
al AS (SELECT label, 'K' AS tensor, x, y FROM dec UNION ALL SELECT b.label, 'V', list_reverse(d.x), b.y FROM b JOIN dec d USING (vec_id)),
s AS (SELECT label AS layer_id, tensor, label >= 2 AND label < 8 AS fired, list_transform(CASE WHEN label >= 2 AND label < 8 THEN y ELSE x END, lambda a: a::FLOAT::DOUBLE) AS v FROM al)
SELECT layer_id, tensor, fired, count(*) AS n, {r(f'sum({sq})', 4)} AS norm2 FROM s GROUP BY ALL"""
    out["fire_counts"] = f"""WITH {KV}, c AS (SELECT layer_id, sum((layer_id >= 2 AND layer_id < 8)::INT)::BIGINT AS fires, sum((layer_id < 2 OR layer_id >= 8)::INT)::BIGINT AS skips, count(DISTINCT token_idx) AS length FROM kv GROUP BY layer_id)
SELECT layer_id, fires, skips, CASE WHEN fires < 60 THEN 'fired ' || fires || ' of 60' END AS fatal, length FROM c"""
    out["boundary_kinds"] = "SELECT i::INT AS layer_id, i < 2 OR i >= 5 AS plain2, i < 4 OR i >= 3 AS plain4, i < 2 OR i >= 5 AS capped2, i < 3 OR i >= 4 AS capped4 FROM (SELECT unnest(range(7)) AS i)"
    out["replace_join"] = f"WITH {LIVE} SELECT layer_id, status, count(*) AS n, {r('sum(CASE WHEN status = $$replaced$$ THEN 1.5 ELSE vec[1]::DOUBLE END)', 4)} AS first FROM live JOIN st USING (layer_id) GROUP BY layer_id, status"
    out["replace_status"] = f"WITH {LIVE} SELECT status, count(DISTINCT layer_id) AS layers, count(*) AS n_rows FROM live JOIN st USING (layer_id) GROUP BY status"
    out["inforward_coded"] = f"""WITH {decoded('d4', 10)}, rv AS (SELECT vec_id, list_reverse(embedding) AS embedding, label FROM embeddings), b AS (SELECT * FROM ({rev.replace("38", "10")})),
al AS (SELECT label, x, y FROM dec UNION ALL SELECT b.label, list_reverse(d.x), b.y FROM b JOIN dec d USING (vec_id)),
s AS (SELECT label AS layer_id, label NOT IN (0, 9) AS fired, CASE WHEN label NOT IN (0, 9) THEN y ELSE x END AS v FROM al) SELECT layer_id, fired, count(*) AS n, {r(f'sum({sq})', 4)} AS norm2 FROM s GROUP BY ALL"""
    out["effective_boundary"] = "SELECT i::INT AS layer_id FROM (SELECT unnest(range(10)) AS i) WHERE i < 2 OR i >= 8 OR i NOT IN (SELECT label FROM embeddings WHERE label <> 4)"
    out["unshared_layers"] = f"WITH {KV} SELECT layer_id, count(*) AS n FROM kv WHERE layer_id < 7 GROUP BY layer_id"
    out["pool_ratio16"] = f"""WITH {POSITIONS}, e AS (SELECT label, pos // 16 AS block, i AS c, value[i + 1] AS v, score[i + 1] AS s FROM ps, (SELECT unnest(range(64)) AS i))
SELECT label, block, c::INT AS "at", {r('sum(v * exp(s)) / sum(exp(s)) + 2.3e-9::DOUBLE', 7)} AS value FROM e GROUP BY label, block, c HAVING count(*) = 16"""
    out["pool_ratio4_overlapping"] = f"""WITH {POSITIONS}, h AS (SELECT label, pos // 4 AS block, value[33:64] AS v, score[33:64] AS s, 1 AS own FROM ps UNION ALL SELECT label, pos // 4 + 1, value[1:32], score[1:32], 0 FROM ps),
e AS (SELECT label, block, own, i AS c, v[i + 1] AS v, s[i + 1] AS s FROM h, (SELECT unnest(range(32)) AS i)) SELECT label, block, c::INT AS "at", {r('sum(v * exp(s)) / sum(exp(s)) + 2.3e-9::DOUBLE', 7)} AS value FROM e GROUP BY label, block, c HAVING sum(own) = 4"""
    out["position_embedding"] = f"WITH {POSITIONS} SELECT label, pos::INT AS pos, {r('score[1]')} AS first, {r('score[64] + (63 * (pos % 4 + 1)) / 100.0::DOUBLE')} AS last FROM ps"
    angle = "(pos * 4) * pow(10000.0::DOUBLE, -2 * ((i - 48) // 2) / 16.0::DOUBLE)"
    out["rmsnorm_rope"] = f"""WITH {POSITIONS}, nn AS (SELECT label, pos::INT AS pos, list_transform(value, lambda a: a / sqrt({dot('value', 'value')} / 64 + 1e-6::DOUBLE)) AS u FROM ps)
SELECT label, pos, i::INT AS "at", {r(f'CASE WHEN i < 48 THEN u[i + 1] WHEN i % 2 = 0 THEN u[i + 1] * cos({angle}) - u[i + 2] * sin({angle}) ELSE u[i] * sin({angle}) + u[i + 1] * cos({angle}) END + 2.3e-9::DOUBLE', 7)} AS value FROM nn, (SELECT unnest(range(64)) AS i)"""
    pair = lambda t: f"64 * ln(65536 / ({t} * 2 * pi())) / (2 * ln(160000.0::DOUBLE))"
    out["rope_stretched"] = f"""WITH b AS (SELECT greatest(floor({pair(32)}), 0) AS lo, least(ceil({pair(1)}), 63) AS hi), f AS (SELECT i, pow(160000.0::DOUBLE, -2 * i / 64.0::DOUBLE) AS f, 1 - least(greatest((i - lo) / (hi - lo), 0), 1) AS k FROM b, (SELECT unnest(range(32)) AS i))
SELECT i::INT AS i, {r('f / 16 * (1 - k) + f * k', 12)} AS f FROM f"""
    out["tile_dequantisation"] = "SELECT 'w1' AS name, i, j, w * pow(2.0::DOUBLE, ((i // 128) * 2 + j // 128 + 123) - 127) AS w FROM (SELECT l_orderkey % 512 AS i, l_partkey % 256 AS j, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
    out["weight_scale_pairs"] = """WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'layers.' ELSE 'head.' END || (p_partkey // 2) AS base, p_partkey % 2 = 0 AS is_w FROM part)
SELECT w.base, w.base || '.weight' AS weight, CASE WHEN s.base IS NOT NULL THEN s.base || '.scale' END AS scale FROM n w LEFT JOIN n s ON s.base = w.base AND NOT s.is_w WHERE w.is_w"""
    sweeps = " UNION ALL ".join(f"SELECT '{v}' AS variant, {q} AS q, x, y FROM (WITH {decoded(v, q)} SELECT x, y FROM dec)" for v in ("d4", "e8") for q in (4, 10, 38))
    out["arrow_sweep"] = f"WITH s AS ({sweeps}) SELECT variant, q, {r(f'sum({error()}) / greatest(sum({dot(chr(120), chr(120))}), 1e-12)', 9)} AS rel_mse, {r(f'avg({cos})', 9)} AS cos_mean, count(*) AS n FROM s GROUP BY variant, q"
    out["vector_digests"] = "SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda a: printf('%.4f', a::DOUBLE)), ',')) AS sha256 FROM embeddings"
    out["decode_speed"] = f"SELECT p_partkey, {r('p_retailprice / 1000 * 1e9 / (p_size * 1024 * 8)', 4)} AS ms_per_million FROM part"
    out["phase_off"] = f"WITH {KV} SELECT layer_id, false AS fired, count(*) AS n, {r('sum(list_sum(list_transform(vec, lambda a: a::DOUBLE * a::DOUBLE)))', 4)} AS norm2 FROM kv GROUP BY layer_id"
    out["head_size_problems"] = """SELECT d::INT AS d, variant, concat_ws('; ', CASE WHEN d NOT IN (1, 2, 4, 8, 16, 32, 64, 128, 256) THEN 'head size ' || d || ' is no power of two' END,
  CASE WHEN d % size <> 0 THEN 'head size ' || d || ' is no multiple of ' || size END) AS problems FROM (SELECT unnest(range(1, 301)) AS d), (VALUES ('d4', 4), ('e8', 8)) v(variant, size)"""
    out["layer_codec_plan"] = "SELECT i::INT AS layer_id, i >= 2 AND i < 10 AS coded, CASE WHEN i >= 2 AND i < 10 THEN 16 * ceil(8 * log2(77)) + 32 ELSE 2048 END::BIGINT AS bits FROM (SELECT unnest(range(12)) AS i)"
    out["projected"] = f"""WITH w AS (SELECT {number_list(np.random.default_rng(3).normal(size=(4, 8)) / np.sqrt(8))} AS w), e AS (SELECT vec_id, list_transform(embedding[1:8], lambda a: a::DOUBLE) AS h FROM embeddings)
SELECT vec_id, i::INT AS "at", {r('list_sum(list_transform(range(1, 9), lambda k: w[i + 1][k] * h[k])) + 2.3e-9::DOUBLE', 7)} AS value FROM e, w, (SELECT unnest(range(4)) AS i)"""
    out["three_streams"] = three_streams()
    per = lambda source, n: f"SELECT label, {mse} AS {n}_m, avg({cos}) AS {n}_k FROM ({source}) GROUP BY label"
    own = " JOIN ".join(f"({per(q, n)}) {n}_t USING (label)" for n, q in (("d4", f"WITH {decoded('d4', 38, VARIED)} SELECT * FROM dec"), ("e8", f"WITH {decoded('e8', 38, VARIED)} SELECT * FROM dec"), ("fp8", f"WITH {fp8_block('e4m3')} SELECT * FROM fp8")))
    bits = {"d4": "16 * ceil(4 * log2(77) - 1) + 32", "e8": "8 * ceil(8 * log2(77)) + 32", "fp8": "8 * 64 + 16"}
    flat = ", ".join(f"({bits[n]})::INT AS {n}_bits, {r(f'{n}_m', 8)} AS {n}_rel_mse, {r(f'{n}_k', 8)} AS {n}_cos" for n in bits)
    out["stream_records"] = f"SELECT a.label, a.num_vectors, a.excess_kurtosis_abs, a.isotropy_variance_ratio, {flat} FROM ({audit(VARIED, 'label', False)}) a JOIN {own}"
    out["capture_stream"] = "SELECT label AS layer_id, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label"
    out["built_in_passages"] = "SELECT i::INT AS passage_id, topic, (8 * length(t))::INT AS chars, md5(repeat(t, 8)) AS md5 FROM (VALUES (0, 'tide', 'The tide turns twice a day. '), (1, 'bread', 'Flour, water, salt and time. '), (2, 'maps', 'A map leaves most things out. ')) p(i, topic, t)"
    out["golden_entries"] = "SELECT * FROM (VALUES ('d4_q38', '0a1b', 432::INT), ('e8_q38', '2c3d', 440::INT)) g(key, sha256, bits)"
    out["device_trace"] = "SELECT * FROM (VALUES ('10:00:00', 45.3::DOUBLE, 12.0::DOUBLE), ('10:00:01', 151.0, 2048.0), ('10:00:02', NULL, 2049.0)) t(timestamp, power_draw, memory_used)"
    out["report_records"] = f"WITH {TRIALS} SELECT ctx_len, depth, channel, sum(n_correct)::INT AS n_correct, sum(n_trials)::INT AS n_trials, {r('sum(n_correct)::DOUBLE / sum(n_trials)')} AS accuracy FROM tri GROUP BY ALL"
    out["gaussian_moments"] = "SELECT 262144::BIGINT AS n, true AS mean, true AS std, true AS skew, true AS kurt"
    out["head_gain"] = f"WITH g AS (SELECT vec_id, list_transform(embedding, lambda a: (a::DOUBLE * (0.5::DOUBLE + label * (1.5::DOUBLE / 9)))::FLOAT::DOUBLE) AS y FROM embeddings) {coordinates('g', 'vec_id', 'y')}"
    out["stream_roundtrip"] = "SELECT label AS layer_id, label >= 2 AND label < 8 AS fired, count(*) AS n FROM embeddings GROUP BY label"
    return out
