"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..operators.codec import LEVELS
from .queries import BOUNDARIES, CODEC, NEIGHBOURS, WIDE


def _distance(a: str, b: str, n: str) -> str:
    return f"sqrt(list_reduce(list_transform(range(1, {n} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])), lambda s, v: s + v))"


POINTS = "p as (select vec_id as id, embedding::double[] as x, label from embeddings)"


def _edges(k: int = NEIGHBOURS, left: str = "true", right: str = "true") -> str:
    return f"""{POINTS}, pairs as (select a.id as src, b.id as dst, {_distance("a.x", "b.x", "len(a.x)")} as dist from p a join p b on a.id <> b.id where {left} and {right}),
e as (select src, dst, cast(row_number() over (partition by src order by dist, dst) as int) as rank, dist from pairs qualify rank <= {k})"""


def _sigma(rho: str) -> str:
    """sigma(id, rho, sigma) by bisection."""
    value = "list_reduce(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / ((lo + hi) / 2))), lambda s, v: s + v)"
    return f"""nb as (select src as id, list(dist order by rank) as d, cast({rho} as double) as rho from e group by src),
bis(id, d, rho, it, lo, hi, mid, done) as (
  select id, d, rho, 0, 0.0::double, 1e10::double, 1.0::double, false from nb
  union all
  select id, d, rho, it + 1, case when abs(v - t) < 1e-5 or v > t then lo else m end, case when abs(v - t) >= 1e-5 and v > t then m else hi end, m, abs(v - t) < 1e-5
  from (select *, (lo + hi) / 2 as m, {value} as v, ln(len(d)::double) as t from bis where not done and it < 64)),
local as (select id, arg_max(rho, it) as rho, arg_max(mid, it) as sigma from bis group by id)"""


def _graph() -> str:
    return f"""{_edges()}, {_sigma("0")},
w as (select e.src, e.dst, exp(-greatest(dist - rho, 0) / greatest(sigma, 1e-10)) as w from e join local on e.src = local.id),
g as (select coalesce(a.src, b.dst) as src, coalesce(a.dst, b.src) as dst, coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0) as weight from w a full join w b on a.src = b.dst and a.dst = b.src),
g2 as (select * from g where weight > 1e-8)"""


DEGREES = "deg as (select p.id, case when coalesce(d, 0) < 1e-10 then 1 else d end as degree from p left join (select src, sum(weight) as d from g2 group by src) on p.id = src)"
STAND_IN = "y as (select vec_id as id, embedding[1]::double as y1, embedding[2]::double as y2, label from embeddings)"
DIST_2 = "sqrt((a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2))"
SAMPLE = "s as (select id from p order by md5(concat('42:', id)), id limit (select ceil(count(*) * 0.1)::bigint from p))"
SEPARATION = """select round(avg(dist) filter (same), 6) as within, round(avg(dist) filter (not same), 6) as between, round(stddev_samp(dist) filter (same), 6) as within_sd,
round(stddev_samp(dist) filter (not same), 6) as between_sd, round(avg(dist) filter (not same) / avg(dist) filter (same), 6) as ratio from d"""
DRAWN = """n as (select count(*) as n from p), places as (select id, row_number() over (order by id) - 1 as place from p),
drawn as (select ('0x' || substr(md5(concat('42:0:', r)), 1, 12))::bigint % n as a, ('0x' || substr(md5(concat('42:1:', r)), 1, 12))::bigint % n as b from range({m}) t(r), n),
ij as (select x.id as i, y.id as j from drawn join places x on x.place = a join places y on y.place = b where a <> b)"""
MODEL = "m as (select vec_id as id, embedding[1:4]::double[] as x, 0.1 + label / 10.0::double as sigma from embeddings)"
_cells = " union all ".join(f"select concat('point_', id) as subject, '{name}' as predicate, round({value}, 6) as object from m" for name, value in [("umap1", "x[1]"), ("umap2", "x[2]"), ("sigma", "sigma"), ("rho", "0.0::double"), *[(f"feature_{j}", f"x[{j + 1}]") for j in range(4)]])
_wide = ", ".join(f"round({value}, 6) as {name}" for name, value in [("umap1", "x[1]"), ("umap2", "x[2]"), ("sigma", "sigma"), ("rho", "0.0::double"), *[(f"feature_{j}", f"x[{j + 1}]") for j in range(4)]])
_SCHEDULE = "f as (select src, dst, 1 / dist as weight from e), t as (select max(weight) as top from f), sched as (select src, dst, top / weight as eps from f, t)"


def _tsne(perplexity: float) -> str:
    w = "list_transform(d, lambda x: exp(-(1.0 / (2.0 * ((lo + hi) / 2) * ((lo + hi) / 2))) * x * x))"
    final = "list_transform(d, lambda x: exp(-(1.0 / (2.0 * sigma * sigma)) * x * x))"
    return f"""{_edges()}, nb as (select src as id, list(dst order by rank) as nb, list(dist order by rank) as d from e group by src),
bis(id, d, it, lo, hi, mid, done) as (
  select id, d, 0, 1e-10::double, 1e4::double, 1.0::double, false from nb
  union all
  select id, d, it + 1, case when abs(v - t) < 1e-5 or v > t then lo else m end, case when abs(v - t) >= 1e-5 and v > t then m else hi end, m, abs(v - t) < 1e-5 from (
    select *, case when z < 1e-20 then -1 else list_reduce(list_transform(w, lambda x: case when x / z > 1e-20 then -(x / z * ln(x / z)) else 0 end), lambda s, u: s + u) end as v from (
      select *, list_reduce(w, lambda s, u: s + u) as z from (select *, (lo + hi) / 2 as m, {w} as w, ln({perplexity}::double) as t from bis where not done and it < 64)))),
local as (select id, arg_max(mid, it) as sigma from bis group by id),
q as (select id, nb, {final} as w from nb join local using (id)),
dir as (select src, dst, v as w from (select id as src, unnest(nb) as dst, unnest(list_transform(w, lambda x: x / greatest(list_sum(w), 1e-20))) as v from q) where v > 1e-12),
both_ as (select src, dst, w from dir union all select dst, src, w from dir)
select src, dst, round(greatest(sum(w) / (2 * (select count(*) from p)), 1e-12), 9) as p from both_ group by src, dst"""


def _codes() -> str:
    """rest(id, i, norm, index, c, rest) and codes(id, norm, rn, idx, bits): the codec by the Hadamard matrix itself."""
    d = CODEC.padded
    c, b = (", ".join(f"{v!r}::double" for v in x.tolist()) for x in CODEC.codebook)
    first, second = (", ".join(str(int(v)) for v in CODEC.signs(w)) for w in (0, 1))
    sign = "case when bit_count(i & j) % 2 = 0 then 1 else -1 end"
    return f"""k as (select [{c}] as c, [{b}] as b, [{first}] as s0, [{second}] as s1), {POINTS},
norms as (select id, sqrt(list_reduce(list_transform(x, lambda v: v * v), lambda s, v: s + v)) as norm from p),
xs as (select p.id, norm, unnest(x) as v, unnest(range(0, {d})) as j from p join norms using (id)),
z as (select id, i, any_value(norm) as norm, sum(v / norm * s0[j + 1] * ({sign})) as z from xs, k, range(0, {d}) t(i) group by id, i),
ix as (select id, i, norm, z, len(list_filter(b, lambda y: y < z)) as index from z, k),
rest as (select id, i, norm, index, c[index + 1] as c, z - c[index + 1] as rest from ix, k),
bits as (select id, i, sum(rest * s1[j + 1] * ({sign})) >= 0 as bit from (select id, i as j, rest from rest), k, range(0, {d}) t(i) group by id, i),
codes as (select id, any_value(norm)::float as norm, sqrt(sum(rest * rest))::float as rn, list(c order by i) as c, list((2 * bit::int - 1)::double order by i) as s, string_agg(format('{{:02X}}', (2 * index + bit::int)::int), '' order by i) as packed from rest join bits using (id, i) group by id)"""


def _code_edges() -> str:
    d = CODEC.padded
    dot = "list_reduce(list_transform(range(1, len(a.{c}) + 1), lambda i: a.{c}[i] * b.{c}[i]), lambda s, v: s + v)"
    cos = f"greatest(-1, least(1, ({dot.format(c='c')} + pi() / 2 / {d * d} * a.rn::double * b.rn::double * {dot.format(c='s')}) / {d}))"
    return f"""{_codes()}, pairs as (select a.id as src, b.id as dst, sqrt(greatest(a.norm::double ** 2 + b.norm::double ** 2 - 2 * a.norm::double * b.norm::double * {cos}, 0)) as dist from codes a join codes b on a.id <> b.id),
e as (select src, dst, cast(row_number() over (partition by src order by dist, dst) as int) as rank, dist from pairs qualify rank <= {NEIGHBOURS})"""


ORACLES: dict[str, str] = {
    "codec_encode": f"with {_codes()} select id, norm, rn as residual_norm, packed from codes",
    "codec_decode": f"with {_codes()} select r.id, j::int as pos, round(sum(r.c * s0[j + 1] * (case when bit_count(i & j) % 2 = 0 then 1 else -1 end)) / {CODEC.padded} * any_value(r.norm::float::double), 6) as x from rest r, k, range(0, {CODEC.width}) t(j) group by r.id, j",
    "codec_memory": f"with {_codes()} select (sum(length(packed) // 2) + 4 * count(*) + 4 * {2 * LEVELS[CODEC.bits] - 1} + 4 * {CODEC.padded})::bigint as bytes, round(avg(rn * rn) / {CODEC.padded}, 6) as residual from codes",
    "knn_compressed": f"with {_code_edges()} select src, dst, rank, round(dist, 6) as dist from e",
    "fuzzy_compressed": f"""with recursive {_code_edges()}, {_sigma('greatest(min(dist), 0)')}, w as (select e.src, e.dst, exp(-greatest(dist - rho, 0) / greatest(sigma, 1e-10)) as w from e join local on e.src = local.id),
g as (select coalesce(a.src, b.dst) as src, coalesce(a.dst, b.src) as dst, coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0) as weight from w a full join w b on a.src = b.dst and a.dst = b.src) select src, dst, round(weight, 6) as weight from g where weight > 1e-8""",
    "knn_dispatch": f"""with {POINTS}, s as (select * from p order by md5(concat('42:', id)), id limit (select ceil(count(*) * 0.02)::bigint from p)),
pairs as (select a.id as src, b.id as dst, {_distance("a.x", "b.x", "len(a.x)")} as dist from s a join s b on a.id <> b.id)
select src, dst, cast(row_number() over (partition by src order by dist, dst) as int) as rank, round(dist, 6) as dist from pairs qualify rank <= 200""",
    "csv_points": " union all ".join(f"select l_orderkey as id, {i} as pos, round(sum({c}), 3) as x from lineitem group by 1" for i, c in enumerate(WIDE)),
    "embedding_csv": "select round(embedding[1]::double, 6) as v1, round(embedding[2]::double, 6) as v2, label from embeddings",
    "optional_source": "select 'nation' as name, count(*) as n from nation union all select 'no_such_table', -1",
    "timings_ranked": "select method, round(ratio, 3) as ratio, coalesce(time, -1) as time from (select o_orderpriority as method, avg(o_totalprice) as ratio from orders group by 1) left join (values ('1-URGENT', 1.5::double), ('2-HIGH', 2.5::double), ('3-MEDIUM', 3.5::double), ('5-LOW', 5.5::double)) t(method, time) using (method)",
    "housekeeping": "select count(event_id) as event_id, count(user_id) as user_id, count(event_type) as event_type, count(value) as value from events",
    "gathered": f"with {POINTS}, {SAMPLE} select id from s",
    "vector_kernels": f"""with {POINTS}, n as (select id, x, list_reduce(list_transform(x, lambda v: v * v), lambda s, v: s + v) as q from p), u as (select id, q, unnest(range(0, len(x))) as pos, unnest(x) as v from n)
select id, pos::int as pos, round(1 / (1 + q), 8) as kernel, round(v * 0.01::double, 8) as scaled, round(greatest(least(v, 0.1::double), -0.1::double), 8) as clamped,
[-0.25, -0.15, -0.075, -0.025, 0.025, 0.075, 0.15, 0.25][1 + {' + '.join(f'(v > {b}::double)::int' for b in BOUNDARIES)}]::double as decoded from u""",
    "graph_facts": f"with recursive {_graph()} select count(*) as nnz, count(distinct src) as nodes, round(max(weight), 6) as top from g2",
    "umap_facts": "select count(*) as n, 0.0::double as y1, 0.0::double as y2, 0::bigint as bad from embeddings",
    "triples_roundtrip": " union all ".join([f"select '{p}' as predicate, count(*) as n, 0.0::double as total from embeddings" for p in ("umap1", "umap2", "sigma", "rho")] + [f"select 'feature_{j}', count(*), round(sum(embedding[{j + 1}]::double), 4) from embeddings" for j in range(64)]),
    "knn_exact": f"with {_edges()} select src, dst, rank, round(dist, 6) as dist from e",
    "knn_expression": f"with {_edges()} select src, dst, rank, round(dist, 6) as dist from e",
    "knn_external": f"with {_edges(left='a.id % 2 = 0', right='b.id % 2 = 1')} select src as qid, dst, rank, round(dist, 6) as dist from e",
    "knn_rerank": f"with {_edges()} select src, dst, rank, round(dist, 6) as dist from e",
    "knn_label_purity": f"with {_edges()} select a.label, count(*) as n, round(avg(case when a.label = b.label then 1.0 else 0.0 end), 6) as purity from e join p a on a.id = e.src join p b on b.id = e.dst group by a.label",
    "smooth_knn": f"with recursive {_edges()}, {_sigma('0')} select id, round(rho, 6) as rho, round(sigma, 6) as sigma from local",
    "smooth_knn_nearest": f"with recursive {_edges()}, {_sigma('greatest(min(dist), 0)')} select id, round(rho, 6) as rho, round(sigma, 6) as sigma from local",
    "fuzzy_graph": f"with recursive {_graph()} select src, dst, round(weight, 6) as weight from g2",
    "graph_degree": f"with recursive {_graph()}, {DEGREES} select id, round(degree, 6) as degree from deg",
    "normalized_laplacian": f"with recursive {_graph()}, {DEGREES} select src, dst, round(-weight / sqrt(a.degree * b.degree), 6) as value from g2 join deg a on a.id = src join deg b on b.id = dst union all select id, id, 1.0 from p",
    "laplacian": f"with recursive {_graph()} select src, dst, round(-weight, 6) as value from g2 union all select p.id, p.id, round(coalesce(sum(weight), 0), 6) from p left join g2 on g2.src = p.id group by p.id",
    "edge_schedule": f"with {_edges()}, {_SCHEDULE} select src, dst, round(eps, 6) as eps, floor(499.0 / eps)::bigint as n_firings, round(eps / 5.0, 6) as eps_negative from sched",
    "edge_firings": f"with {_edges()}, {_SCHEDULE}, fire as (select eps, unnest(range(1, floor(99.0 / eps)::bigint + 1)) as m from sched) select ceil(m * eps)::bigint as epoch, count(*) as n from fire group by 1",
    "tsne_affinity": f"with recursive {_tsne(5.0)}",
    "column_means": " union all ".join(f"select {i} as pos, round(avg({c}), 4) as mean from lineitem" for i, c in enumerate(WIDE)),
    "covariance": " union all ".join(f"select {i} as p, {j} as q, round(covar_samp({a}, {b}), 3) as cov from lineitem" for i, a in enumerate(WIDE) for j, b in enumerate(WIDE)),
    "row_norms": f"with {POINTS} select id, round(sqrt(list_reduce(list_transform(x, lambda v: v * v), lambda s, v: s + v)), 6) as norm from p",
    "asinh_points": "select event_id as id, round(asinh(value / 5.0), 6) as value from events",
    "sample_train": f"with {POINTS}, {SAMPLE} select id from s",
    "sample_rest": f"with {POINTS}, {SAMPLE} select id from p where id not in (select id from s)",
    "sample_scatter": f"with {POINTS}, {SAMPLE} select id, case when id in (select id from s) then 'train' else 'rest' end as part from p",
    "head_slice": "select vec_id as id from embeddings order by vec_id limit 100",
    "random_pairs": f"with {POINTS}, {DRAWN.format(m=1000)} select i, j from ij",
    "equal_width_bins": "with r as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part) select p_partkey, greatest(1, least(5, ceil((p_retailprice - lo) / ((hi - lo) / 5))::int)) as bin from part, r",
    "triples_export": f"with {MODEL} {_cells}",
    "triples_pivot": f"with {MODEL} select id, {_wide} from m",
    "transform_init": f"""with {_edges(left='a.id % 2 = 0', right='b.id % 2 = 1')}, l as (select e.src, min(dist) as rho, avg(0.1 + p.label / 10.0::double) as s from e join p on p.id = e.dst group by e.src),
w as (select e.src, p.x[1] as y1, p.x[2] as y2, exp(-greatest(dist - rho, 0) / greatest(s, 1e-10)) as w from e join p on p.id = e.dst join l on l.src = e.src)
select src as id, round(sum(w * y1) / greatest(sum(w), 1e-10), 6) as y1, round(sum(w * y2) / greatest(sum(w), 1e-10), 6) as y2 from w group by src""",
    "separation_exact": f"with {STAND_IN}, d as (select a.label = b.label as same, {DIST_2} as dist from y a join y b on a.id < b.id) {SEPARATION}",
    "separation_sampled": f"with {POINTS}, {STAND_IN}, {DRAWN.format(m=5000)}, d as (select a.label = b.label as same, {DIST_2} as dist from ij join y a on a.id = i join y b on b.id = j) {SEPARATION}",
    "group_stats": f"with {STAND_IN} select label, count(*) as n, " + ", ".join(f"round({f}({c}), 6) as {c}_{name}" for c in ("y1", "y2") for name, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sd", "stddev_samp"))) + " from y group by label",
    "group_counts": "select label, count(*) as n from embeddings group by label",
    "nn_coherence": f"with {STAND_IN}, d as (select a.id as src, b.label, row_number() over (partition by a.id order by {DIST_2}, b.id) as r from y a join y b on a.id <> b.id where a.label = 1) select count(*) as n, round(avg(case when label = 1 then 1.0 else 0.0 end), 6) as coherence from d where r = 1",
    "conditional_labels": "select case when label = 1 then 'rare' else 'other' end as kind, count(*) as n from embeddings group by 1",
    "label_concat": "select o_orderkey, concat_ws('_', o_orderstatus, o_orderpriority) as label from orders",
    "quantize_scalar": f"with {POINTS}, c as (select id, unnest(range(0, len(x))) as pos, unnest(x) as v from p) select id, pos::int as pos, ({' + '.join(f'(v > {b}::double)::int' for b in BOUNDARIES)})::int as code from c",
    "synthetic_ramp": "select i as id, j::int as pos, round(i * j / 200.0::double + sin(i * 0.1::double), 6) as x from range(200) a(i), range(5) b(j)",
}
