"""Queries over posterior draws and headings; registered with those of catalog.py, which imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.operators import agents, posterior
from fauntrack.plans import fixtures as X
from fauntrack.plans.catalog import N, kern, q6, query, r6

# ------------------------------------------------------------------ posterior draws

#: One draw a supplier, so that the number of draws grows with the tables.
_CHAIN = "chain AS (SELECT s_suppkey AS draw, 0.02 + 0.9 * ((s_suppkey * 37) % 97) / 97.0 AS v, 0.02 + abs(s_acctbal) / 20000.0 AS d, s_acctbal / 5000.0 AS g FROM supplier)"
_DRAWS = f"{_CHAIN}, draws AS (SELECT *, least(1.0, greatest(0.0, v / (v + d + 1e-6))) AS alpha, least(0.95, greatest(0.01, 1 / (1 + v + d + 1e-6))) AS rho FROM chain)"
_KERNELS = f""", {_DRAWS},
pe AS (SELECT draw, src, dst, w, alpha, rho, w * exp(greatest(-25.0, least(25.0, g * (b.hsi - a.hsi)))) AS t FROM draws, edges JOIN units a ON a.s_idx = src AND NOT a.is_land JOIN units b ON b.s_idx = dst AND NOT b.is_land),
pm AS (SELECT draw, src, dst, (1 - rho) * (alpha * t / sum(t) OVER z + (1 - alpha) * w / sum(w) OVER z) AS p FROM pe WINDOW z AS (PARTITION BY draw, src)),
pk AS (SELECT draw, src, dst, p FROM pm WHERE p > 1e-12 UNION ALL SELECT draw, s_idx, s_idx, 1 - coalesce(o, 0.0) FROM draws CROSS JOIN units LEFT JOIN (SELECT draw AS dr, src, sum(p) AS o FROM pm GROUP BY 1, 2) x ON dr = draw AND src = s_idx)"""


def chain(s, d, wrapped: bool = False):
    """A chain with its bookkeeping columns; wrapped, named as a sampler names them."""
    t = X.table(s, d, "supplier")
    name = (lambda c: f"Parameter({c})") if wrapped else (lambda c: c)
    return t.select(F.col("s_suppkey").alias("draw"), (0.02 + 0.9 * ((F.col("s_suppkey") * 37) % 97) / 97.0).alias(name("mu_velocity")), (0.02 + F.abs("s_acctbal") / 20000.0).alias(name("mu_diffusion")), (F.col("s_acctbal") / 5000.0).alias(name("mu_gamma")), F.lit(True).alias("Extra(:accepted)" if wrapped else "accepted"))


def regions(s, d):
    return X.units(s, d).select("s_idx", (F.col("region") + 1).alias("region"))


@query(f"WITH {_CHAIN}, z AS (SELECT draw, v, d, g, (SELECT avg(least(0.95, greatest(0.0, v + 0.3 * x))) FROM (VALUES (-1.5), (0.0), (draw % 7 / 2.0)) t(x)) AS v2, (SELECT avg(greatest(0.0, d + 0.1 * x)) FROM (VALUES (-1.5), (0.0), (draw % 7 / 2.0)) t(x)) AS d2 FROM chain) SELECT draw, {q6('v2', 'velocity')}, {q6('d2', 'diffusion')}, {q6('g', 'gamma')}, {q6('least(1.0, greatest(0.0, v2 / (v2 + d2 + 1e-6)))', 'alpha')}, {q6('least(0.95, greatest(0.01, 1 / (1 + v2 + d2 + 1e-6)))', 'rho')} FROM z")
def posterior_draws(s, d):
    """Draws of a chain with effects of three individuals on velocity and diffusion."""
    z = F.array(F.lit(-1.5), F.lit(0.0), F.col("draw") % 7 / 2.0)
    c = chain(s, d, wrapped=True).withColumns({"Parameter(sigma_velocity)": F.lit(0.3), "Parameter(z_velocity)": z, "Parameter(sigma_diffusion)": F.lit(0.1), "Parameter(z_diffusion)": z})
    return posterior.parameter_draws(c).select("draw", *[r6(x) for x in ("velocity", "diffusion", "gamma", "alpha", "rho")])


def _posterior_kernels(s, d):
    return posterior.posterior_kernels(posterior.parameter_draws(chain(s, d)), X.units(s, d), X.edges(s, d), N)


@query(X.with_sql("units", "edges", body=f"{_KERNELS} SELECT draw, src, dst, {q6('p', 'p')} FROM pk WHERE p > 1e-12"))
def posterior_kernels(s, d):
    return _posterior_kernels(s, d).select("draw", "src", "dst", r6("p"))


_REGIONAL = f"""{_KERNELS}, rg AS (SELECT s_idx, CAST(region + 1 AS INT) AS region FROM units), z AS (SELECT region, count(*) AS c FROM rg GROUP BY 1),
ms AS (SELECT draw, a.region AS from_region, b.region AS to_region, sum(p) AS m FROM pk JOIN rg a ON a.s_idx = src JOIN rg b ON b.s_idx = dst GROUP BY 1, 2, 3),
gr AS (SELECT draw, z1.region AS from_region, z2.region AS to_region, coalesce(m, 0.0) / (z1.c * z2.c + 1e-10) AS m FROM draws CROSS JOIN z z1 CROSS JOIN z z2 LEFT JOIN ms USING (draw) WHERE coalesce(ms.from_region, z1.region) = z1.region AND coalesce(ms.to_region, z2.region) = z2.region),
gq AS (SELECT d.draw, d.from_region, d.to_region, coalesce(max(gr.m), 0.0) AS m FROM (SELECT draw, z1.region AS from_region, z2.region AS to_region FROM draws CROSS JOIN z z1 CROSS JOIN z z2) d LEFT JOIN gr ON gr.draw = d.draw AND gr.from_region = d.from_region AND gr.to_region = d.to_region GROUP BY 1, 2, 3),
cn AS (SELECT draw, from_region, to_region, m / sum(m) OVER (PARTITION BY draw, from_region) AS p FROM gq)"""


@query(X.with_sql("units", "edges", body=f"{_REGIONAL} SELECT draw, from_region, to_region, {q6('p', 'p')} FROM cn"))
def regional_draws(s, d):
    return posterior.regional_draws(_posterior_kernels(s, d), regions(s, d)).select("draw", "from_region", "to_region", r6("p"))


@query(X.with_sql("units", "edges", body=f"{_REGIONAL} SELECT from_region AS source_region, to_region AS sink_region, count(*) AS n_draws, {q6('avg(p)', 'mean_conn')}, {q6('quantile_cont(p, 0.025)', 'lower_ci')}, {q6('quantile_cont(p, 0.975)', 'upper_ci')} FROM cn GROUP BY 1, 2"))
def connectivity_intervals(s, d):
    """Credible intervals of the connectivity between regions over all draws."""
    c = posterior.connectivity_intervals(posterior.regional_draws(_posterior_kernels(s, d), regions(s, d)))
    return c.select("source_region", "sink_region", "n_draws", r6("mean_conn"), r6("lower_ci"), r6("upper_ci"))


@query(X.with_sql("units", "edges", body=f""", {_DRAWS}, mn AS (SELECT avg(g) AS g, avg(rho) AS rho, avg(alpha) AS alpha FROM draws),
ad AS (SELECT s_idx, hsi - m AS a FROM (SELECT src, sum(w * hsi) / sum(w) AS m FROM edges JOIN units ON s_idx = dst GROUP BY src) JOIN units ON src = s_idx),
pe AS (SELECT src, dst, w, alpha, least(0.999, greatest(0.0, rho + 0.4 * ad.a)) AS rho, w * exp(greatest(-25.0, least(25.0, g * (b.hsi - u.hsi)))) AS t FROM mn, edges JOIN units u ON u.s_idx = src AND NOT u.is_land JOIN units b ON b.s_idx = dst AND NOT b.is_land JOIN ad ON ad.s_idx = src),
pm AS (SELECT src, dst, (1 - rho) * (alpha * t / sum(t) OVER z + (1 - alpha) * w / sum(w) OVER z) AS p FROM pe WINDOW z AS (PARTITION BY src))
SELECT src, dst, {q6('p', 'p')} FROM pm UNION ALL SELECT s_idx, s_idx, round(1 - coalesce(o, 0.0), 6) + 0.0 FROM units LEFT JOIN (SELECT src, sum(p) AS o FROM pm GROUP BY 1) x ON src = s_idx"""))
def posterior_mean_kernel(s, d):
    """The kernel at the posterior means, residency coupled to local habitat."""
    return posterior.posterior_kernel(posterior.parameter_draws(chain(s, d)), X.units(s, d), X.edges(s, d), beta=0.4).select("src", "dst", r6("p"))


@query()
def resolvent_kernel(s, d):
    """Mean resolvent over all draws; a matrix inverse is beyond SQL, a test compares it with numpy's."""
    draws = posterior.parameter_draws(chain(s, d)).withColumns({"velocity": F.col("velocity") / 2, "diffusion": -F.col("diffusion")})
    return posterior.resolvent_kernel(draws, X.units(s, d), X.edges(s, d), N).select("src", "dst", r6("p"))


# ------------------------------------------------------------------ agents with a heading

_HEADING = """, kb AS (SELECT src, dst, p, CASE WHEN src = dst THEN NULL ELSE degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) END AS b FROM kernel JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst),
en AS (SELECT dst AS src, src AS via, b AS heading FROM kb WHERE src <> dst UNION ALL SELECT DISTINCT src, 0, NULL FROM kb),
hv AS (SELECT kb.src, via, dst, CASE WHEN kb.src = dst THEN via ELSE kb.src END AS dst_via, p * exp(CASE WHEN heading IS NULL THEN 0.0 WHEN kb.src = dst THEN 1.5 ELSE 1.5 * cos(radians(b - heading)) END) AS v FROM kb JOIN en ON en.src = kb.src),
hc AS (SELECT src, via, dst, dst_via, v / sum(v) OVER (PARTITION BY src, via) AS p FROM hv)"""


@query(X.with_sql("kernel", body=f"{_HEADING} SELECT src, CAST(via AS INT) AS via, dst, CAST(dst_via AS INT) AS dst_via, {q6('p', 'p')} FROM hc"))
def heading_chain(s, d):
    return agents.heading_chain(kern(s, d), X.units(s, d), 1.5).select("src", "via", "dst", "dst_via", r6("p"))


@query(X.with_sql("pairs", "kernel", recursive=True, body=f"{_HEADING}, st AS (SELECT release AS src, 0 AS via, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM pairs) AS q, 0 AS step FROM pairs GROUP BY 1 UNION ALL SELECT hc.dst, hc.dst_via, sum(q * p), step + 1 FROM st JOIN hc ON hc.src = st.src AND hc.via = st.via WHERE step < 4 GROUP BY hc.dst, hc.dst_via, step + 1) SELECT CAST(step AS INT) AS step, src AS s_idx, {q6('sum(q)', 'p')} FROM st GROUP BY 1, 2"))
def heading_distribution(s, d):
    """Where agents from all observed releases are after up to four steps with a heading."""
    starts = X.pairs(s, d).groupBy(F.col("release").alias("s_idx")).agg(F.count("*").alias("n"))
    return agents.heading_distribution(starts, kern(s, d), X.units(s, d), 4, 1.5).select("step", "s_idx", r6("p"))


@query()
def heading_agents(s, d):
    """As many agents as there are pairs, drawn from the pairs' releases and steps; a test holds them against heading_distribution."""
    p = X.pairs(s, d)
    return agents.forward_agents(p, kern(s, d), X.units(s, d), N, p.count(), kappa=1.5)


#: One draw a region of the tables: each costs a sweep of all releases.
_FEW = "chain AS (SELECT r_regionkey AS draw, 0.1 + 0.15 * r_regionkey AS v, 0.05 + 0.1 * r_regionkey AS d, 0.5 * r_regionkey AS g FROM region), draws AS (SELECT *, least(1.0, greatest(0.0, v / (v + d + 1e-6))) AS alpha, least(0.95, greatest(0.01, 1 / (1 + v + d + 1e-6))) AS rho FROM chain)"


def _normal(x: str, name: str) -> str:
    import math

    mean, sd, low, high = posterior.PRIORS[name]
    mass = 0.5 * (math.erf((high - mean) / sd / math.sqrt(2)) - math.erf((low - mean) / sd / math.sqrt(2)))
    return f"(-0.5 * pow(({x} - {mean!r}) / {sd!r}, 2) - ln({sd!r} * sqrt(2 * pi()) * {mass!r}))"


@query(X.with_sql("pairs", "edges", recursive=True, body=f""", {_KERNELS.replace(_DRAWS, _FEW).lstrip(', ')},
obs AS (SELECT release, recapture, k, count(*) AS n FROM pairs GROUP BY 1, 2, 3),
sw AS (SELECT draw, release, release AS node, CAST(1 AS DOUBLE) AS p, 0 AS step FROM draws, (SELECT DISTINCT release FROM obs) UNION ALL SELECT s.draw, s.release, pk.dst, sum(s.p * pk.p), s.step + 1 FROM sw s JOIN pk ON pk.draw = s.draw AND pk.src = s.node WHERE s.step < 24 GROUP BY s.draw, s.release, pk.dst, s.step + 1),
ll AS (SELECT draw, CAST(sum(n) AS BIGINT) AS n_pairs, sum(n * ln(greatest(coalesce(p, 0.0), 1e-12))) AS loglik FROM draws CROSS JOIN obs LEFT JOIN (SELECT draw AS dr, release AS re, node, step, p FROM sw) x ON dr = draw AND re = release AND node = recapture AND step = k GROUP BY 1),
pr AS (SELECT draw, {_normal('v', 'velocity')} + {_normal('d', 'diffusion')} + {_normal('g', 'gamma')} AS prior FROM draws)
SELECT draw, n_pairs, {q6('prior', 'prior')}, round(loglik, 3) AS loglik, round(prior + loglik, 3) AS logp FROM ll JOIN pr USING (draw)"""))
def log_posterior(s, d):
    """Log posterior density of all pairs at a draw for each region of the tables."""
    t, k = X.table(s, d, "region"), F.col("r_regionkey")
    c = t.select(k.cast("int").alias("draw"), (0.1 + 0.15 * k).alias("mu_velocity"), (0.05 + 0.1 * k).alias("mu_diffusion"), (0.5 * k).alias("mu_gamma"))
    r = posterior.log_posterior(posterior.parameter_draws(c), X.pairs(s, d), X.units(s, d), X.edges(s, d), N)
    return r.select(F.col("draw").cast("int").alias("draw"), "n_pairs", r6("prior"), geo.rounded("loglik", 3).alias("loglik"), geo.rounded("logp", 3).alias("logp"))


# ------------------------------------------------------------------ reports


@query(X.with_sql("pairs", "kernel", body=f""", rg AS (SELECT s_idx, CAST(region AS INT) AS region FROM units WHERE region > 0),
m AS (SELECT CAST(a.region AS INT) AS f, CAST(b.region AS INT) AS t, sum(p) AS m FROM kernel JOIN rg a ON a.s_idx = src JOIN rg b ON b.s_idx = dst GROUP BY 1, 2), c AS (SELECT f, t, m / sum(m) OVER (PARTITION BY f) AS p FROM m),
n AS (SELECT a.region AS f, b.region AS t, count(*) AS n FROM pairs JOIN rg a ON a.s_idx = release JOIN rg b ON b.s_idx = recapture GROUP BY 1, 2),
g AS (SELECT f.region AS source_region, t.region AS sink_region, coalesce(c.p, 0.0) AS connectivity, coalesce(n.n, 0) AS flow_count FROM (SELECT DISTINCT region FROM rg) f CROSS JOIN (SELECT DISTINCT region FROM rg) t LEFT JOIN c ON c.f = f.region AND c.t = t.region LEFT JOIN n ON n.f = f.region AND n.t = t.region)
SELECT source_region, sink_region, {q6('connectivity', 'connectivity')}, flow_count, {q6('connectivity * flow_count / (sum(flow_count) OVER () + 1e-10)', 'flow_rate')} FROM g"""))
def connectivity_summary(s, d):
    from fauntrack.operators import markov
    from fauntrack.sources import reports

    r = X.units(s, d).select("s_idx", "region")
    return reports.report(reports.connectivity_summary(markov.regional(kern(s, d), r.where("region > 0")), X.pairs(s, d), r), "stock_connectivity_summary")


# ------------------------------------------------------------------ lines of sight and meshes in rings

#: An octagon about the points of each third of the events, so that the rings follow the tables.
_OCTAGONS = "pt AS (SELECT ((event_id * 37) % 1800) / 10.0 AS x, ((event_id * 91) % 1400) / 10.0 AS y, CAST(user_id % 3 AS INT) + 1 AS region FROM events), ct AS (SELECT region, avg(x) + 40.0 * (region - 2) AS cx, avg(y) + 25.0 * (region - 2) AS cy, 0.5 * stddev_samp(x) + region AS r FROM pt GROUP BY 1), rings AS (SELECT region, k AS seq, cx + r * cos(radians(45.0 * k + 10.0)) AS x, cy + r * sin(radians(45.0 * k + 10.0)) AS y FROM ct, range(8) t(k))"
_SIDES = f"{_OCTAGONS}, segs AS (SELECT region, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY region ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def octagons(s, d):
    e = X.table(s, d, "events").select((F.pmod(F.col("event_id") * 37, F.lit(1800)) / 10.0).alias("x"), (F.pmod(F.col("event_id") * 91, F.lit(1400)) / 10.0).alias("y"), (F.col("user_id") % 3 + 1).cast("int").alias("region"))
    c = e.groupBy("region").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.stddev_samp("x").alias("sd"))
    c = c.select("region", (F.col("cx") + 40.0 * (F.col("region") - 2)).alias("cx"), (F.col("cy") + 25.0 * (F.col("region") - 2)).alias("cy"), (0.5 * F.col("sd") + F.col("region")).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    a = F.radians(45.0 * F.col("seq") + 10.0)
    return c.select("region", "seq", (F.col("cx") + F.col("r") * F.cos(a)).alias("x"), (F.col("cy") + F.col("r") * F.sin(a)).alias("y"))


_MESH_IN = f"WITH {_SIDES}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rings), ce AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, sqrt(3.0) * 6.0 * c + CASE WHEN r % 2 <> 0 THEN sqrt(3.0) * 3.0 ELSE 0.0 END AS x, 9.0 * r AS y FROM range(-60, 120) t(r), range(-60, 120) u(c)), un AS (SELECT DISTINCT row, col, x, y FROM (SELECT row, col, x, y, region FROM ce, segs WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY ALL HAVING count(*) % 2 = 1)), nu AS (SELECT CAST(row_number() OVER (ORDER BY row, col) AS INT) AS s_idx, * FROM un)"


@query(f"{_MESH_IN} SELECT s_idx, row, col, {q6('x', 'x')}, {q6('y', 'y')} FROM nu")
def mesh_in_rings(s, d):
    """Units of a fine mesh whose centres lie in the rings."""
    from fauntrack.operators import mesh

    return mesh.hex_mesh_in(s, octagons(s, d), 6.0)[0].select("s_idx", "row", "col", r6("x"), r6("y"))


@query(f"{_MESH_IN} SELECT a.s_idx AS src, b.s_idx AS dst FROM nu a JOIN nu b ON a.s_idx <> b.s_idx AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= sqrt(3.0) * 6.0 * 1.05")
def mesh_in_rings_edges(s, d):
    from fauntrack.operators import mesh

    return mesh.hex_mesh_in(s, octagons(s, d), 6.0)[1].select("src", "dst")


@query(X.with_sql("units", "edges", body=", ev AS (SELECT CAST(json_extract(props, '$.k') AS INT) + 1 AS s_idx, count(*) AS n FROM events GROUP BY 1), bs AS (SELECT s_idx FROM ev WHERE n < (SELECT avg(n) FROM ev)), ed AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT s_idx FROM bs) AND dst NOT IN (SELECT s_idx FROM bs)), nv AS (SELECT * FROM units WHERE NOT is_land AND (s_idx IN (SELECT src FROM ed) OR s_idx IN (SELECT dst FROM ed))) SELECT s_idx, true AS itself, CAST(0.0 AS DOUBLE) AS distance FROM nv UNION ALL SELECT u.s_idx, false, round(min(sqrt(pow(u.x - nv.x, 2) + pow(u.y - nv.y, 2))), 6) FROM units u, nv WHERE u.s_idx NOT IN (SELECT s_idx FROM nv) GROUP BY 1"))
def navigable_distance(s, d):
    """Where paths from every unit can start once the units with few detections are cut off."""
    from fauntrack.operators import sight

    n = X.detections(s, d).groupBy("s_idx").agg(F.count("*").alias("n"))
    few = n.where(F.col("n") < n.agg(F.avg("n").alias("a")).scalar()).select("s_idx")
    e = X.edges(s, d).join(few.withColumnRenamed("s_idx", "src"), "src", "left_anti").join(few.withColumnRenamed("s_idx", "dst"), "dst", "left_anti")
    # which of several nearest nodes is taken hangs on the last digit, so only the distance is compared
    return sight.navigable(X.units(s, d), e, 20.0).select("s_idx", (F.col("node") == F.col("s_idx")).alias("itself"), r6("distance"))


@query()
def smooth_paths(s, d):
    """Shortcuts of every least-cost path that stay off the rings; a test holds them against a plain search."""
    from fauntrack.operators import markov, sight

    u = X.units(s, d)
    p = markov.paths(X.pairs(s, d), markov.least_cost(u, X.edges(s, d)), N).select("release", "recapture", "nodes")
    return sight.smooth_paths(p, u, octagons(s, d)).select("release", "recapture", "smooth", r6("length"), r6("smooth_length"))


@query(X.with_sql("units", "edges", body=f"SELECT src, dst, {q6('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))', 'plane')}, round(2 * 6378.137 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 4) + 0.0 AS globe FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst"))
def node_distance(s, d):
    """Lengths of edges in the plane, and of the same in degrees where the space is told from the values."""
    from fauntrack.plans.catalog import _ends

    e = _ends(s, d)
    return e.select("src", "dst", r6(geo.node_distance_km("x1", "y1", "x2", "y2", "planar_km"), "plane"), (geo.rounded(geo.node_distance_km("lon1", "lat1", "lon2", "lat2"), 4) + 0.0).alias("globe"))
