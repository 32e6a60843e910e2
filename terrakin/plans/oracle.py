"""DuckDB SQL of the registered queries, as chains of common table expressions."""

from __future__ import annotations

from terrakin.functions.curve import find_ab
from terrakin.operators import metrics
from terrakin.plans.queries import CLASSES, PARAMS

K, SEED = PARAMS.n_neighbors, PARAMS.seed
ROUNDS = 8  # of ownership; more than any test table needs


def uniform(*key: str) -> str:
    text = " || '|' || ".join(f"({k})::VARCHAR" for k in key)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


PTS = "pts AS MATERIALIZED (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f, label::INT AS label FROM embeddings)"
D = "sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def nearest(name: str, source: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (
        SELECT id AS q, 0 AS rank, id AS c, 0.0::DOUBLE AS dist FROM {source}
        UNION ALL SELECT q, rn, c, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c)::INT AS rn FROM (
          SELECT a.id AS q, b.id AS c, {D} AS d FROM {source} a JOIN {source} b ON a.id <> b.id)) WHERE rn < {k})"""


def bands(n: int) -> str:
    """Bandwidths, memberships, shares, running shares and the graph of level n."""
    return f"""
      s{n} AS MATERIALIZED (SELECT q AS id, list(dist ORDER BY rank) AS ds, avg(dist) AS own, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM knn{n} GROUP BY q),
      b{n} AS (
        SELECT id, ds, rho, 0.0::DOUBLE AS lo, NULL::DOUBLE AS hi, 1.0::DOUBLE AS mid, 0 AS it, FALSE AS done FROM s{n}
        UNION ALL
        SELECT id, ds, rho, CASE WHEN gap <= 0 THEN mid ELSE lo END, CASE WHEN gap > 0 THEN mid ELSE hi END,
          CASE WHEN abs(gap) < 1e-5 THEN mid WHEN gap > 0 THEN (lo + mid) / 2 WHEN hi IS NULL THEN mid * 2 ELSE (mid + hi) / 2 END, it + 1, abs(gap) < 1e-5
        FROM (SELECT *, list_sum(list_transform(ds[2:], lambda d: CASE WHEN d - rho > 0 THEN exp(-(d - rho) / mid) ELSE 1.0 END)) - log2({K}) AS gap FROM b{n} WHERE NOT done AND it < 64)),
      sig{n} AS MATERIALIZED (
        SELECT id, greatest(mid, 1e-3 * CASE WHEN rho > 0 THEN own ELSE (SELECT avg(dist) FROM knn{n}) END) AS sigma, rho
        FROM (SELECT id, arg_max(mid, it) AS mid FROM b{n} GROUP BY id) JOIN s{n} USING (id)),
      e{n} AS MATERIALIZED (
        SELECT q AS i, rank, c AS j, CASE WHEN q = c THEN 0.0 WHEN dist - rho <= 0 OR sigma = 0 THEN 1.0 ELSE exp(-(dist - rho) / sigma) END::DOUBLE AS v
        FROM knn{n} JOIN sig{n} ON id = q),
      t{n} AS MATERIALIZED (SELECT *, v / nullif(sum(v) OVER (PARTITION BY i), 0) AS p FROM e{n}),
      c{n} AS MATERIALIZED (SELECT i, j, sum(p) OVER r - p AS lo0, coalesce(sum(p) OVER (PARTITION BY i ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(p) OVER r AS hi FROM t{n} WINDOW r AS (PARTITION BY i ORDER BY rank ROWS UNBOUNDED PRECEDING)),
      g{n} AS MATERIALIZED (SELECT i, j, sum(v) * 0.5 AS w FROM (SELECT i, j, v FROM e{n} WHERE v > 0 UNION ALL SELECT j, i, v FROM e{n} WHERE v > 0) GROUP BY i, j)"""


def marks(n: int) -> str:
    """Landmarks of level n and what they represent."""
    p = PARAMS
    draw = lambda kind: uniform(f"'{SEED}|{kind}|{n}'", "start", "walk", "step")
    return f"""
      w{n} AS (
        SELECT start, walk, start AS v, 0 AS step FROM (SELECT DISTINCT i AS start FROM e{n}), range({p.landmark_walks}) r(walk)
        UNION ALL SELECT start, walk, j, step + 1 FROM (SELECT *, {draw('lm')} AS u FROM w{n} WHERE step < {p.landmark_steps}) JOIN c{n} ON i = v AND u >= lo AND u < hi),
      n{n} AS MATERIALIZED (SELECT id, count(v) AS cnt FROM (SELECT DISTINCT i AS id FROM e{n}) LEFT JOIN (SELECT v FROM w{n} WHERE step = {p.landmark_steps}) ON v = id GROUP BY id),
      lm{n} AS MATERIALIZED (
        SELECT slot, id FROM (SELECT row_number() OVER (ORDER BY cnt DESC, id) - 1 AS slot, id FROM n{n})
        WHERE slot < (SELECT floor({p.levels[n]}::FLOAT * count(*)::FLOAT) FROM n{n})),
      a{n} AS (
        SELECT start, walk, start AS v, 0 AS step, FALSE AS done FROM (SELECT DISTINCT i AS start FROM e{n}), range({p.influence_walks}) r(walk) WHERE start NOT IN (SELECT id FROM lm{n})
        UNION ALL SELECT start, walk, j, step + 1, j IN (SELECT id FROM lm{n})
        FROM (SELECT *, {draw('ab')} AS u FROM a{n} WHERE NOT done AND step < {p.influence_steps}) JOIN c{n} ON i = v AND u >= lo AND u < hi),
      h{n} AS MATERIALIZED (SELECT DISTINCT slot, start AS pt FROM a{n} JOIN lm{n} ON id = v WHERE done)"""


def similarity(n: int) -> str:
    """Landmark distances of level n and the neighbours of level n + 1."""
    return f"""
      kn{n} AS MATERIALIZED (
        SELECT a.slot AS "row", b.slot AS col, 1.0 - count(*) / (SELECT max(x) FROM (SELECT count(*) AS x FROM h{n} GROUP BY slot))::DOUBLE AS dist
        FROM h{n} a JOIN h{n} b ON a.pt = b.pt GROUP BY a.slot, b.slot),
      sh{n} AS MATERIALIZED (
        SELECT l.slot AS "row", count(k.col) AS entries, coalesce(max((k."row" = k.col)::INT), 0) AS own FROM lm{n} l LEFT JOIN kn{n} k ON k."row" = l.slot GROUP BY l.slot HAVING count(k.col) < {K}),
      pd{n} AS (
        SELECT "row", x AS col FROM sh{n}, range({K}) r(x) WHERE x <> "row" AND x < (SELECT count(*) FROM lm{n})
        UNION SELECT "row", CASE WHEN (SELECT count(*) FROM lm{n}) > {K} THEN {K} ELSE "row" END FROM sh{n} WHERE own = 0 AND "row" < {K}),
      ds{n} AS MATERIALIZED (SELECT * FROM kn{n} UNION ALL SELECT "row", col, 1.0 FROM pd{n} WHERE NOT EXISTS (SELECT 1 FROM kn{n} k WHERE k."row" = pd{n}."row" AND k.col = pd{n}.col)),
      knn{n + 1} AS MATERIALIZED (
        SELECT q, rank, c, dist FROM (SELECT "row" AS q, (row_number() OVER (PARTITION BY "row" ORDER BY dist, ("row" <> col)::INT, col) - 1)::INT AS rank, col AS c, dist FROM ds{n}) WHERE rank < {K})"""


def ownership(n: int) -> str:
    """Owners of the points of level n."""
    parts = [f"""
      re{n} AS MATERIALIZED (SELECT c AS id, q AS owner, slot, dist FROM knn{n} JOIN lm{n} ON lm{n}.id = q WHERE rank > 0 AND c NOT IN (SELECT id FROM lm{n})),
      o{n}_0 AS MATERIALIZED (
        SELECT id, id AS owner, slot AS owner_slot, 0.0::DOUBLE AS strength, slot AS first_slot FROM lm{n}
        UNION ALL SELECT id, arg_min(owner, {{'d': dist, 's': slot}}), arg_min(slot, {{'d': dist, 's': slot}}), min(dist), min(slot) FROM re{n} GROUP BY id)"""]
    for r in range(ROUNDS):
        parts.append(f"""
      o{n}_{r + 1} AS MATERIALIZED (
        SELECT * FROM o{n}_{r} UNION ALL
        SELECT q, arg_min(owner, rank), arg_min(owner_slot, rank), arg_min(dist, rank), arg_min(owner_slot, rank)
        FROM knn{n} JOIN o{n}_{r} o ON o.id = c WHERE rank > 0 AND q NOT IN (SELECT id FROM o{n}_{r}) GROUP BY q)""")
    return ",".join(parts) + f""",
      o{n} AS MATERIALIZED (SELECT * FROM o{n}_{ROUNDS})"""


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


L0 = [PTS, nearest("knn0", "pts", K), bands(0)]
M0 = [*L0, marks(0)]
L1 = [*M0, similarity(0), bands(1)]
L2 = [*L1, marks(1), similarity(1), bands(2)]
POINTS2 = "p2 AS (SELECT b.slot, a.id AS orig_id, label FROM lm1 b JOIN lm0 a ON a.slot = b.id JOIN pts ON pts.id = a.id)"
IN = ", ".join(map(str, CLASSES))
PLANE = "pl AS MATERIALIZED (SELECT vec_id::BIGINT AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
SAMPLE = f"smp AS MATERIALIZED (SELECT * FROM pts ORDER BY {uniform(f'{chr(39)}{SEED}|sample{chr(39)}', 'id')}, id LIMIT {metrics.SAMPLE})"
PAIRS = f"""pairs AS MATERIALIZED (
    SELECT a.id AS q, b.id AS c, {D} AS high, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) AS low
    FROM smp a JOIN smp b ON a.id < b.id JOIN pl u ON u.id = a.id JOIN pl v ON v.id = b.id)"""
PARTS = """ln AS (SELECT q AS a, c AS b FROM knn0 WHERE rank = 1 UNION SELECT c, q FROM knn0 WHERE rank = 1),
    rc AS (SELECT a AS node, a AS seen FROM ln UNION SELECT rc.node, ln.b FROM rc JOIN ln ON ln.a = rc.seen),
    parts AS MATERIALIZED (SELECT node, min(seen) AS root FROM rc GROUP BY node)"""
GENES = """genes AS MATERIALIZED (
    SELECT batch, cell, gene, count(*) AS n FROM (SELECT coalesce(source, '') AS batch, doc_id AS cell, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS gene FROM documents) GROUP BY ALL)"""
SIZES = "sizes AS (SELECT batch, cell, sum(n)::BIGINT AS size FROM genes GROUP BY batch, cell)"
A, B = find_ab(PARAMS.spread, PARAMS.min_dist)
INIT = [f"{uniform(f'{chr(39)}{SEED}|init|0{chr(39)}', 'id', str(d))} * 20 - 10" for d in (0, 1)]

ORACLE_SQL = {
    "pairwise_distance": f"{chain(PTS)} SELECT a.id AS q, b.id AS c, round({D}, 6) AS dist FROM pts a JOIN pts b ON a.id < b.id",
    "knn_exact": f"{chain(*L0[:2])} SELECT q, rank, c, round(dist, 6) AS dist FROM knn0",
    "knn_label_agreement": f"{chain(*L0[:2])} SELECT q, count(*) FILTER (a.label = b.label) AS same, count(*) AS n FROM knn0 JOIN pts a ON a.id = q JOIN pts b ON b.id = c WHERE rank > 0 GROUP BY q",
    "smooth_knn": f"{chain(*L0)} SELECT id, round(sigma, 6) AS sigma, round(rho, 6) AS rho FROM sig0",
    "membership": f"{chain(*L0)} SELECT i, rank, j, round(v, 6) AS v FROM e0",
    "transition": f"{chain(*L0)} SELECT i, rank, j, round(p, 6) AS p FROM t0",
    "fuzzy_graph": f"{chain(*L0)} SELECT i, j, round(w, 6) AS w FROM g0",
    "pruned_graph": f"{chain(*L0)} SELECT i, j, round(w, 6) AS w FROM g0 WHERE w > (SELECT max(w) FROM g0) / 10",
    "epochs_per_sample": f"{chain(*L0)} SELECT i, j, round((SELECT max(w) FROM g0) / w, 6) AS epochs FROM g0",
    "walk_endpoints": f"{chain(*M0)} SELECT id, cnt FROM n0",
    "landmarks_l1": f"{chain(*M0)} SELECT slot, id FROM lm0",
    "neighborhood_l1": f"{chain(*M0)} SELECT slot, pt FROM h0",
    "local_neighborhood_l1": f"{chain(*M0)} SELECT DISTINCT slot, q AS pt FROM knn0 JOIN lm0 ON id = c WHERE rank BETWEEN 1 AND 9 AND q NOT IN (SELECT id FROM lm0)",
    "landmark_distance_l1": f'{chain(*M0, similarity(0))} SELECT "row", col, round(dist, 6) AS dist FROM ds0',
    "landmark_data_l1": f"""{chain(*M0, similarity(0))}
        SELECT "row", col, round(arg_max(dist, o), 6) AS val FROM (
          SELECT "row", col, dist, {{'r': "row", 'c': col}} AS o FROM ds0 UNION ALL SELECT col, "row", dist, {{'r': "row", 'c': col}} FROM ds0) GROUP BY "row", col""",
    "knn_l1": f"{chain(*M0, similarity(0))} SELECT q, rank, c, round(dist, 6) AS dist FROM knn1",
    "fuzzy_graph_l1": f"{chain(*L1)} SELECT i, j, round(w, 6) AS w FROM g1",
    "ownership_l0": f"{chain(*M0, ownership(0))} SELECT id, owner, owner_slot, round(strength, 6) AS strength FROM o0",
    "association_l0": f"""{chain(*M0, ownership(0))},
        x AS (SELECT id, slot FROM (SELECT *, min(dist) OVER (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM re0) WHERE low IS NULL OR dist < low
          UNION ALL SELECT id, owner_slot FROM o0 WHERE id NOT IN (SELECT id FROM re0))
        SELECT id, (row_number() OVER (PARTITION BY id ORDER BY slot) - 1)::INT AS pos, slot FROM x""",
    "count_influence": f"{chain(*M0, ownership(0))} SELECT first_slot AS slot, count(*) AS cnt FROM o0 GROUP BY 1",
    "owned_count": f"{chain(*M0, ownership(0))} SELECT owner_slot, count(*) AS n FROM o0 GROUP BY 1",
    "influence_l1": f"{chain(*M0, ownership(0))} SELECT slot, count(first_slot) AS cnt FROM lm0 LEFT JOIN o0 ON first_slot = slot GROUP BY slot",
    "influence_l2": f"""{chain(*L1, marks(1), ownership(0), ownership(1))},
        i1 AS (SELECT first_slot AS slot, count(*) AS cnt FROM o0 GROUP BY 1)
        SELECT lm1.slot, coalesce(sum(i1.cnt), 0)::BIGINT AS cnt FROM lm1 LEFT JOIN o1 ON owner_slot = lm1.slot LEFT JOIN i1 ON i1.slot = o1.id GROUP BY lm1.slot""",
    "labels_l2": f"{chain(*L1, marks(1), POINTS2)} SELECT slot, label FROM p2",
    "original_indices_l2": f"{chain(*L1, marks(1), POINTS2)} SELECT slot, orig_id FROM p2",
    "owner_slots_l1": f"{chain(*L1, marks(1), ownership(1))} SELECT id, owner_slot FROM o1",
    "drill_members_by_class": f"{chain(*L1, marks(1), ownership(1), POINTS2)} SELECT id, owner_slot FROM o1 WHERE owner_slot IN (SELECT slot FROM p2 WHERE label IN ({IN}))",
    "drill_members_by_index": f"{chain(*L1, marks(1), ownership(1))} SELECT id, owner_slot FROM o1 WHERE owner_slot < 5",
    "drill_subgraph": f"""{chain(*M0, ownership(0))},
        f AS (SELECT id FROM o0 WHERE owner_slot IN (SELECT slot FROM lm0 JOIN pts USING (id) WHERE label IN ({IN})))
        SELECT i, j, round(w, 6) AS w FROM g0 WHERE i IN (SELECT id FROM f) AND j IN (SELECT id FROM f)""",
    "focus_context_graph": f"""{chain(*L2, ownership(1), POINTS2)},
        f AS (SELECT id FROM o1 WHERE owner_slot IN (SELECT slot FROM p2 WHERE label IN ({IN}))),
        x AS (SELECT slot AS id FROM p2 WHERE label NOT IN ({IN}))
        SELECT 'focus' AS role, i, j, round(w, 6) AS w FROM g1 WHERE i IN (SELECT id FROM f) AND j IN (SELECT id FROM f)
        UNION ALL SELECT 'context', i, j, round(w, 6) FROM g2 WHERE i IN (SELECT id FROM x) AND j IN (SELECT id FROM x)""",
    "random_init": f"{chain(PTS)} SELECT id, round({INIT[0]}, 6) AS x, round({INIT[1]}, 6) AS y FROM pts",
    "fixed_rescale": f"""{chain(PTS, PLANE)},
        z AS (SELECT pts.id, CASE WHEN pts.id % 7 = 0 THEN pl.x ELSE r.x END AS x, CASE WHEN pts.id % 7 = 0 THEN pl.y ELSE r.y END AS y, pts.id % 7 = 0 AS is_fixed
          FROM pts JOIN pl USING (id) JOIN (SELECT id, {INIT[0]} AS x, {INIT[1]} AS y FROM pts) r USING (id))
        SELECT id, round(10 * (x - (SELECT min(x) FROM z)) / ((SELECT max(x) FROM z) - (SELECT min(x) FROM z)), 6) AS x,
          round(10 * (y - (SELECT min(y) FROM z)) / ((SELECT max(y) FROM z) - (SELECT min(y) FROM z)), 6) AS y, is_fixed FROM z""",
    "sgd_edge_gradient": f"""{chain(*L0[:2], PLANE)},
        m AS (SELECT q AS i, c AS j, a.x - b.x AS dx, a.y - b.y AS dy FROM knn0 JOIN pl a ON a.id = q JOIN pl b ON b.id = c WHERE rank > 0),
        k AS (SELECT *, CASE WHEN d2 > 0 THEN -2 * {A}::DOUBLE * {B}::DOUBLE * pow(d2, {B}::DOUBLE - 1) / ({A}::DOUBLE * pow(d2, {B}::DOUBLE) + 1) ELSE 0 END AS co FROM (SELECT *, dx * dx + dy * dy AS d2 FROM m))
        SELECT i, j, round(greatest(-4, least(4, co * dx)), 6) AS gx, round(greatest(-4, least(4, co * dy)), 6) AS gy FROM k""",
    "metric_stress": f"{chain(PTS, PLANE, SAMPLE, PAIRS)} SELECT round(sqrt(sum((low / l - high / h) ** 2) / sum((high / h) ** 2)), 6) AS stress FROM pairs, (SELECT max(high) AS h, max(low) AS l FROM pairs)",
    "metric_spearman": f"""{chain(PTS, PLANE, SAMPLE, PAIRS)},
        f AS (SELECT high * high AS h, low * low AS l FROM pairs UNION ALL SELECT high * high, low * low FROM pairs UNION ALL SELECT 0, 0 FROM smp),
        r AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS rh, rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2.0::DOUBLE AS rl FROM f)
        SELECT round(corr(rh, rl), 6) AS correlation FROM r""",
    "metric_procrustes": f"""{chain(PTS)},
        p AS (SELECT f[1] AS a, f[2] AS b, f[3] AS c, f[4] AS d FROM pts),
        m AS (SELECT regr_sxx(a, a) + regr_sxx(b, b) AS na, regr_sxx(c, c) + regr_sxx(d, d) AS nb, regr_sxy(a, c) AS ac, regr_sxy(a, d) AS ad, regr_sxy(b, c) AS bc, regr_sxy(b, d) AS bd FROM p)
        SELECT round(1 - (ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / (na * nb), 6) AS disparity FROM m""",
    "knn_recall": "SELECT TRUE AS enough",
    "layout_quality": "SELECT count(*) AS placed, TRUE AS finite, TRUE AS beats_pca FROM embeddings",
    "graph_components": f"{chain(*L0[:2], PARTS)} SELECT node, root FROM parts",
    "component_centroids": f"{chain(*L0[:2], PARTS)} SELECT root AS part, (k - 1)::INT AS at, round(avg(f[k]), 6) AS mean FROM parts JOIN pts ON id = node, range(1, 65) r(k) GROUP BY 1, 2",
    "component_linkage": f"""{chain(*L0[:2], PARTS)}
        SELECT least(a.root, b.root) AS a, greatest(a.root, b.root) AS b, round(min(dist), 6) AS dist
        FROM knn0 JOIN parts a ON a.node = q JOIN parts b ON b.node = c WHERE rank > 0 AND a.root <> b.root GROUP BY 1, 2""",
    "sgd_push": f"""{chain(*L0[:2], PLANE)},
        pos AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM pl), n AS (SELECT count(*) AS n FROM pl),
        m AS (SELECT q AS i, c AS j, md5('{SEED}|neg|1|' || q || '|' || c) AS h FROM knn0 WHERE rank > 0),
        t AS (SELECT i, j, draw::INT AS draw, ((('0x' || substr(h, 1, 15))::BIGINT % n + draw * (('0x' || substr(h, 16, 15))::BIGINT % n)) % n) AS pos FROM m, n, range(5) r(draw)),
        u AS (SELECT i, j, draw, b.id AS k, a.x - b.x AS dx, a.y - b.y AS dy FROM t JOIN pos b USING (pos) JOIN pl a ON a.id = i WHERE i <> b.id),
        w AS (SELECT *, CASE WHEN d2 > 0 THEN 2 * {B}::DOUBLE / ((0.001::DOUBLE + d2) * ({A}::DOUBLE * pow(d2, {B}::DOUBLE) + 1)) ELSE 0 END AS co FROM (SELECT *, dx * dx + dy * dy AS d2 FROM u))
        SELECT i, j, draw, k, round(CASE WHEN co > 0 THEN greatest(-4, least(4, co * dx)) ELSE 4 END, 6) AS gx, round(CASE WHEN co > 0 THEN greatest(-4, least(4, co * dy)) ELSE 4 END, 6) AS gy FROM w""",
    "drill_padded_knn": f"""{chain(*L1, marks(1), ownership(1), POINTS2)},
        v AS (SELECT "row", col, arg_max(dist, o) AS val FROM (
          SELECT "row", col, dist, {{'r': "row", 'c': col}} AS o FROM ds0 UNION ALL SELECT col, "row", dist, {{'r': "row", 'c': col}} FROM ds0) GROUP BY "row", col),
        s AS (SELECT DISTINCT id FROM o1 WHERE owner_slot IN (SELECT slot FROM p2 WHERE label IN ({IN}))),
        d AS (SELECT a.id AS q, b.id AS c, coalesce(v.val, 1.0) AS dist FROM s a CROSS JOIN s b LEFT JOIN v ON v."row" = a.id AND v.col = b.id)
        SELECT q, rank, c, round(dist, 6) AS dist FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY dist, (q <> c)::INT, c) - 1)::INT AS rank FROM d) WHERE rank < {K}""",
    "drill_correspondence": f"{chain(*L1, marks(1), POINTS2)} SELECT lm1.slot, lm1.id, row_number() OVER (ORDER BY lm1.slot) - 1 AS place FROM lm1 JOIN p2 USING (slot) WHERE label IN ({IN})",
    "metric_np": f"""{chain(PTS, PLANE, SAMPLE, "pf AS (SELECT id, [x, y] AS f FROM pl WHERE id IN (SELECT id FROM smp))", nearest("hi", "smp", 31), nearest("lo", "pf", 31))},
        m AS (SELECT greatest(a.rank, b.rank) AS o FROM hi a JOIN lo b USING (q, c) WHERE a.rank > 0 AND b.rank > 0)
        SELECT (k - 1)::INT AS neighbors, round((SELECT count(*) FROM m WHERE o <= k) / ((SELECT count(*) FROM smp) * k)::DOUBLE, 6) AS np FROM range(1, 31) r(k)""",
    "library_size_filter": f"""{chain(GENES, SIZES)},
        a AS (SELECT s.* FROM sizes s JOIN (SELECT batch, quantile_cont(size, 0.2) AS cut FROM sizes GROUP BY batch) USING (batch) WHERE size > cut)
        SELECT a.* FROM a JOIN (SELECT batch, quantile_cont(size, 0.75) AS cut FROM a GROUP BY batch) USING (batch) WHERE size < cut""",
    "rare_gene_filter": f"{chain(GENES)} SELECT gene, count(*) AS cells, sum(n)::BIGINT AS n FROM genes WHERE gene IN (SELECT gene FROM genes GROUP BY gene HAVING count(DISTINCT cell) >= 10) GROUP BY gene",
    "lib_norm_sqrt": f"{chain(GENES, SIZES)} SELECT batch, cell, gene, round(sqrt(n / size * 10000.0::DOUBLE), 6) AS value FROM genes JOIN sizes USING (batch, cell)",
    "prefix_filter": f"""{chain(GENES)},
        h AS (SELECT batch, cell, sum(CASE WHEN starts_with(gene, 'th') THEN n ELSE 0 END)::BIGINT AS held FROM genes GROUP BY batch, cell)
        SELECT * FROM h WHERE held < (SELECT quantile_cont(held, 0.9) FROM h)""",
    "label_encode": "SELECT lang, doc_id, CASE WHEN lang IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 END::BIGINT AS code FROM documents",
    "batch_union": "SELECT doc_id, source, lang AS batch FROM documents WHERE lang IS NOT NULL",
    "sparse_symmetric": """WITH e AS (SELECT vec_id AS "row", (k - 1)::BIGINT AS col, embedding[k]::DOUBLE AS val FROM embeddings, range(1, 65) r(k) WHERE embedding[k] <> 0)
        SELECT "row", col, round(arg_max(val, o), 6) AS val FROM (
          SELECT "row", col, val, {'r': "row", 'c': col} AS o FROM e UNION ALL SELECT col, "row", val, {'r': "row", 'c': col} FROM e) GROUP BY "row", col""",
    "sparse_rows": """SELECT vec_id AS "row", count(*) AS n, (min(k) - 1)::INT AS first_col, (max(k) - 1)::INT AS last_col FROM embeddings, range(1, 65) r(k) WHERE embedding[k] <> 0 GROUP BY vec_id""",
    "dense_rows": f"""{chain(*L1, marks(1), similarity(1))},
        v AS (SELECT "row", col, arg_max(dist, o) AS val FROM (
          SELECT "row", col, dist, {{'r': "row", 'c': col}} AS o FROM ds1 UNION ALL SELECT col, "row", dist, {{'r': "row", 'c': col}} FROM ds1) GROUP BY "row", col),
        n AS (SELECT count(*) AS n FROM lm1)
        SELECT a."row", c.col::INT AS col, round(coalesce(v.val, 0), 6) AS val FROM (SELECT DISTINCT "row" FROM v) a, (SELECT unnest(range(n)) AS col FROM n) c LEFT JOIN v ON v."row" = a."row" AND v.col = c.col""",
    "gather_by_index": "SELECT a.vec_id AS pos, b.vec_id AS id, b.label FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)",
    "mean_shift": f"{chain(*L0[:2])} SELECT q AS id, (k - 1)::INT AS at, round(avg(f[k]), 6) AS value FROM knn0 JOIN pts ON id = c, range(1, 65) r(k) WHERE rank > 0 GROUP BY 1, 2",
    "stacked_report": f"""{chain(*L1, marks(1), POINTS2)},
        t AS (SELECT 'level 1' AS technique, label FROM lm0 JOIN pts USING (id) UNION ALL SELECT 'level 2', label FROM p2)
        SELECT technique, round(avg(label), 6) AS mean, round(stddev_pop(label), 6) AS std FROM t GROUP BY technique""",
    "common_landmarks": f"{chain(*L1, marks(1), POINTS2)} SELECT p2.slot AS pos, orig_id, lm0.slot AS other FROM p2 JOIN lm0 ON lm0.id = orig_id",
    "vector_distance": f"{chain(PTS)} SELECT a.id || '_' || b.id AS pair, round({D} ** 2, 6) AS d2 FROM pts a JOIN pts b ON b.id = a.id + 1",
    "curve_grid": f"SELECT k::INT AS at, round(k * {3.0 * PARAMS.spread}::DOUBLE / 299, 6) AS x FROM range(300) r(k)",
    "param_grid": "SELECT a.x AS n_neighbors, b.x AS distance_similarity, c.x AS influence_nw, d.x AS influence_wl FROM (VALUES (15::BIGINT), (100)) a(x), (VALUES (FALSE), (TRUE)) b(x), (VALUES (10::BIGINT), (20), (30), (40)) c(x), (VALUES (5::BIGINT), (10), (20), (30), (40), (50), (60), (70)) d(x)",
    "nearest_level": """WITH s AS (SELECT 0 AS level, count(*) AS size FROM embeddings), t AS (SELECT 1 AS level, floor(0.2::FLOAT * size::FLOAT)::BIGINT AS size FROM s), u AS (SELECT 2 AS level, floor(0.2::FLOAT * size::FLOAT)::BIGINT AS size FROM t)
        SELECT level FROM (SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM u) ORDER BY abs(size - 70), level LIMIT 1""",
    "sample_n": f"SELECT vec_id AS id, label FROM embeddings ORDER BY {uniform(f'{chr(39)}{SEED}|sample{chr(39)}', 'vec_id')}, vec_id LIMIT 100",
    "train_split": f"SELECT vec_id AS id, CASE WHEN {uniform(f'{chr(39)}{SEED}|split{chr(39)}', 'vec_id')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM embeddings",
    "l2_normalize": f"""{chain(PTS)} SELECT id, (k - 1)::INT AS col, round(f[k] / sqrt(list_sum(list_transform(f, lambda x: x * x))), 6) AS val FROM pts, range(1, 65) r(k)""",
    "doc_lookup_join": f"{chain(*M0)} SELECT slot, id AS orig_id, label, text AS document FROM lm0 JOIN pts USING (id) JOIN documents ON doc_id = id",
}
