"""DuckDB SQL of the queries: common tables first, then the query of each name."""

from __future__ import annotations

import numpy as np

TABLES = {
    "m": "SELECT vec_id AS subject, label, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i)",
    "mem": "SELECT p AS pathway, feature FROM (SELECT DISTINCT feature FROM m) f, range(2, 10) q(p) WHERE feature % p = 0",
    "w": "SELECT pathway, feature, 1.0::DOUBLE / count(*) OVER (PARTITION BY pathway) AS weight FROM mem",
    "dots": "SELECT a.feature AS f1, b.feature AS f2, sum(a.value * b.value) AS dot FROM m a JOIN m b USING (subject) GROUP BY ALL",
    "norms": "SELECT f1 AS f, CASE WHEN dot = 0 THEN 1 ELSE sqrt(dot) END AS norm FROM dots WHERE f1 = f2",
    "cosines": "SELECT f1 AS src, f2 AS dst, dot / (x.norm * y.norm) AS r FROM dots JOIN norms x ON x.f = f1 JOIN norms y ON y.f = f2 WHERE f1 <> f2",
    "adj": "SELECT src, dst, least(abs(r), 1::DOUBLE) AS weight FROM cosines",
    "pe": "SELECT a.pathway, a.feature AS src, b.feature AS dst, CASE WHEN (31 * a.feature + 17 * b.feature) % 23 <= 2 THEN 1::DOUBLE ELSE 2::DOUBLE END AS code FROM mem a JOIN mem b USING (pathway) WHERE a.feature <> b.feature AND (31 * a.feature + 17 * b.feature) % 23 <= 4",
    "net": "SELECT DISTINCT pathway, src, dst, 1::DOUBLE AS weight FROM (SELECT pathway, src, dst FROM pe UNION ALL SELECT pathway, dst, src FROM pe WHERE code = 2)",
    "und": "SELECT a.* FROM net a JOIN net b ON a.pathway = b.pathway AND a.src = b.dst AND a.dst = b.src",
    "deg": "SELECT mem.pathway, mem.feature, coalesce(sum(net.weight), 0) AS k FROM mem LEFT JOIN net ON net.pathway = mem.pathway AND net.dst = mem.feature GROUP BY ALL",
    "top": "SELECT pathway, feature, CASE WHEN max(k) OVER (PARTITION BY pathway) <> 0 THEN k / max(k) OVER (PARTITION BY pathway) ELSE k END AS v FROM deg",
    "cw": "SELECT pathway, feature, CASE WHEN sum(v) OVER (PARTITION BY pathway) <> 0 THEN v / sum(v) OVER (PARTITION BY pathway) ELSE v END AS weight FROM top",
    "flow": "SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "lay": "SELECT CAST(date_diff('day', (SELECT min(date_trunc('week', ts)) FROM events), date_trunc('week', ts)) / 7 AS INTEGER) AS t, user_id AS subject, event_type AS feature, sum(value) AS value FROM events GROUP BY ALL",
    "ldots": "SELECT a.t, a.feature AS f1, b.feature AS f2, sum(a.value * b.value) AS dot FROM lay a JOIN lay b ON a.t = b.t AND a.subject = b.subject GROUP BY ALL",
    "lnorm": "SELECT t, f1 AS f, CASE WHEN dot = 0 THEN 1 ELSE sqrt(dot) END AS norm FROM ldots WHERE f1 = f2",
    "lcells": "SELECT d.t, f1 AS src, f2 AS dst, least(abs(dot / (x.norm * y.norm)), 1::DOUBLE) AS weight FROM ldots d JOIN lnorm x ON x.t = d.t AND x.f = f1 JOIN lnorm y ON y.t = d.t AND y.f = f2 WHERE f1 <> f2",
    "supra": "SELECT t AS src_t, src, t AS dst_t, dst, weight FROM lcells UNION ALL SELECT t, feature, t - 1, feature, (SELECT sum(weight) FROM lcells) / (SELECT count(DISTINCT t) * count(DISTINCT feature) * count(DISTINCT feature) FROM lay) FROM (SELECT DISTINCT t, feature FROM lay) WHERE t > (SELECT min(t) FROM lay)",
    "supraflow": "SELECT src_t || '/' || src AS src, dst_t || '/' || dst AS dst, weight FROM supra",
    "trade": "SELECT DISTINCT o_custkey AS src, -1 - l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}
NEEDS = {
    "mem": "m", "w": "m mem", "dots": "m", "norms": "m dots", "cosines": "m dots norms", "adj": "m dots norms cosines", "pe": "m mem", "net": "m mem pe", "und": "m mem pe net",
    "deg": "m mem pe net", "top": "m mem pe net deg", "cw": "m mem pe net deg top", "ldots": "lay", "lnorm": "lay ldots", "lcells": "lay ldots lnorm", "supra": "lay ldots lnorm lcells", "supraflow": "lay ldots lnorm lcells supra",
}
R = "round({}, 6) + 0.0::DOUBLE"


def r(x: str) -> str:
    return R.format(x)


def with_tables(query: str, *names: str, recursive: str = "") -> str:
    """``query`` after the tables it names and those that they need."""
    wanted = [t for t in TABLES if t in names or any(t in NEEDS.get(n, "").split() for n in names)]
    parts = [f"{t} AS MATERIALIZED ({TABLES[t]})" for t in wanted] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {query}" if parts else query


GRID = "(SELECT DISTINCT subject FROM m) s CROSS JOIN (SELECT DISTINCT pathway FROM mem) p"


def expression(weights: str) -> str:
    return f"SELECT s.subject, p.pathway, {r('coalesce(v, 0)')} AS value FROM {GRID} LEFT JOIN (SELECT subject, pathway, sum(value * weight) AS v FROM m JOIN {weights} USING (feature) GROUP BY ALL) x USING (subject, pathway)"


def page_rank(source: str, target: str, steps: int, rescale: bool = True, network: str = "flow", query: str = "") -> str:
    """Power iteration over a network, the flow if none is named; rank goes from ``source`` to ``target``."""
    value = "raw / sum(raw) OVER ()" if rescale else "raw"
    tables = (
        f"live AS MATERIALIZED (SELECT {source} AS node FROM {network} GROUP BY 1 HAVING sum(weight) <> 0), "
        f"sh AS MATERIALIZED (SELECT {source} AS s, {target} AS t, weight / sum(weight) OVER (PARTITION BY {source}) AS share FROM {network} WHERE src IN (FROM live) AND dst IN (FROM live) UNION ALL SELECT node, node, 0 FROM live), "
        "pr AS (SELECT 0 AS it, node, 1::DOUBLE / (SELECT count(*) FROM live) AS v FROM live UNION ALL "
        f"SELECT it, node, {value} AS v FROM (SELECT it + 1 AS it, live.node, 0.85::DOUBLE * coalesce(sum(share * v), 0) + 0.15::DOUBLE / (SELECT count(*) FROM live) AS raw FROM live LEFT JOIN sh ON sh.t = live.node LEFT JOIN pr ON pr.node = sh.s WHERE it < {steps} GROUP BY it, live.node))"
    )
    query = query or f"SELECT n_nationkey AS node, {r('coalesce(v, 0)')} AS score FROM nation LEFT JOIN (SELECT node, v FROM pr WHERE it = (SELECT max(it) FROM pr)) x ON node = n_nationkey"
    return with_tables(query, network, recursive=tables)


def stochastic_rank(steps: int) -> str:
    """The plain recurrence over the flow network, after the first step of length 1e-3 or less."""
    own = page_rank("src", "dst", steps, rescale=False)
    moved = "far AS (SELECT b.it, sqrt(sum(pow(b.v - a.v, 2))) AS moved FROM pr a JOIN pr b ON b.it = a.it + 1 AND b.node = a.node GROUP BY 1) SELECT n_nationkey"
    return own.replace(" SELECT n_nationkey", f", {moved}", 1).replace("(SELECT max(it) FROM pr)", "(SELECT min(it) FROM far WHERE moved <= 1e-3)")


def group_page_rank(steps: int) -> str:
    """Power iteration in each group's coded network, against its edges; normalised."""
    tables = (
        "live AS MATERIALIZED (SELECT pathway, dst AS node, count(*) OVER (PARTITION BY pathway) AS n FROM net GROUP BY pathway, dst HAVING sum(weight) <> 0), "
        "sh AS MATERIALIZED (SELECT net.pathway, net.dst AS s, net.src AS t, net.weight / sum(net.weight) OVER (PARTITION BY net.pathway, net.dst) AS share FROM net JOIN live a ON a.pathway = net.pathway AND a.node = net.src JOIN live b ON b.pathway = net.pathway AND b.node = net.dst UNION ALL SELECT pathway, node, node, 0 FROM live), "
        "pr AS (SELECT 0 AS it, pathway, node, 1::DOUBLE / n AS v FROM live WHERE n > 1 UNION ALL SELECT it, pathway, node, raw / sum(raw) OVER (PARTITION BY pathway) AS v FROM "
        f"(SELECT it + 1 AS it, live.pathway, live.node, 0.85::DOUBLE * sum(share * v) + 0.15::DOUBLE / live.n AS raw FROM live JOIN sh ON sh.pathway = live.pathway AND sh.t = live.node JOIN pr ON pr.pathway = sh.pathway AND pr.node = sh.s WHERE it < {steps} GROUP BY it, live.pathway, live.node, live.n))"
    )
    query = f"SELECT pathway, feature, {r('CASE WHEN sum(v) OVER (PARTITION BY pathway) <> 0 THEN v / sum(v) OVER (PARTITION BY pathway) ELSE v END')} AS weight FROM (SELECT mem.pathway, mem.feature, coalesce(v, 0) AS v FROM mem LEFT JOIN (SELECT * FROM pr WHERE it = {steps}) x ON x.pathway = mem.pathway AND x.node = mem.feature)"
    return with_tables(query, "mem", "net", recursive=tables)


def leading_vectors(edges: str, query: str, steps: int, *names: str) -> str:
    """ev(it, g, node, v): power iteration in each network of ``edges`` (g, src, dst, weight), with half its largest degree on every loop."""
    tables = (
        f"ge AS MATERIALIZED ({edges}), half AS MATERIALIZED (SELECT g, max(k) / 2 AS shift FROM (SELECT g, dst, sum(weight) AS k FROM ge GROUP BY 1, 2) GROUP BY 1), "
        "lo AS MATERIALIZED (SELECT g, src, dst, weight FROM ge UNION ALL SELECT g, node, node, shift FROM (SELECT DISTINCT g, src AS node FROM ge) JOIN half USING (g)), "
        "ev AS (SELECT DISTINCT 0 AS it, g, src AS node, 1::DOUBLE AS v FROM lo UNION ALL SELECT it, g, node, raw / sqrt(sum(raw * raw) OVER (PARTITION BY g)) AS v FROM "
        f"(SELECT it + 1 AS it, lo.g, lo.dst AS node, sum(weight * v) AS raw FROM lo JOIN ev ON ev.g = lo.g AND ev.node = lo.src WHERE it < {steps} GROUP BY it, lo.g, lo.dst))"
    )
    return with_tables(query, *names, recursive=tables)


def heat(parameter: float, order: int) -> str:
    return with_tables(f"SELECT src, dst, {r(f'exp(-pow(pow(d, 1::DOUBLE / {order}), 2) / (2 * {parameter}::DOUBLE))')} AS weight FROM (SELECT a.feature AS src, b.feature AS dst, sum(pow(abs(a.value - b.value), {order})) AS d FROM m a JOIN m b USING (subject) WHERE a.feature <> b.feature GROUP BY ALL)", "m")


def centrality(networks: str, *names: str) -> str:
    """Normalised in-degrees of each group's network."""
    return with_tables(
        f"SELECT pathway, feature, {r('CASE WHEN sum(v) OVER (PARTITION BY pathway) <> 0 THEN v / sum(v) OVER (PARTITION BY pathway) ELSE v END')} AS weight FROM (SELECT pathway, feature, CASE WHEN max(k) OVER (PARTITION BY pathway) <> 0 THEN k / max(k) OVER (PARTITION BY pathway) ELSE k END AS v FROM "
        f"(SELECT mem.pathway, mem.feature, coalesce(sum(n.weight), 0) AS k FROM mem LEFT JOIN ({networks}) n ON n.pathway = mem.pathway AND n.dst = mem.feature GROUP BY ALL))", *names,
    )


def null_values(universe: list[int], size: int, trials: int) -> str:
    rows = [(t, int(x)) for t in range(trials) for x in np.random.RandomState(t).choice(np.array(universe), size, replace=False)]
    return ", ".join(f"({t}, {x})" for t, x in rows)


SET = (0, 3, 6, 10, 12, 17, 18, 24, 30, 36, 40, 55)
HEAT = {parameter: f"SELECT x.pathway, x.feature AS src, y.feature AS dst, exp(-d / (2 * {parameter}::DOUBLE)) AS weight FROM mem x JOIN mem y USING (pathway) JOIN (SELECT a.feature AS f1, b.feature AS f2, sum(pow(a.value - b.value, 2)) AS d FROM m a JOIN m b USING (subject) WHERE a.feature <> b.feature GROUP BY ALL) ON f1 = x.feature AND f2 = y.feature" for parameter in (500,)}
TOM = f"SELECT src, dst, {r('(coalesce(s, 0) + w) / (least(x.k, y.k) + 1 - w)')} AS weight FROM (SELECT p.src, p.dst, p.weight AS w, s FROM adj p LEFT JOIN (SELECT a.src, b.dst, sum(a.weight * b.weight) AS s FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL) q ON p.src = q.src AND p.dst = q.dst) JOIN (SELECT dst AS n, sum(weight) AS k FROM adj GROUP BY 1) x ON x.n = src JOIN (SELECT dst AS n, sum(weight) AS k FROM adj GROUP BY 1) y ON y.n = dst"
HALVES = "half AS MATERIALIZED (SELECT feature AS node, feature % 5 AS cluster FROM (SELECT DISTINCT feature FROM m))"
CENTERS = "inside AS MATERIALIZED (SELECT adj.dst AS node, sum(adj.weight) AS k FROM adj JOIN half g ON g.node = adj.src JOIN half h ON h.node = adj.dst AND h.cluster = g.cluster GROUP BY 1), cen AS MATERIALIZED (SELECT cluster, node FROM (SELECT h.cluster, h.node, row_number() OVER (PARTITION BY h.cluster ORDER BY coalesce(k, 0) DESC, h.node) AS place FROM half h LEFT JOIN inside USING (node)) WHERE place = 1)"


HEAT_CELLS = "sq AS (SELECT t, f1 AS f, dot FROM ldots WHERE f1 = f2), hcells AS MATERIALIZED (SELECT x.t, x.f AS src, y.f AS dst, exp(-greatest(x.dot + y.dot - 2 * coalesce(d.dot, 0), 0) / 2e6) AS weight FROM sq x JOIN sq y ON x.t = y.t AND x.f <> y.f LEFT JOIN ldots d ON d.t = x.t AND d.f1 = x.f AND d.f2 = y.f)"
HEAT_SUPRA = "hsupra AS (SELECT t AS src_t, src, t AS dst_t, dst, weight FROM hcells UNION ALL SELECT t, feature, t - 1, feature, (SELECT sum(weight) FROM hcells) / (SELECT count(DISTINCT t) * count(DISTINCT feature) * count(DISTINCT feature) FROM lay) FROM (SELECT DISTINCT t, feature FROM lay) WHERE t > (SELECT min(t) FROM lay))"

#: The given clusters, their ranks and parents, and the linkage of them: hc(path, node), rk(path, size, rank), par(rank, size, parent), lk(step, l, r, s1, s2, height).
GIVEN = (
    "hc AS MATERIALIZED (SELECT feature AS node, translate(substr(lpad(bin((feature * 37 + 11) % 64), 6, '0'), 1, d), '01', 'AB') AS path FROM (SELECT DISTINCT feature FROM m) f, range(0, 7) t(d)), "
    "rk AS MATERIALIZED (SELECT path, count(*) AS size, row_number() OVER (ORDER BY count(*), path) - 1 AS rank FROM hc GROUP BY 1), own AS MATERIALIZED (SELECT rank, size, node FROM hc JOIN rk USING (path)), "
    "par AS MATERIALIZED (SELECT rank, size, min(parent) AS parent FROM (SELECT a.rank, a.size, b.rank AS parent FROM own a JOIN own b USING (node) WHERE a.rank < b.rank GROUP BY ALL HAVING count(*) = a.size) GROUP BY 1, 2), "
    "kid AS MATERIALIZED (SELECT par.*, coalesce(CASE WHEN par.size = 1 THEN own.node END, par.rank) AS item, row_number() OVER (PARTITION BY parent ORDER BY par.rank) AS side FROM par LEFT JOIN own ON own.rank = par.rank AND par.size = 1), "
    "pair AS MATERIALIZED (SELECT x.parent, x.rank AS r1, y.rank AS r2, x.item AS l, y.item AS r, x.size AS s1, y.size AS s2 FROM kid x JOIN kid y ON x.parent = y.parent AND x.side = 1 AND y.side = 2), "
    "lk AS MATERIALIZED (SELECT CAST(parent - 64 AS INT) AS step, l, r, s1, s2, sum(sqrt(2 * (1 - coalesce(weight, 0)))) * (1::DOUBLE / s1 + 1::DOUBLE / s2) AS height FROM pair JOIN own a ON a.rank = r1 JOIN own b ON b.rank = r2 LEFT JOIN adj ON adj.src = a.node AND adj.dst = b.node GROUP BY parent, l, r, s1, s2), "
    "link AS MATERIALIZED (SELECT l AS node, step + 64 AS above, 0 AS more, step FROM lk UNION ALL SELECT r, step + 64, s1, step FROM lk)"
)


def given(query: str, more: str = "") -> str:
    return with_tables(query, "adj", recursive=f"{GIVEN}{', ' if more else ''}{more}")


def cut(steps: str) -> str:
    """(item, cluster) after so many merges of the given linkage."""
    return (
        f"(SELECT item, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS cluster FROM (SELECT item, min(item) OVER (PARTITION BY root) AS first FROM (SELECT item, max(node) FILTER (step < {steps}) AS high, coalesce(high, item) AS root FROM "
        "(SELECT item, above AS node, step FROM up) GROUP BY item)))"
    )


def keyed_pairs(edges: int, rounds: int = 4) -> str:
    """A graph of so many of the suppliers' pairs, by the permutation of ``networks.pair_numbers``."""
    hashed = "CAST('0x' || substr(md5('0-{}-' || {}), 1, 12) AS BIGINT)"
    steps = []
    for k in range(rounds):
        steps.append(f"SELECT (l + {hashed.format(2 * k, 'r')} % p) % p AS l, r, n, p, q")
        steps.append(f"SELECT l, (r + {hashed.format(2 * k + 1, 'l')} % q) % q AS r, n, p, q")
    turns = ", ".join(f"c{k + 1} AS ({step} FROM c{k})" for k, step in enumerate(steps))
    return (
        "WITH sup AS MATERIALIZED (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM (SELECT DISTINCT s_suppkey FROM supplier)), "
        "size AS (SELECT n, CASE WHEN n % 2 = 1 THEN n ELSE n // 2 END AS p, CASE WHEN n % 2 = 1 THEN (n - 1) // 2 ELSE n - 1 END AS q FROM (SELECT count(*) AS n FROM sup)), "
        f"c0 AS (SELECT k // q AS l, k % q AS r, n, p, q FROM range(0, {edges}) t(k), size WHERE k < n * (n - 1) // 2), {turns}, "
        "ends AS (SELECT CASE WHEN n % 2 = 1 THEN l WHEN l = 0 THEN n - 1 ELSE (r + l) % (n - 1) END AS i, CASE WHEN n % 2 = 1 THEN (l + r + 1) % n WHEN l = 0 THEN r ELSE (r - l + n - 1) % (n - 1) END AS j "
        f"FROM c{len(steps)}), g AS (SELECT a.node AS a, b.node AS b FROM ends JOIN sup a ON a.place = i JOIN sup b ON b.place = j) SELECT a AS src, b AS dst, 1::DOUBLE AS weight FROM g UNION ALL SELECT b, a, 1::DOUBLE FROM g"
    )


UP = "up AS (SELECT node AS item, above, more, step FROM link WHERE node < 64 UNION ALL SELECT up.item, link.above, link.more, link.step FROM up JOIN link ON link.node = up.above)"
HIGH = "(SELECT count(*) FROM lk WHERE height <= 11)"


def oracles() -> dict[str, str]:
    class_dots = "cd AS MATERIALIZED (SELECT CAST(a.label >= 5 AS INT) AS label, a.feature AS f1, b.feature AS f2, sum(a.value * b.value) AS dot FROM m a JOIN m b USING (subject) GROUP BY ALL)"
    z = "atanh(greatest(least(d.dot / ((CASE WHEN x.dot = 0 THEN 1 ELSE sqrt(x.dot) END) * (CASE WHEN y.dot = 0 THEN 1 ELSE sqrt(y.dot) END)), 0.99999999::DOUBLE), -0.99999999::DOUBLE))"
    n = "(SELECT count(DISTINCT subject) FROM m WHERE CAST(label >= 5 AS INT) = {})"
    scaled = "(value - avg(value) OVER (PARTITION BY feature)) / (CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END)"
    cells = "(SELECT count(DISTINCT feature) FROM m)"
    path = "reach AS (SELECT node, node AS r FROM vs UNION SELECT e.b, reach.r FROM reach JOIN es e ON e.a = reach.node)"
    graph = "vs AS MATERIALIZED (SELECT c_custkey AS node FROM customer UNION ALL SELECT -1 - s_suppkey FROM supplier), es AS MATERIALIZED (SELECT src AS a, dst AS b FROM trade UNION SELECT dst, src FROM trade)"
    return {
        "lpe_expression": with_tables(expression("w"), "w"),
        "lpe_unnormalized": with_tables(expression("(SELECT pathway, feature, 1::DOUBLE AS weight FROM mem) u"), "mem"),
        "glpe_transform_precomputed": with_tables(expression("(SELECT pathway, feature, CAST((feature * 7 + pathway) % 5 AS DOUBLE) AS weight FROM mem) u"), "mem"),
        "pathway_membership_unpivot": "SELECT c_mktsegment AS pathway, unnest(['acct_high', 'acct_low', 'nation_even', 'nation_odd']) AS feature, unnest([sum((c_acctbal > 9000)::INT), sum((c_acctbal < -900)::INT), sum((c_nationkey % 2 = 0)::INT), sum((c_nationkey % 2 = 1)::INT)]) <> 0 AS kept FROM customer GROUP BY 1",
        "standard_scale": with_tables(f"SELECT subject, feature, {r(scaled)} AS value FROM m", "m"),
        "corr_adjacency": with_tables(f"SELECT src, dst, {r('weight')} AS weight FROM adj", "adj"),
        "corr_centred": with_tables(f"SELECT a.feature AS src, b.feature AS dst, {r('least(abs(corr(a.value, b.value)), 1::DOUBLE)')} AS weight FROM m a JOIN m b USING (subject) WHERE a.feature <> b.feature GROUP BY 1, 2", "m"),
        "corr_signed": with_tables(f"SELECT src, dst, {r('least(r, 1::DOUBLE)')} AS weight FROM cosines", "cosines"),
        "corr_epsilon": with_tables(f"SELECT src, dst, {r('CASE WHEN weight < 0.05 THEN 0 ELSE weight END')} AS weight FROM adj", "adj"),
        "heatkernel_adjacency": heat(500, 2),
        "heatkernel_l1": heat(200000, 1),
        "zobs_adjacency": with_tables(f"SELECT src, dst, {r(f'abs((z0 - z1) / sqrt(1::DOUBLE / ({n.format(0)} - 3) + 1::DOUBLE / ({n.format(1)} - 3)))')} AS weight FROM (SELECT d.f1 AS src, d.f2 AS dst, max(CASE WHEN d.label = 0 THEN {z} END) AS z0, max(CASE WHEN d.label = 1 THEN {z} END) AS z1 FROM cd d JOIN cd x ON x.label = d.label AND x.f1 = d.f1 AND x.f2 = d.f1 JOIN cd y ON y.label = d.label AND y.f1 = d.f2 AND y.f2 = d.f2 WHERE d.f1 <> d.f2 GROUP BY 1, 2)", "m", recursive=class_dots),
        "tom_similarity": with_tables(TOM, "adj"),
        "sim2dist": with_tables(f"SELECT src, dst, {r('sqrt(2 * (1 - weight))')} AS weight FROM adj", "adj"),
        "coded_edges_directed": with_tables("SELECT pathway, src, dst, weight FROM net", "net"),
        "coded_edges_undirected": with_tables("SELECT pathway, src, dst, weight FROM und", "und"),
        "degree_centrality": with_tables(f"SELECT n_nationkey AS node, {r('coalesce(sum(weight), 0)')} AS score FROM nation LEFT JOIN flow ON dst = n_nationkey GROUP BY 1", "flow"),
        "clpe_degree_weights": centrality("SELECT * FROM net", "net"),
        "clpe_degree_undirected": centrality("SELECT * FROM und", "und"),
        "clpe_degree_expression": with_tables(expression("cw"), "cw"),
        "clpe_correlation_weights": centrality("SELECT x.pathway, adj.src, adj.dst, adj.weight FROM mem x JOIN mem y USING (pathway) JOIN adj ON adj.src = x.feature AND adj.dst = y.feature", "mem", "adj"),
        "clpe_heatkernel_weights": centrality(HEAT[500], "mem"),
        "pagerank_flow": page_rank("src", "dst", 60),
        "pagerank_in_rank": page_rank("dst", "src", 60),
        "pagerank_stochastic": stochastic_rank(60),
        "clpe_pagerank_weights": group_page_rank(150),
        "eigenvector_centrality": leading_vectors("SELECT 0 AS g, src, dst, weight FROM adj", f"SELECT feature AS node, {r('coalesce(v, 0)')} AS score FROM (SELECT DISTINCT feature FROM m) LEFT JOIN (SELECT * FROM ev WHERE it = 200) ON node = feature", 200, "adj"),
        "clpe_large_evec": leading_vectors(
            "SELECT x.pathway AS g, adj.src, adj.dst, adj.weight FROM mem x JOIN mem y USING (pathway) JOIN adj ON adj.src = x.feature AND adj.dst = y.feature",
            f"SELECT pathway, feature, {r('CASE WHEN sum(v) OVER (PARTITION BY pathway) <> 0 THEN v / sum(v) OVER (PARTITION BY pathway) ELSE v END')} AS weight FROM (SELECT mem.pathway, mem.feature, coalesce(v, 0) AS v FROM mem LEFT JOIN (SELECT * FROM ev WHERE it = 300) ON g = mem.pathway AND node = mem.feature)",
            300, "mem", "adj",
        ),
        "random_graph": f"SELECT src, dst, {r('weight')} AS weight FROM (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, CAST(('0x' || substr(md5(least(a.s_suppkey, b.s_suppkey)::VARCHAR || '-' || greatest(a.s_suppkey, b.s_suppkey)::VARCHAR || '-1'), 1, 8)) AS BIGINT) / 4294967296::DOUBLE AS weight FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey)",
        "pathway_centrality_score": with_tables(f"SELECT pathway, {r(f'sum(CASE WHEN feature IN {SET} THEN weight ELSE 0 END)')} AS score FROM cw GROUP BY 1", "cw"),
        "simple_transform_ranking": with_tables(f"SELECT o.pathway, {r('o.score')} AS score, {r('avg(CASE WHEN o.score < z.score - 1e-12 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS p_val FROM (SELECT pathway, sum(CASE WHEN feature IN {SET} THEN weight ELSE 0 END) AS score FROM w GROUP BY 1) o JOIN (SELECT p.pathway, t.trial, coalesce(sum(w.weight), 0) AS score FROM (SELECT DISTINCT pathway FROM mem) p CROSS JOIN (SELECT DISTINCT trial FROM (VALUES {null_values(list(range(64)), len(SET), 20)}) v(trial, feature)) t LEFT JOIN (VALUES {null_values(list(range(64)), len(SET), 20)}) v(trial, feature) ON v.trial = t.trial LEFT JOIN w ON w.feature = v.feature AND w.pathway = p.pathway GROUP BY ALL) z ON z.pathway = o.pathway GROUP BY ALL", "w"),
        "supra_adjacency": with_tables(f"SELECT src_t, src, dst_t, dst, {r('weight')} AS weight FROM supra", "supra"),
        "supra_heatkernel": with_tables(f"SELECT src_t, src, dst_t, dst, {r('weight')} AS weight FROM hsupra", "ldots", recursive=f"{HEAT_CELLS}, {HEAT_SUPRA}"),
        "supra_scores_degree": with_tables(f"SELECT dst AS node, {r('sum(weight)')} AS score FROM supra GROUP BY 1", "supra"),
        "connected_components": with_tables("SELECT component, count(*) AS nodes FROM (SELECT node, min(r) AS component FROM reach GROUP BY 1) GROUP BY 1", "trade", recursive=f"{graph}, {path}"),
        "supra_scores_pagerank": page_rank("src", "dst", 120, network="supraflow", query=f"SELECT feature AS node, {r('sum(coalesce(v, 0))')} AS score FROM (SELECT DISTINCT t, feature FROM lay) LEFT JOIN (SELECT node, v FROM pr WHERE it = (SELECT max(it) FROM pr)) x ON x.node = t || '/' || feature GROUP BY 1"),
        "cluster_centers": with_tables("SELECT cluster, node FROM cen", "adj", recursive=f"{HALVES}, {CENTERS}"),
        "cluster_center_edges": with_tables(f"SELECT src, dst, {r('weight')} AS weight FROM adj WHERE src IN (SELECT node FROM cen) AND dst IN (SELECT node FROM cen)", "adj", recursive=f"{HALVES}, {CENTERS}"),
        "graph_display_nodes": with_tables(f"SELECT n_nationkey AS node, {r('coalesce(k, 0) / max(coalesce(k, 0)) OVER ()')} AS size FROM nation LEFT JOIN (SELECT dst, sum(weight) AS k FROM flow GROUP BY 1) ON dst = n_nationkey", "flow"),
        "graph_display_edges": with_tables(f"SELECT src, dst, round_even(weight, 2) AS weight FROM adj WHERE weight >= (SELECT median(c) FROM (SELECT weight AS c FROM adj UNION ALL SELECT 0::DOUBLE FROM range(0, CAST({cells} * {cells} - (SELECT count(*) FROM adj) AS BIGINT)))) AND round_even(weight, 2) <> 0", "adj"),
        "er_graph": keyed_pairs(60),
        "metadata_cases": "SELECT c_custkey AS subject, n_name AS nation, c_mktsegment <> 'BUILDING' AS is_case FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "subset_parents_given": given("SELECT rank, parent, size FROM par"),
        "linkage_dumb_given": given('SELECT step, l AS "left", r AS "right", CAST(s1 + s2 AS DOUBLE) AS height, s1 + s2 AS size FROM lk'),
        "linkage_avg_cut_given": given(f'SELECT step, l AS "left", r AS "right", {r("height")} AS height, s1 + s2 AS size FROM lk'),
        "cut_tree_given": given(f"SELECT * FROM {cut(HIGH)}", UP),
        "cut_trees_given": given(f"SELECT item, 2::DOUBLE AS cut, cluster FROM {cut('62')} UNION ALL SELECT item, 6, cluster FROM {cut('58')} UNION ALL SELECT item, 11, cluster FROM {cut(HIGH)}", UP),
        "dendrogram_order_given": given("SELECT CAST(sum(more) AS INT) AS place, item FROM up GROUP BY item", UP),
        "restrict_features": with_tables(f"SELECT subject, feature, {r('value')} AS value FROM m WHERE feature IN (SELECT feature FROM mem WHERE pathway = 7)", "mem"),
        "svm_rates_fixed": f"SELECT {r('avg(share)')} AS bsr FROM (SELECT vec_id % 3 AS guess, avg(CASE WHEN label % 3 = vec_id % 3 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS share FROM embeddings GROUP BY 1)",
    }
