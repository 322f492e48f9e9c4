"""DuckDB statements that give what the registered queries give, written apart from them."""

from __future__ import annotations

_F = "f AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_N = _F + """, n0 AS (SELECT *, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS l FROM f),
n AS (SELECT id, label, list_transform(v, lambda x: x / l) AS v FROM n0)"""
_D = "d AS (SELECT unnest(range(1, 65)) AS i)"


def _knn(name: str, k: int, q: str = "n", g: str = "n", where: str = "true", metric: str = "cos") -> str:
    s = "list_inner_product(a.v, b.v)" if metric == "cos" else "-sqrt(list_aggregate(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum'))"
    return f"""{name} AS (SELECT src, rank, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank
FROM (SELECT a.id AS src, b.id AS dst, {s} AS sim FROM {q} a, {g} b WHERE {where})) WHERE rank <= {k})"""


def _soft(name: str, edges: str, alpha: float) -> str:
    return f"""{name}e AS (SELECT *, exp({alpha} * (sim - max(sim) OVER (PARTITION BY src))) AS e FROM {edges}),
{name} AS (SELECT *, e / sum(e) OVER (PARTITION BY src) AS w FROM {name}e)"""


def _pull(name: str, edges: str, feats: str) -> str:
    """id, i, x: neighbours summed by weight."""
    return f"{name} AS (SELECT src AS id, i, sum(w * v[i]) AS x FROM {edges} JOIN {feats} g ON g.id = dst, d GROUP BY src, i)"


def _mix(name: str, feats: str, pull: str, a: float, b: float) -> str:
    """id, v: a * own + b * pulled, at unit length."""
    return f"""{name}m AS (SELECT p.id, i, {a} * g.v[i] + {b} * p.x AS x FROM {pull} p JOIN {feats} g ON g.id = p.id),
{name}l AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS l FROM {name}m GROUP BY id),
{name} AS (SELECT id, list(x / l ORDER BY i) AS v FROM {name}m JOIN {name}l USING (id) GROUP BY id)"""


_QG = "q AS (SELECT * FROM n WHERE id % 5 = 0), g AS (SELECT * FROM n WHERE id % 5 <> 0)"
_FLAT = "SELECT id, CAST(i - 1 AS INT) AS i, round(v[i], 6) AS x FROM {0}, d"


def _metrics(rank: str, truth: str, ks: list[int], total: str, digits: int = 6) -> str:
    """CTEs from rank(src, dst, rank) and truth(src, dst), to table m(name, k, value)."""
    parts = ["SELECT 'mAP' AS name, 0 AS k, 100 * avg(coalesce(ap, 0) / np) AS value FROM per"]
    cols = []
    for k in ks:
        cols.append(f"sum(CASE WHEN rank <= {k} THEN h / rank ELSE 0 END) AS ap{k}, count(*) FILTER (rank <= {k}) AS n{k}")
        parts += [
            f"SELECT 'mAP', {k}, 100 * avg(coalesce(ap{k}, 0) / np) FROM per",
            f"SELECT 'R', {k}, 100 * avg(coalesce(n{k}, 0) / np) FROM per",
            f"SELECT 'CMC', {k}, 100 * avg(CASE WHEN coalesce(n{k}, 0) > 0 THEN 1.0 ELSE 0 END) FROM per",
        ]
    parts += ["SELECT 'num_valid_queries', 0, count(*) FROM per", f"SELECT 'num_queries_total', 0, ({total})"]
    body = " UNION ALL ".join(parts)
    return f"""hits AS (SELECT r.*, row_number() OVER (PARTITION BY r.src ORDER BY rank) AS h FROM {rank} r JOIN {truth} t ON t.src = r.src AND t.dst = r.dst),
per AS (SELECT * FROM (SELECT src, count(DISTINCT dst) AS np FROM {truth} GROUP BY src) LEFT JOIN (SELECT src, sum(h / rank) AS ap, {', '.join(cols)} FROM hits GROUP BY src) USING (src)),
m AS (SELECT name, CAST(k AS INT) AS k, round(CAST(value AS DOUBLE), {digits}) AS value FROM ({body}))"""


_SELF_RANK = "r AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS rank FROM n a, n b WHERE a.id <> b.id)"
_SELF_TRUTH = "t AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.label = b.label WHERE a.id <> b.id)"


def _cross_rank(q: str = "q", g: str = "g", name: str = "r") -> str:
    return f"{name} AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS rank FROM {q} a, {g} b)"


_CROSS_TRUTH = "t AS (SELECT a.id AS src, b.id AS dst FROM q a JOIN g b ON a.label = b.label)"
_GRADED = """t AS (SELECT a.id AS src, b.id AS dst, CASE WHEN (a.id + b.id) % 11 = 0 THEN 'junk' WHEN a.id % 3 = 0 THEN 'easy' ELSE 'hard' END AS grade FROM n a JOIN n b ON a.label = b.label WHERE a.id <> b.id)"""


_OLD = "CASE WHEN grade = 'junk' THEN 'junk' ELSE 'ok' END"


def _junk_map(name: str, case: str) -> str:
    """CTEs ending in {name}(src, n_pos, ap, p1, p5, p10)."""
    cut = lambda k: f"least(last, {k})"
    ps = ", ".join(f"sum(CASE WHEN rr + 1 <= {cut(k)} THEN 1.0 ELSE 0 END / {cut(k)}) AS p{k}" for k in (1, 5, 10))
    return f"""{name}g AS (SELECT src, dst, {case} AS gr FROM t),
{name}r AS (SELECT r.src, r.dst, gr, rank - 1 - sum(CASE WHEN gr = 'junk' THEN 1 ELSE 0 END) OVER (PARTITION BY r.src ORDER BY rank) AS rr FROM r JOIN {name}g g ON g.src = r.src AND g.dst = r.dst),
{name}o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rr) - 1 AS j, max(rr) OVER (PARTITION BY src) + 1 AS last FROM {name}r WHERE gr = 'ok'),
{name}s AS (SELECT src, count(DISTINCT dst) AS n_pos FROM {name}g WHERE gr = 'ok' GROUP BY src),
{name} AS (SELECT src, n_pos, sum(((CASE WHEN rr = 0 THEN 1.0 ELSE j / rr END) + (j + 1) / (rr + 1)) / (2 * n_pos)) AS ap, {ps} FROM {name}o JOIN {name}s USING (src) GROUP BY src, n_pos)"""


_NODES = _N + ", nodes AS (SELECT CAST(label AS BIGINT) AS scene, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS BIGINT) AS idx, id, v FROM n)"
_PAIRS = _NODES + ", sp AS (SELECT a.scene, a.idx AS u, b.idx AS v, list_inner_product(a.v, b.v) AS w FROM nodes a JOIN nodes b ON a.scene = b.scene AND a.idx < b.idx)"
_EDGES = _PAIRS + """, raw AS (SELECT * FROM sp WHERE w >= 0.05), c AS (SELECT scene, u, v, least(greatest(w, 0.0), 1.0) AS w FROM raw),
e AS (SELECT * FROM c UNION ALL SELECT scene, v, u, w FROM c)"""
_LOSS = _PAIRS + """, one AS (SELECT scene AS sample, u AS i, v AS j, least(greatest(3 * w, 0.0), 1.0) AS ov, w AS sim FROM sp),
p AS (SELECT * FROM one UNION ALL SELECT sample, j, i, ov, sim FROM one)"""


def _hash(x: str, seed: int) -> str:
    return f"((({x}) + {seed}) * 2654435761) % 4294967296"


def _sample(n: int, seed: int) -> str:
    return f"SELECT scene, idx FROM (SELECT scene, idx, row_number() OVER (PARTITION BY scene ORDER BY {_hash('idx', seed)}, idx) AS r FROM nodes) WHERE r <= {n}"


_LOCAL = _F + """, lo AS (SELECT CAST(label AS BIGINT) AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS INT) AS pos, v FROM f)"""
_LOCAL_UNIT = _N + ", lo AS (SELECT CAST(label AS BIGINT) AS image_id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, v FROM n)"


def _assigned(n: int, bias: bool = True) -> str:
    b = " - 4.0 * list_inner_product(c.v, c.v)" if bias else ""
    return _LOCAL_UNIT + f""", ce AS (SELECT id AS k, v FROM f WHERE id < {n}),
lg AS (SELECT image_id, pos, lo.v, k, c.v AS c, 8.0 * list_inner_product(lo.v, c.v){b} AS z FROM lo, ce c),
ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY image_id, pos)) AS x FROM lg),
asg AS (SELECT image_id, pos, v, k, c, x / sum(x) OVER (PARTITION BY image_id, pos) AS a FROM ex)"""


def _vlad(subtract: bool) -> str:
    r = "v[i] - c[i]" if subtract else "v[i]"
    return f""", {_D}, s AS (SELECT image_id, k, i, sum(a * ({r})) AS x FROM asg, d WHERE k < 8 GROUP BY image_id, k, i),
l AS (SELECT image_id, k, greatest(sqrt(sum(x * x)), 1e-12) AS l FROM s GROUP BY image_id, k)
SELECT image_id, CAST(k * 64 + i - 1 AS INT) AS i, round(x / l, 6) AS x FROM s JOIN l USING (image_id, k)"""


def _gem(local: str, keys: str, p: str = "3.0", f: str = "abs(v[i]) + 1e-6") -> str:
    return f"SELECT {keys}, i, pow(avg(pow({f}, {p})), 1 / {p}) AS x FROM {local}, d GROUP BY {keys}, i"


def _propagate(name: str, a: str, edges: str, k2: int) -> str:
    return f"""{name}b AS (SELECT i, f, sum(w) AS w FROM (SELECT i, f, w FROM {a} UNION ALL SELECT f, i, w FROM {a}) GROUP BY i, f),
{name}m AS (SELECT src AS i, f, sum(sim * sim * w) AS w FROM {edges} JOIN {name}b ON {name}b.i = dst WHERE rank <= {k2} GROUP BY src, f),
{name}l AS (SELECT i, greatest(sqrt(sum(w * w)), 1e-12) AS l FROM {name}m GROUP BY i),
{name} AS (SELECT i, f, w / l AS w FROM {name}m JOIN {name}l USING (i))"""


_RUNS = """e AS (SELECT event_id, user_id, ts, event_type AS scene, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
runs AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM scene THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM e)"""
_VIEWS = _F + ", vw AS (SELECT id, CASE id % 3 WHEN 0 THEN 'satellite' WHEN 1 THEN 'drone' ELSE 'street' END AS view, CAST(label AS BIGINT) AS cls FROM f)"
_URLS = "u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"
_PER_IMAGE = _LOCAL + f", {_D}, sc AS (SELECT image_id, pos, CAST(i - 1 AS INT) AS head, v[i] AS x FROM lo, d)"
_MATCH = ", mp AS (SELECT src, rank, least('img_' || src, 'img_' || dst) AS name_a, greatest('img_' || src, 'img_' || dst) AS name_b FROM k WHERE src <> dst)"

_DFS = ", ".join([_N, _D, _knn("k", 10), _soft("w0", "k", 5.0), _pull("p1", "w0", "n"), _mix("x1", "n", "p1", 0.2, 0.8), _pull("p2", "w0", "x1"), _mix("x2", "x1", "p2", 0.2, 0.8)])
_KRNN = ", ".join(
    [
        _N, _D, _knn("o", 12, where="a.id <> b.id"),
        "k AS (SELECT id AS src, 1 AS rank, id AS dst, 1.0::DOUBLE AS sim FROM n UNION ALL SELECT src, rank + 1, dst, sim FROM o)",
        "rk AS (SELECT a.* FROM k a WHERE EXISTS (SELECT 1 FROM k b WHERE b.src = a.dst AND b.dst = a.src))",
        _soft("w0", "rk", 0.5), _pull("p1", "w0", "n"), "x1 AS (SELECT id, list(x ORDER BY i) AS v FROM p1 GROUP BY id)",
        "w1 AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM k WHERE rank <= 5)", _pull("p2", "w1", "x1"), _mix("x2", "n", "p2", 1.0, 1.0),
    ]
)
_AQE = ", ".join([_N, _D, _QG, _knn("k", 10, "q", "g"), _soft("w0", "k", 10.0), _pull("p1", "w0", "g"), _mix("x1", "q", "p1", 1.0, 1.0)])
_LSE = "SELECT sample, i, max({z}) + ln(sum(exp({z} - mz))) AS lse FROM (SELECT *, max({z}) OVER (PARTITION BY sample, i) AS mz FROM {t}) GROUP BY sample, i"


def _supcon(weight: str) -> str:
    return f"""WITH {_LOSS}, z AS (SELECT *, sim / 0.1 AS z, max(sim / 0.1) OVER (PARTITION BY sample, i) AS mz FROM p),
l AS (SELECT sample, i, max(mz) + ln(sum(exp(z - mz))) AS lse FROM z GROUP BY sample, i),
a AS (SELECT sample, i, sum(CASE WHEN ov >= 0.25 THEN {weight} * (z - lse) ELSE 0 END) AS s, sum(CASE WHEN ov >= 0.25 THEN {weight} ELSE 0 END) AS w, count(*) FILTER (ov >= 0.25) AS c FROM z JOIN l USING (sample, i) GROUP BY sample, i)
SELECT round(coalesce(avg(-s / (w + 1e-8)), 0), 6) AS loss FROM a WHERE c > 0"""


_MS = """pl AS (SELECT sample, i, m + ln(sum(exp(z - m)) + exp(-m)) AS lp FROM (SELECT sample, i, 2.0 * (0.5 - sim) AS z, greatest(max(2.0 * (0.5 - sim)) OVER (PARTITION BY sample, i), 0) AS m FROM p WHERE ov >= 0.25) GROUP BY sample, i, m),
nl AS (SELECT sample, i, m + ln(sum(exp(z - m)) + exp(-m)) AS ln_ FROM (SELECT sample, i, 50.0 * (sim - 0.5) AS z, greatest(max(50.0 * (sim - 0.5)) OVER (PARTITION BY sample, i), 0) AS m FROM p WHERE ov < 0.25) GROUP BY sample, i, m),
ms AS (SELECT coalesce(avg(lp / 2.0 + ln_ / 50.0), 0) AS x FROM pl JOIN nl USING (sample, i))"""
_RK = "rk AS (SELECT 10.0 * coalesce(avg(greatest(0.0, 0.05 - (a.sim - b.sim))), 0) AS x FROM p a JOIN p b ON a.sample = b.sample AND a.i = b.i WHERE a.ov - b.ov > 0.05)"
_BATCH = _N + """, b AS (SELECT a.id AS i, o.id AS j, list_inner_product(a.v, o.v) AS s, a.label = o.label AS pos FROM n a JOIN n o ON a.id // 256 = o.id // 256 AND a.id <> o.id),
e AS (SELECT *, sqrt(greatest(2 - 2 * s, 0)) AS d FROM b)"""


def _one(x: str, where: str = "true") -> str:
    return f"SELECT round(coalesce({x}, 0), 6) AS loss FROM per WHERE {where}"


def _sums(z: str, name: str, of: str) -> str:
    """Log-sum-exp of z by anchor."""
    return f"{name} AS (SELECT i, m + ln(sum(exp({z} - m))) AS {name} FROM (SELECT *, max({z}) OVER (PARTITION BY i) AS m FROM e WHERE {of}) GROUP BY i, m)"


_PATCH = _LOCAL.replace("lo AS (", "lo0 AS (") + ", lo AS (SELECT * FROM lo0 WHERE pos > 0)"


def _unit_rows(body: str, digits: int = 6) -> str:
    """image_id, i (from 1) and x of ``body``, each image at unit length."""
    return f"SELECT image_id, CAST(i - 1 AS INT) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY image_id)), 1e-12), {digits}) AS x FROM ({body})"


def _head(a: int, b: int, p: str, eps: str) -> str:
    unit = _LOCAL_UNIT.replace("lo AS (", "lo0 AS (") + ", lo AS (SELECT * FROM lo0 WHERE pos > 0)"
    ge = _gem("lo", "image_id", p, f"greatest(v[i], {eps})")
    return f"WITH {unit}, {_D}, ge AS ({ge}) " + _unit_rows(f"SELECT image_id, o + 1 AS i, sum(x * ((o * {a} + (i - 1) * {b}) % 13 - 6) / 20.0) AS x FROM ge, (SELECT unnest(range(0, 8)) AS o) GROUP BY image_id, o")


def _patch_vlad(n: int) -> str:
    rows = _assigned(n).replace("lo AS (", "lo0 AS (").replace(", ce AS (", ", lo AS (SELECT * FROM lo0 WHERE pos > 0), ce AS (")
    return f"WITH {rows}" + _vlad(True).replace("round(x / l, 6)", "round(x / l / sqrt(8.0), 6)")


def _sinkhorn(rounds: int) -> str:
    """CTEs to tp(image_id, pos, k, p) from sc(image_id, pos, k, s), four clusters and the dust bin as the fifth."""
    out = """nn AS (SELECT image_id, count(*) AS n FROM pl GROUP BY image_id),
s5 AS (SELECT image_id, pos, k, s FROM sc UNION ALL SELECT image_id, pos, 4, 1.0 FROM pl),
b0 AS (SELECT image_id, pos, 0.0 AS v FROM pl)"""
    for r in range(1, rounds + 1):
        out += f""",
a{r} AS (SELECT image_id, k, -ln(max(n) + 4) + CASE WHEN k = 4 THEN ln(max(n) - 4) ELSE 0 END - (max(m) + ln(sum(exp(z - m)))) AS u FROM (SELECT image_id, k, s + v AS z, max(s + v) OVER (PARTITION BY image_id, k) AS m FROM s5 JOIN b{r - 1} USING (image_id, pos)) JOIN nn USING (image_id) GROUP BY image_id, k),
b{r} AS (SELECT image_id, pos, -ln(max(n) + 4) - (max(m) + ln(sum(exp(z - m)))) AS v FROM (SELECT image_id, pos, s + u AS z, max(s + u) OVER (PARTITION BY image_id, pos) AS m FROM s5 JOIN a{r} USING (image_id, k)) JOIN nn USING (image_id) GROUP BY image_id, pos)"""
    return out + f""",
tp AS (SELECT image_id, pos, k, exp(s + u + v + ln(n + 4)) AS p FROM s5 JOIN a{rounds} USING (image_id, k) JOIN b{rounds} USING (image_id, pos) JOIN nn USING (image_id) WHERE k < 4)"""


def _lloyd(rounds: int) -> str:
    """CTEs from n to c{rounds}(k, v)."""
    out = f"c0 AS (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY {_hash('id', 42)}, id) - 1 AS k, v FROM n) WHERE k < 8)"
    for r in range(1, rounds + 1):
        dist = "list_aggregate(list_transform(list_zip(n.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')"
        out += f""", m{r} AS (SELECT id, v, k FROM (SELECT n.id, n.v, c.k, row_number() OVER (PARTITION BY n.id ORDER BY {dist}, c.k) AS r FROM n, c{r - 1} c) WHERE r = 1),
e{r} AS (SELECT k, i, avg(v[i]) AS x FROM m{r}, d GROUP BY k, i), f{r} AS (SELECT k, list(x ORDER BY i) AS v FROM e{r} GROUP BY k), c{r} AS (SELECT k, coalesce(f.v, c.v) AS v FROM c{r - 1} c LEFT JOIN f{r} f USING (k))"""
    return out


def _w(o: str, i: str, a: int, b: int) -> str:
    return f"((({o}) * {a} + ({i}) * {b}) % 13 - 6) / 20.0"


_CLASSES = """c AS (SELECT label, v FROM n WHERE id < 160), x AS (SELECT n.id AS i, n.label AS own, c.label, list_inner_product(n.v, c.v) AS s FROM n, c),
w AS (SELECT *, exp(s / 0.1 - max(s / 0.1) OVER (PARTITION BY i, label)) AS w FROM x), k AS (SELECT i, own, label, 20 * (sum(w * s) / sum(w) - CASE WHEN own = label THEN 0.01 ELSE 0 END) AS z FROM w GROUP BY i, own, label),
per AS (SELECT i, ln(sum(exp(z))) - max(CASE WHEN own = label THEN z END) AS x FROM k GROUP BY i)"""
_REV = " UNION ALL ".join(
    f"SELECT '{n}' AS protocol, round_even(100 * avg(ap), 2) AS map, round_even(100 * avg(p1), 2) AS mp1, round_even(100 * avg(p5), 2) AS mp5, round_even(100 * avg(p10), 2) AS mp10 FROM {n}" for n in "EMH"
)

ORACLE_SQL: dict[str, str] = {
    "knn_cosine_self": f"WITH {_N}, {_knn('k', 10)} SELECT src, CAST(rank AS INT) AS rank, dst, round(sim, 6) AS sim FROM k",
    "knn_l2_cross": f"WITH {_F}, q AS (SELECT * FROM f WHERE id % 5 = 0), g AS (SELECT * FROM f WHERE id % 5 <> 0), {_knn('k', 10, 'q', 'g', metric='l2')} SELECT src, CAST(rank AS INT) AS rank, dst, round(-sim, 6) AS distance FROM k",
    "knn_topk_single": f"WITH {_N}, {_knn('k', 20, where='a.id = 7 AND b.id <> 7')} SELECT src, CAST(rank AS INT) AS rank, dst, round(sim, 6) AS sim, a.label = b.label AS is_pos FROM k JOIN n a ON a.id = src JOIN n b ON b.id = dst",
    "neighbour_label_edges": f"WITH {_N}, {_knn('k', 10, where='a.id <> b.id')} SELECT src, CAST(rank AS INT) AS rank, dst, a.label = b.label AS is_pos FROM k JOIN n a ON a.id = src JOIN n b ON b.id = dst",
    "reciprocal_edges": f"WITH {_N}, {_knn('k', 10, where='a.id <> b.id')} SELECT a.src, CAST(a.rank AS INT) AS rank, a.dst FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src",
    "neighbour_sequence": f"WITH {_N}, {_knn('k', 5, where='a.id <> b.id')} SELECT src, src || ',' || string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rank) AS ids, CAST(count(*) + 1 AS INT) AS n FROM k GROUP BY src",
    "retrieval_metrics_self": f"WITH {_N}, {_SELF_RANK}, {_SELF_TRUTH}, {_metrics('r', 't', [1, 25, 50, 100], 'SELECT count(*) FROM n')} SELECT * FROM m",
    "retrieval_metrics_cross": f"WITH {_N}, {_QG}, {_cross_rank()}, {_CROSS_TRUTH}, {_metrics('r', 't', [1, 5, 10], 'SELECT count(*) FROM q')} SELECT * FROM m",
    "metrics_display": f"WITH {_N}, {_QG}, {_cross_rank()}, {_CROSS_TRUTH}, {_metrics('r', 't', [1, 5, 10], 'SELECT count(*) FROM q')} SELECT * FROM m WHERE name IN ('mAP', 'CMC')",
    "map_junk": f"WITH {_N}, {_SELF_RANK}, {_GRADED}, {_junk_map('j', chr(67) + 'ASE WHEN grade = ' + repr('junk') + ' THEN ' + repr('junk') + ' ELSE ' + repr('ok') + ' END')} SELECT src, n_pos, round(ap, 6) AS ap, round(p1, 6) AS p1, round(p5, 6) AS p5, round(p10, 6) AS p10 FROM j",
    "map_revisited": "WITH " + ", ".join([
        _N, _SELF_RANK, _GRADED,
        _junk_map("E", "CASE WHEN grade = 'easy' THEN 'ok' ELSE 'junk' END"),
        _junk_map("M", "CASE WHEN grade = 'junk' THEN 'junk' ELSE 'ok' END"),
        _junk_map("H", "CASE WHEN grade = 'hard' THEN 'ok' ELSE 'junk' END"),
    ]) + " " + _REV,
    "cmc_camera": f"""WITH {_N}, q AS (SELECT *, id % 4 AS cam FROM n WHERE id % 5 = 0), g AS (SELECT *, id % 4 AS cam FROM n WHERE id % 5 <> 0 AND label <> 9),
kept AS (SELECT a.id AS src, b.id AS dst, a.label = b.label AS good, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) - 1 AS r FROM q a, g b WHERE NOT (a.label = b.label AND a.cam = b.cam)),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY r) - 1 AS j, count(*) OVER (PARTITION BY src) AS np FROM kept WHERE good),
per AS (SELECT src, min(r) AS first, sum(((CASE WHEN r = 0 THEN 1.0 ELSE j / r END) + (j + 1) / (r + 1)) / (2 * np)) AS ap FROM o GROUP BY src), nq AS (SELECT count(*) AS n FROM q)
SELECT round(sum(ap) / max(n), 6) AS map, round(count(*) FILTER (first < 1) / max(n), 6) AS cmc1, round(count(*) FILTER (first < 5) / max(n), 6) AS cmc5, round(count(*) FILTER (first < 10) / max(n), 6) AS cmc10, count(*) AS n_scored FROM per, nq""",
    "dataset_summary": "SELECT count(*) AS n_images, count(DISTINCT label) AS n_scenes, count(*) FILTER (vec_id % 5 = 0) AS n_queries, count(*) FILTER (vec_id % 5 <> 0) AS n_references FROM embeddings",
    "component_stats": f"WITH {_F}, {_D} SELECT CAST(i - 1 AS INT) AS i, round(avg(v[i]), 6) AS mean, round(stddev_pop(v[i]), 6) AS std, round(min(v[i]), 6) AS low, round(max(v[i]), 6) AS high FROM f, d GROUP BY i",
    "rerank_aqe": f"WITH {_AQE} {_FLAT.format('x1')}",
    "rerank_dba": "WITH " + ", ".join([_N, _D, _QG, _knn("k", 10, "g", "g", "a.id <> b.id"), _soft("w0", "k", 3.0), _pull("p1", "w0", "g"), _mix("x1", "g", "p1", 1.0, 0.3)]) + " " + _FLAT.format("x1"),
    "rerank_dfs": f"WITH {_DFS} {_FLAT.format('x2')}",
    "rerank_krnn": f"WITH {_KRNN} {_FLAT.format('x2')}",
    "rerank_gnn": "WITH " + ", ".join([_N, _knn("k", 10), "a0 AS (SELECT src AS i, dst AS f, 1.0::DOUBLE AS w FROM k)", _propagate("a1", "a0", "k", 3), _propagate("a2", "a1", "k", 3)]) + " SELECT i, f, round(w, 6) AS w FROM a2",
    "rerank_gnn_similarity": "WITH " + ", ".join([_N, _knn("k", 5), "a0 AS (SELECT src AS i, dst AS f, 1.0::DOUBLE AS w FROM k)", _propagate("a1", "a0", "k", 2), _propagate("a2", "a1", "k", 2)]) + " SELECT a.i AS src, b.i AS dst, round(sum(a.w * b.w), 6) AS sim FROM a2 a JOIN a2 b ON a.f = b.f WHERE a.i % 5 = 0 AND b.i % 5 <> 0 GROUP BY a.i, b.i",
    "rerank_aqe_metrics": f"WITH {_AQE}, {_cross_rank('x1', 'g')}, {_CROSS_TRUTH}, {_metrics('r', 't', [1, 5, 10], 'SELECT count(*) FROM q', 4)} SELECT * FROM m",
    "gnn_adjacency": f"WITH {_N}, {_knn('k', 5)} SELECT src AS i, dst AS f, 1.0::DOUBLE AS w FROM k",
    "gnn_ranking": "WITH " + ", ".join([_N, _knn("k", 5), "a0 AS (SELECT src AS i, dst AS f, 1.0::DOUBLE AS w FROM k)", _propagate("a1", "a0", "k", 2), _propagate("a2", "a1", "k", 2)]) + """, s AS (SELECT a.i AS src, b.i AS dst, sum(a.w * b.w) AS sim FROM a2 a JOIN a2 b ON a.f = b.f WHERE a.i % 5 = 0 AND b.i % 5 <> 0 GROUP BY a.i, b.i)
SELECT * FROM (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS INT) AS rank, dst, round(sim, 6) AS sim FROM s) WHERE rank <= 5""",
    "mine_multi_similarity": f"""WITH {_LOSS}, m AS (SELECT *, ov >= 0.25 AS is_pos, min(CASE WHEN ov >= 0.25 THEN sim END) OVER w AS low, max(CASE WHEN ov < 0.25 THEN sim END) OVER w AS high FROM p WINDOW w AS (PARTITION BY sample, i))
SELECT sample, i, j, is_pos FROM m WHERE CASE WHEN is_pos THEN sim < high + 0.1 ELSE sim > low - 0.1 END""",
    "mine_pair_margin": f"WITH {_LOSS}, m AS (SELECT *, ov >= 0.25 AS is_pos, sqrt(greatest(2 - 2 * sim, 0.0)) AS d FROM p) SELECT sample, i, j, is_pos FROM m WHERE CASE WHEN is_pos THEN d > 1.3 ELSE d < 1.3 END",
    "mine_semihard": f"""WITH {_LOSS}, m AS (SELECT *, ov >= 0.25 AS is_pos, sqrt(greatest(2 - 2 * sim, 0.0)) AS d FROM p)
SELECT a.sample, a.i, count(*) AS n, min(a.j) AS least_j, max(b.j) AS most_l FROM m a JOIN m b ON a.sample = b.sample AND a.i = b.i WHERE a.is_pos AND NOT b.is_pos AND b.d - a.d > 0 AND b.d - a.d <= 0.1 GROUP BY a.sample, a.i""",
    "map_old": f"WITH {_N}, {_SELF_RANK}, {_GRADED}, {_junk_map('j', _OLD)} SELECT round(100 * avg(ap), 2) AS map FROM j",
    "attention_mass_combined": f"WITH {_PER_IMAGE}, h AS (SELECT pos, sum(abs(x)) AS x FROM sc GROUP BY pos) SELECT pos, sum(x) OVER (ORDER BY x, pos ROWS UNBOUNDED PRECEDING) / sum(x) OVER () > 0.5 AS kept FROM h",
    "usable_scenes": f"""WITH {_PAIRS}, raw AS (SELECT scene, u, CASE WHEN scene % 4 = 0 AND u = 0 THEN 100000 ELSE v END AS v FROM sp WHERE w >= 0.05),
z AS (SELECT scene, count(*) AS n FROM nodes GROUP BY scene), t AS (SELECT scene, max(greatest(u, v)) AS top FROM raw GROUP BY scene)
SELECT scene, n, CASE WHEN n < 3 THEN 'too few images' WHEN top >= n THEN 'edge to no image' ELSE 'ok' END AS status FROM z LEFT JOIN t USING (scene)""",
    "parameter_keys": f"""WITH {_F} SELECT id, CASE id % 4 WHEN 0 THEN 'backbone.net.layer.' WHEN 1 THEN 'backbone.net.layer.' WHEN 2 THEN 'head.' ELSE 'backbone.net.' END || id AS key FROM f""",
    "metrics_by_task": "WITH " + ", ".join([_N, _QG, _cross_rank(), _CROSS_TRUTH, _metrics('r', 't', [1, 5], 'SELECT count(*) FROM q', 12).replace('m AS (', 'm1 AS ('),
        "hq0 AS (SELECT id, v[1:32] AS v FROM q), hg0 AS (SELECT id, v[1:32] AS v FROM g)", *[f"h{s} AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM h{s}0)" for s in "qg"], _cross_rank("hq", "hg", "r2"),
        _metrics('r2', 't', [1, 5], 'SELECT count(*) FROM q', 12).replace('m AS (', 'm2 AS (').replace('hits', 'hits2').replace('per', 'per2').replace('m AS (', 'm2 AS (')]) + " SELECT 'cross' AS task, name, k, round(avg(value), 6) AS value FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY name, k",
    "triplet_sample": f"""WITH {_EDGES}, near AS (SELECT DISTINCT scene, u AS anchor, v AS idx FROM e WHERE w >= 0.2), sz AS (SELECT scene, count(*) AS n FROM nodes GROUP BY scene),
an AS (SELECT scene, anchor, np FROM (SELECT scene, anchor, count(*) AS np FROM near GROUP BY scene, anchor) JOIN sz USING (scene) WHERE n >= 3 AND n - 1 - np >= 1),
lp AS (SELECT scene, anchor, idx, np, row_number() OVER (PARTITION BY scene, anchor ORDER BY {_hash('idx + anchor * 31', 4)}, idx) - 1 AS r FROM near JOIN an USING (scene, anchor)),
lq AS (SELECT a.scene, a.anchor, b.idx, row_number() OVER (PARTITION BY a.scene, a.anchor ORDER BY {_hash('b.idx + a.anchor * 31', 4)}, b.idx) - 1 AS slot FROM an a JOIN nodes b ON b.scene = a.scene AND b.idx <> a.anchor
WHERE NOT EXISTS (SELECT 1 FROM near p WHERE p.scene = a.scene AND p.anchor = a.anchor AND p.idx = b.idx))
SELECT scene, anchor, 'positive' AS kind, CAST(slot AS INT) AS slot, idx FROM lp JOIN (SELECT unnest([0, 1]) AS slot) ON r = {_hash('anchor + slot * 977', 4)} % np
UNION ALL SELECT scene, anchor, 'negative', CAST(slot AS INT), idx FROM lq WHERE slot < 2""",
    "multi_view_sample": f"""WITH {_VIEWS}, l AS (SELECT cls, view, id, row_number() OVER (PARTITION BY cls, view ORDER BY {_hash('id', 6)}, id) - 1 AS r, count(*) OVER (PARTITION BY cls, view) AS n FROM vw),
pl AS (SELECT DISTINCT cls, s.view, s.slot FROM vw, (VALUES ('satellite', 0), ('drone', 0), ('drone', 1), ('street', 0), ('street', 1)) s(view, slot) WHERE vw.view = 'satellite')
SELECT pl.cls, pl.view, pl.slot, l.id FROM pl LEFT JOIN l ON l.cls = pl.cls AND l.view = pl.view AND l.r = {_hash('pl.cls * 7 + pl.slot', 6)} % l.n""",
    "overlap_symmetrize": f"WITH {_EDGES} SELECT scene, u, v, round(w, 6) AS w FROM e",
    "neighbor_lists": f"WITH {_EDGES} SELECT n.scene, n.idx, coalesce(string_agg(CAST(x.v AS VARCHAR), ',' ORDER BY x.v), '') AS neighbors FROM nodes n LEFT JOIN (SELECT DISTINCT scene, u, v FROM e WHERE w >= 0.15) x ON x.scene = n.scene AND x.u = n.idx GROUP BY n.scene, n.idx",
    "uniform_sample": f"WITH {_NODES} {_sample(12, 3)}",
    "subgraph_overlap": f"""WITH {_EDGES}, s AS ({_sample(12, 3)}), a AS (SELECT scene, idx, row_number() OVER (PARTITION BY scene ORDER BY idx) - 1 AS nr FROM s)
SELECT e.scene, a.nr AS i, b.nr AS j, round(e.w, 6) AS w FROM e JOIN a ON a.scene = e.scene AND a.idx = e.u JOIN a b ON b.scene = e.scene AND b.idx = e.v UNION ALL SELECT scene, nr, nr, 1.0 FROM a""",
    "fetch_nodes": f"WITH {_EDGES}, s AS ({_sample(1, 5)}) SELECT s.scene, s.idx AS u, n.idx AS v, round(coalesce(e.w, 0), 6) AS w FROM s JOIN nodes n ON n.scene = s.scene AND n.idx <> s.idx LEFT JOIN e ON e.scene = s.scene AND e.u = s.idx AND e.v = n.idx",
    "anchor_eligibility": f"""WITH {_EDGES}, p AS (SELECT scene, u AS idx, count(DISTINCT v) AS n_pos FROM e WHERE w >= 0.2 GROUP BY scene, u), z AS (SELECT scene, count(*) AS n FROM nodes GROUP BY scene)
SELECT scene, idx, n_pos, n, n - 1 - n_pos AS n_neg FROM p JOIN z USING (scene) WHERE n >= 3 AND n_pos >= 1 AND n - 1 - n_pos >= 1""",
    "positive_ratio": f"WITH {_PAIRS} SELECT scene, round(avg(CASE WHEN w >= 0.1 THEN 1.0 ELSE 0 END), 6) AS ratio FROM sp GROUP BY scene",
    "min_scene_size": f"WITH {_NODES} SELECT scene, idx FROM nodes WHERE scene IN (SELECT scene FROM nodes GROUP BY scene HAVING count(*) >= 50)",
    "epoch_plan": f"""WITH {_NODES}, z AS (SELECT scene, CASE WHEN count(*) <= 16 THEN 1 ELSE least(greatest(ceil(1.5 * sqrt(count(*) / 16.0)), 1), 8) END AS s FROM nodes GROUP BY scene),
t AS (SELECT scene, sample FROM z, (SELECT unnest(range(1, 9)) AS sample) WHERE sample <= s)
SELECT scene, CAST(sample AS INT) AS sample, row_number() OVER (ORDER BY {_hash('scene * 8 + sample', 1)}, scene, sample) - 1 AS position FROM t""",
    "tiled_plan": f"WITH {_NODES}, s AS (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS nr, count(*) OVER () AS n FROM (SELECT DISTINCT scene FROM nodes)) SELECT turn * n + nr AS position, scene FROM s, (SELECT unnest(range(0, 37)) AS turn) WHERE turn * n + nr < 37",
    "anchor_expand": f"""WITH {_EDGES}, s AS ({_sample(1, 5)}), x AS (SELECT DISTINCT scene, u, v FROM e WHERE w >= 0.1),
o AS (SELECT scene, u, v FROM (SELECT *, row_number() OVER (PARTITION BY scene, u ORDER BY {_hash('v', 2)}, v) AS r FROM x) WHERE r <= 4),
h0 AS (SELECT scene, idx, 0 AS hop FROM s),
h1 AS (SELECT DISTINCT o.scene, o.v AS idx, 1 AS hop FROM o JOIN h0 ON o.scene = h0.scene AND o.u = h0.idx WHERE (o.scene, o.v) NOT IN (SELECT scene, idx FROM h0)),
h2 AS (SELECT DISTINCT o.scene, o.v AS idx, 2 AS hop FROM o JOIN h1 ON o.scene = h1.scene AND o.u = h1.idx WHERE (o.scene, o.v) NOT IN (SELECT scene, idx FROM h0 UNION ALL SELECT scene, idx FROM h1)),
seen AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
alls AS (SELECT * FROM seen UNION ALL SELECT scene, idx, -1 FROM nodes WHERE (scene, idx) NOT IN (SELECT scene, idx FROM seen))
SELECT scene, idx, hop FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY hop < 0, hop, {_hash('idx', 2)}, idx) AS r FROM alls) WHERE r <= 16""",
    "collate_labels": f"WITH {_NODES} SELECT scene AS sample, idx AS slot, CASE WHEN idx = max(idx) OVER (PARTITION BY scene) THEN -1 - scene ELSE scene END AS label FROM nodes",
    "scene_runs": f"WITH {_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, min(scene) AS scene, count(*) AS n FROM runs GROUP BY user_id, run",
    "scene_batches": f"""WITH {_RUNS}, b AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 2 AS batch FROM runs)
SELECT event_id, user_id, CAST(run AS BIGINT) AS run, batch FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run, batch) AS c FROM b) WHERE c = 2""",
    "inverted_index": "SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS positions FROM embeddings GROUP BY label",
    "order_check": "SELECT count(*) FILTER (vec_id % 10 = 3) AS mismatches FROM embeddings",
    "gather_dedup": "SELECT vec_id // 3 AS index, min(vec_id) AS id, arg_min(label, vec_id) AS label FROM embeddings GROUP BY vec_id // 3",
    "cross_view_pairs": f"WITH {_VIEWS} SELECT id, cls FROM vw WHERE view = 'drone' AND cls IN (SELECT cls FROM vw WHERE view = 'satellite' AND cls <> 4)",
    "multi_view_collate": f"WITH {_VIEWS} SELECT cls, id FROM vw WHERE id % 4 <> 1",
    "match_pairs": f"WITH {_N}, {_knn('k', 6)}{_MATCH} SELECT DISTINCT name_a, name_b FROM mp",
    "match_pairs_capped": f"""WITH {_N}, {_knn('k', 9)}{_MATCH}, own AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank) AS c FROM mp)
SELECT DISTINCT name_a, name_b FROM own WHERE c <= 3""",
    "pool_avg": f"WITH {_LOCAL}, {_D} SELECT image_id, CAST(i - 1 AS INT) AS i, round(avg(v[i]), 6) AS x FROM lo, d GROUP BY image_id, i",
    "pool_cls": f"WITH {_LOCAL}, {_D} SELECT image_id, CAST(i - 1 AS INT) AS i, round(v[i], 6) AS x FROM lo, d WHERE pos = 0",
    "pool_gem": f"WITH {_LOCAL}, {_D} SELECT image_id, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM ({_gem('lo', 'image_id')})",
    "pool_cosplace": f"""WITH {_LOCAL_UNIT}, {_D}, ge AS ({_gem('lo', 'image_id', f='greatest(v[i], 1e-6)')}),
p AS (SELECT image_id, o, sum(x * ((o * 7 + (i - 1) * 3) % 11 - 5) / 10.0) AS y FROM ge, (SELECT unnest(range(0, 8)) AS o) GROUP BY image_id, o)
SELECT image_id, CAST(o AS INT) AS i, round(y / greatest(sqrt(sum(y * y) OVER (PARTITION BY image_id)), 1e-12), 6) AS x FROM p""",
    "pool_grid": f"""WITH {_LOCAL}, {_D}, ce AS (SELECT image_id, v, CASE WHEN pos % 8 < 3 THEN 0 WHEN pos % 8 < 5 THEN 1 ELSE 2 END AS cell_x, CASE WHEN (pos // 8) % 6 < 3 THEN 0 ELSE 1 END AS cell_y FROM lo)
SELECT image_id, cell_x, cell_y, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM ({_gem('ce', 'image_id, cell_x, cell_y')})""",
    "pool_netvlad": f"WITH {_assigned(8)}{_vlad(True)}",
    "pool_ghostvlad": f"WITH {_assigned(10)}{_vlad(True)}",
    "pool_supervlad": f"WITH {_assigned(10, False)}{_vlad(False)}",
    "pool_salad": f"""WITH {_LOCAL}, {_D}, pl AS (SELECT * FROM lo WHERE pos > 0), ce AS (SELECT k, list((((k * 5 + (i - 1) * 3) % 13) - 6) / 12.0 ORDER BY i) AS c FROM (SELECT unnest(range(0, 4)) AS k), d GROUP BY k),
sc AS (SELECT image_id, pos, k, list_inner_product(v, CAST(c AS DOUBLE[])) AS s FROM pl, ce), {_sinkhorn(3)},
o AS (SELECT image_id, k, i, sum(p * v[i]) AS x FROM tp JOIN pl USING (image_id, pos), d GROUP BY image_id, k, i)
SELECT image_id, CAST(64 + k * 64 + i - 1 AS INT) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY image_id, k)), 1e-12), 6) AS x FROM o
UNION ALL SELECT image_id, CAST(i - 1 AS INT), round(v[i] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) FROM lo, d WHERE pos = 0""",
    "encode_gem": f"WITH {_PATCH}, {_D} " + _unit_rows(_gem("lo", "image_id")),
    "encode_cls": f"WITH {_LOCAL}, {_D} " + _unit_rows("SELECT image_id, i, v[i] AS x FROM lo, d WHERE pos = 0"),
    "encode_cosplace": _head(7, 3, "3.0", "1e-6"),
    "encode_eigenplace": _head(5, 2, "2.0", "1e-4"),
    "encode_netvlad": _patch_vlad(8),
    "encode_ghostvlad": _patch_vlad(10),
    "pool_attention": f"""WITH {_LOCAL}, {_D}, o AS (SELECT unnest(range(0, 8)) AS o), qu AS (SELECT unnest(range(0, 3)) AS query),
q AS (SELECT query, o, sum({_w('o', 'i - 1', 3, 5)} * {_w('query', 'i - 1', 4, 3)}) AS q FROM qu, o, d GROUP BY query, o),
kv AS (SELECT image_id, pos, o, sum({_w('o', 'i - 1', 4, 5)} * v[i]) AS k, sum({_w('o', 'i - 1', 5, 5)} * v[i]) AS val FROM lo, o, d GROUP BY image_id, pos, o),
z AS (SELECT image_id, pos, query, o // 4 AS head, sum(q * k) / 2 AS z FROM kv JOIN q USING (o) GROUP BY image_id, pos, query, o // 4),
a AS (SELECT image_id, pos, query, head, exp(z - max(z) OVER w) AS e FROM z WINDOW w AS (PARTITION BY image_id, query, head)),
s AS (SELECT image_id, query, o, sum(e * val) / sum(e) AS x FROM a JOIN kv ON kv.image_id = a.image_id AND kv.pos = a.pos AND kv.o // 4 = a.head GROUP BY ALL)
SELECT image_id, CAST(query AS INT) AS query, CAST(r AS INT) AS i, round(sum({_w('r', 'o', 3, 7)} * x), 6) AS x FROM s, (SELECT unnest(range(0, 8)) AS r) GROUP BY image_id, query, r""".replace("kv.image_id = a.image_id", "kv.image_id = a.image_id").replace("GROUP BY ALL", "GROUP BY a.image_id, query, o").replace("s AS (SELECT image_id, query", "s AS (SELECT a.image_id, query"),
    "pool_region_tokens": f"""WITH {_LOCAL_UNIT}, {_D}, raw AS ({_LOCAL.split(", lo AS (")[1][:-1]}), p AS (SELECT image_id, v, pos % 8 AS x, (pos // 8) % 6 AS y FROM lo WHERE pos > 0),
c AS (SELECT image_id, v, 1 + (CASE WHEN y < 3 THEN 0 ELSE 2 END) + (CASE WHEN x < 4 THEN 0 ELSE 1 END) AS token FROM p
UNION ALL SELECT image_id, v, 5 + 3 * (y // 2) + (CASE WHEN x < 3 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END) FROM p)
SELECT image_id, CAST(token AS INT) AS token, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM ({_gem('c', 'image_id, token', f='greatest(v[i], 1e-6)')})
UNION ALL SELECT image_id, 0, CAST(i - 1 AS INT), round(v[i], 6) FROM raw, d WHERE pos = 0""",
    "kmeans_fit": f"WITH {_N}, {_D}, {_lloyd(3)} SELECT CAST(k AS INT) AS k, CAST(i - 1 AS INT) AS i, round(v[i], 6) AS x FROM c3, d",
    "validation_default": f"WITH {_N}, {_QG}, {_cross_rank()}, {_CROSS_TRUTH}, {_metrics('r', 't', [1, 10, 20], 'SELECT count(*) FROM q')} SELECT * FROM m WHERE name IN ('mAP', 'CMC', 'R')",
    "denormalized_pixels": f"""WITH {_F}, c AS (SELECT * FROM (VALUES (0, 0.229::DOUBLE, 0.485::DOUBLE), (1, 0.224::DOUBLE, 0.456::DOUBLE), (2, 0.225::DOUBLE, 0.406::DOUBLE)) t(channel, s, m))
SELECT id, CAST(channel AS INT) AS channel, CAST(floor(least(greatest(v[channel + 1] * 8 * s + m, 0), 1) * 255) AS INT) AS value FROM f, c""",
    "epoch_reshuffled": f"""WITH {_NODES}, z AS (SELECT DISTINCT scene FROM nodes), s AS (SELECT scene FROM (SELECT scene, row_number() OVER (ORDER BY {_hash('scene', 5)}, scene) AS r FROM z) WHERE r <= 4),
t AS (SELECT scene, sample FROM s, (SELECT unnest(range(1, 4)) AS sample)) SELECT scene, CAST(sample AS INT) AS sample, row_number() OVER (ORDER BY {_hash('scene * 8 + sample', 5)}, scene, sample) - 1 AS position FROM t""",
    "neighbour_dropout": f"WITH {_N}, {_knn('k', 10)} SELECT src, CAST(rank AS INT) AS rank, dst FROM k WHERE rank = 0 OR {_hash('CAST(' + _hash('src', 2) + ' * 31 + dst AS HUGEINT)', 3)} / 4294967296.0 >= 0.3",
    "array_features": f"WITH {_F}, {_D} SELECT 'img_' || id AS image_name, CAST(i - 1 AS INT) AS i, round(v[i], 6) AS x FROM f, d",
    "key_lookup": f"""WITH {_URLS}, b AS (SELECT page_id, path, string_split(path, '/')[-1] AS base, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM u),
e AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN base WHEN 1 THEN stem ELSE path END AS key FROM b)
SELECT page_id, CASE WHEN page_id % 2 = 0 AND base IN (SELECT key FROM e) THEN base WHEN page_id % 2 = 0 AND stem IN (SELECT key FROM e) THEN stem WHEN path IN (SELECT key FROM e) THEN path END AS key FROM b""",
    "vlad_init": f"""WITH {_F}, {_D}, ce AS (SELECT id AS k, v FROM f WHERE id < 8), s AS (SELECT a.k, b.k AS o, sum((a.v[i] - b.v[i]) * (a.v[i] - b.v[i])) AS x FROM ce a, ce b, d WHERE a.k <> b.k GROUP BY a.k, b.k)
SELECT round(-ln(0.01) / (avg(m) + 1e-12), 6) AS alpha FROM (SELECT k, min(x) AS m FROM s GROUP BY k)""",
    "supervlad_init": f"""WITH {_LOCAL_UNIT}, s AS (SELECT image_id, pos, list_inner_product(lo.v, c.v) AS s, row_number() OVER (PARTITION BY image_id, pos ORDER BY list_inner_product(lo.v, c.v) DESC, c.id) AS r FROM lo, (SELECT * FROM n WHERE id < 8) c)
SELECT round(-ln(0.01) / (avg(gap) + 1e-12), 6) AS alpha FROM (SELECT max(s) - min(s) AS gap FROM s WHERE r <= 2 GROUP BY image_id, pos)""",
    "vlad_balance": f"""WITH {_assigned(8)}, u AS (SELECT k, avg(a) AS p FROM asg GROUP BY k), z AS (SELECT p / sum(p) OVER () AS p FROM u)
SELECT round(avg((p - 0.125) * (p - 0.125)), 8) AS mse, round(sum(p * ln((p + 1e-12) / 0.125)), 6) AS kl FROM z""",
    "ghost_discard_rate": f"WITH {_assigned(10)} SELECT round(avg(x), 6) AS rate FROM (SELECT sum(a) AS x FROM asg WHERE k >= 8 GROUP BY image_id, pos)",
    "assign_argmax": f"WITH {_assigned(8)} SELECT image_id, CAST(pos AS INT) AS pos, CAST(arg_max(k, a) AS INT) AS k, round(max(a), 6) AS a FROM asg GROUP BY image_id, pos",
    "whiten_stats": f"""WITH {_F}, {_D}, m AS (SELECT i, avg(v[i]) AS m FROM f, d GROUP BY i), c AS (SELECT id, i, v[i] - m AS x FROM f, d JOIN m USING (i)), nn AS (SELECT count(*) AS n FROM f)
SELECT a.i - 1 AS i, b.i - 1 AS j, round(sum(a.x * b.x) / (max(n) - 1), 6) AS cov, round(max(m), 6) AS mean FROM c a JOIN c b USING (id) JOIN m ON m.i = a.i, nn GROUP BY a.i, b.i""",
    "tta_mean": f"""WITH {_F}, {_D}, a AS (SELECT id // 4 AS item, i, avg(v[i]) AS x FROM f, d GROUP BY item, i)
SELECT item, CAST(i - 1 AS INT) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item)), 1e-12), 6) AS x FROM a""",
    "dynamic_power": f"WITH {_F}, {_D} SELECT id, CAST(i - 1 AS INT) AS i, round(sign(v[i]) * pow(abs(v[i]) + 1e-6, 0.5) + v[i], 6) AS x FROM f, d",
    "norm_gating": f"WITH {_F}, {_D} SELECT id, CAST(i - 1 AS INT) AS i, round(v[i] * (1 + 0.3 / (1 + exp(-(1.5 * sqrt(list_inner_product(v, v)) - 0.2)))), 6) AS x FROM f, d",
    "minmax_map": f"WITH {_PER_IMAGE} SELECT image_id, head, pos, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x FROM sc WINDOW w AS (PARTITION BY image_id, head)",
    "attention_mass": f"WITH {_PER_IMAGE} SELECT image_id, head, pos, sum(abs(x)) OVER (PARTITION BY image_id, head ORDER BY abs(x), pos ROWS UNBOUNDED PRECEDING) / sum(abs(x)) OVER (PARTITION BY image_id, head) > 0.5 AS kept FROM sc",
    "attention_map": f"""WITH {_LOCAL}, s AS (SELECT a.image_id, a.pos AS qpos, b.pos AS kpos, list_inner_product(a.v, b.v) / 8 AS s FROM lo a JOIN lo b ON a.image_id = b.image_id),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY image_id, qpos)) AS e FROM s) SELECT image_id, 0 AS head, qpos, kpos, round(e / sum(e) OVER (PARTITION BY image_id, qpos), 6) AS a FROM e""",
    "rotary_embedding": f"""WITH {_LOCAL}, {_D}, hw AS (SELECT image_id, max(pos // 8) + 1 AS h, max(pos % 8) + 1 AS w FROM lo GROUP BY image_id),
a AS (SELECT image_id, pos, v, i, 2 * pi() * (CASE WHEN (i - 1) % 32 < 16 THEN 2 * (pos // 8 + 0.5) / h - 1 ELSE 2 * (pos % 8 + 0.5) / w - 1 END) / pow(100.0, 2 * ((i - 1) % 16) / 32.0) AS t FROM lo JOIN hw USING (image_id), d)
SELECT image_id, pos, CAST(i - 1 AS INT) AS i, round(v[i] * cos(t) + (CASE WHEN i <= 32 THEN -v[i + 32] ELSE v[i - 32] END) * sin(t), 6) AS x FROM a""",
    "loss_supcon": _supcon("1.0"),
    "loss_supcon_soft": _supcon("(ov * ov)"),
    "loss_circle": f"""WITH {_LOSS}, zp AS (SELECT sample, i, -80.0 * greatest(1.4 - sim, 0) * (sim - 0.6) AS z FROM p WHERE ov >= 0.3), zn AS (SELECT sample, i, 80.0 * greatest(sim + 0.4, 0) * (sim - 0.4) AS z FROM p WHERE ov < 0.3),
lp AS ({_LSE.format(z='z', t='zp')}), ln2 AS ({_LSE.format(z='z', t='zn')}), b AS (SELECT a.lse + b.lse AS x FROM lp a JOIN ln2 b USING (sample, i))
SELECT round(coalesce(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 0), 6) AS loss FROM b""",
    "loss_multisim": f"WITH {_LOSS}, {_MS} SELECT round(x, 6) AS loss FROM ms",
    "loss_rank": f"WITH {_LOSS}, {_RK} SELECT round(x, 6) AS loss FROM rk",
    "loss_library_supcon": f"""WITH {_BATCH}, z AS (SELECT i, s / 0.07 AS z, pos FROM e), l AS (SELECT i, ln(sum(exp(z - 20))) + 20 AS l FROM z GROUP BY i),
per AS (SELECT i, -sum(z - l) / (count(*) + 1e-8) AS x FROM z JOIN l USING (i) WHERE pos GROUP BY i) {_one('avg(x)')}""",
    "loss_library_circle": f"""WITH {_BATCH}, {_sums('(-80.0 * greatest(1.4 - s, 0) * (s - 0.6))', 'lp', 'pos')}, {_sums('(80.0 * greatest(s + 0.4, 0) * (s - 0.4))', 'lq', 'NOT pos')},
per AS (SELECT lp + lq AS t FROM lp JOIN lq USING (i)) {_one('avg(greatest(t, 0) + ln(1 + exp(-abs(t))))')}""",
    "loss_library_rankedlist": f"""WITH {_BATCH}, o AS (SELECT i, pos, CASE WHEN pos THEN d - 0.8 ELSE 1.2 - d END AS off FROM e), w AS (SELECT *, CASE WHEN off <= 0 THEN 0 WHEN pos THEN 1 ELSE exp(off) END AS w FROM o),
per AS (SELECT i, coalesce(sum(w * off) FILTER (pos AND w > 0) / sum(w) FILTER (pos AND w > 0), 0) / 2 + coalesce(sum(w * off) FILTER (NOT pos AND w > 0) / sum(w) FILTER (NOT pos AND w > 0), 0) / 2 AS x FROM w GROUP BY i) {_one('avg(x)')}""",
    "loss_library_multisimilarity": f"""WITH {_BATCH}, per AS (SELECT i, ln(1 + coalesce(sum(exp(2 * (0.5 - s))) FILTER (pos), 0)) / 2 + ln(1 + coalesce(sum(exp(50 * (s - 0.5))) FILTER (NOT pos), 0)) / 50 AS x FROM e GROUP BY i) {_one('avg(x)')}""",
    "loss_library_contrastive": f"""WITH {_BATCH}, per AS (SELECT pos, CASE WHEN pos THEN d ELSE greatest(1 - d, 0) END AS x FROM e) SELECT round(coalesce(avg(x) FILTER (pos AND x > 0), 0) + coalesce(avg(x) FILTER (NOT pos AND x > 0), 0), 6) AS loss FROM per""",
    "loss_library_lifted": f"""WITH {_BATCH}, per AS (SELECT i, coalesce(ln(sum(exp(d - 1)) FILTER (pos)), 0) + coalesce(ln(sum(exp(-d)) FILTER (NOT pos)), 0) AS x FROM e GROUP BY i) {_one('avg(greatest(x, 0))')}""",
    "loss_library_fastap": f"""WITH {_BATCH}, h AS (SELECT i, pos, unnest(range(0, 31)) AS bin, (2 - 2 * s) / (4 / 30.0) AS place FROM e),
g AS (SELECT i, bin, coalesce(sum(greatest(1 - abs(place - bin), 0)) FILTER (pos), 0) AS p, sum(greatest(1 - abs(place - bin), 0)) AS t FROM h GROUP BY i, bin),
u AS (SELECT i, p, sum(p) OVER w AS cp, sum(t) OVER w AS ct FROM g WINDOW w AS (PARTITION BY i ORDER BY bin)),
per AS (SELECT i, 1 - sum(CASE WHEN p > 0 THEN p * cp / ct ELSE 0 END) / sum(p) AS x FROM u GROUP BY i HAVING sum(p) > 0.5) {_one('avg(x)')}""",
    "loss_library_ntxent": f"""WITH {_BATCH}, q AS (SELECT i, sum(exp(s / 0.07)) AS q FROM e WHERE NOT pos GROUP BY i), per AS (SELECT -ln(exp(s / 0.07) / (exp(s / 0.07) + coalesce(q, 0))) AS x FROM e LEFT JOIN q USING (i) WHERE pos) {_one('avg(x)')}""",
    "loss_library_triplet": f"WITH {_BATCH}, per AS (SELECT a.d - o.d + 0.05 AS x FROM e a JOIN e o ON a.i = o.i WHERE a.pos AND NOT o.pos) {_one('avg(x)', 'x > 0')}",
    "loss_library_softtriple": f"WITH {_N}, {_CLASSES} {_one('avg(x)')}",
    "loss_library_instance": f"""WITH {_F}, n0 AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM f), m AS (SELECT a.id, list_transform(list_zip(a.v, b.v), lambda z: z[1] + 0.5 * z[2]) AS v FROM f a JOIN f b ON b.id = a.id + 1),
u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM m), z AS (SELECT n0.id AS i, u.id AS c, 64 * list_inner_product(n0.v, u.v) AS z FROM n0, u),
per AS (SELECT i, 64 + ln(sum(exp(z - 64))) - max(CASE WHEN i = c THEN z END) AS x FROM z GROUP BY i) {_one('avg(x)')}""",
    "group_squared_distances": f"WITH {_F} SELECT a.label, a.id AS i, b.id AS j, round(list_aggregate(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum'), 6) AS d FROM f a JOIN f b ON a.label = b.label",
    "loss_bce": f"WITH {_F}, {_D} SELECT round(coalesce(avg(greatest(v[i], 0) - (CASE WHEN (label + i - 1) % 2 = 0 THEN v[i] ELSE 0 END) + ln(1 + exp(-abs(v[i])))), 0), 6) AS loss FROM f, d WHERE (id + i - 1) % 7 <> 0",
    "loss_total": f"WITH {_LOSS}, {_MS}, {_RK} SELECT round(ms.x, 6) AS main, round(rk.x, 6) AS aux, round(ms.x + rk.x, 6) AS loss FROM ms, rk",
    "mined_accuracy": f"WITH {_N}, {_knn('k', 3, where='a.id <> b.id')} SELECT round(1 - count(DISTINCT src) / (SELECT count(*) FROM n), 6) AS accuracy FROM k JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.label = b.label",
    "infer_id": f"""WITH {_URLS}, x AS (SELECT page_id, string_split(path, '/') AS p FROM u), y AS (SELECT page_id, CASE WHEN len(p) > 1 THEN p[-2] ELSE '' END AS folder, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem FROM x)
SELECT page_id, CASE WHEN regexp_full_match(folder, '[0-9]+') THEN folder ELSE split_part(split_part(stem, '_', 1), '-', 1) END AS inferred FROM y""",
    "scene_prefix": f"WITH {_URLS} SELECT page_id, split_part(path, '/', 1) AS scene FROM u",
    "task_files": f"WITH {_URLS} SELECT page_id, regexp_extract(path, '(/de/|/fr/|/es/)', 1) AS task FROM u WHERE regexp_matches(path, '/de/|/fr/|/es/')",
    "path_intersect": f"""WITH {_URLS}, x AS (SELECT page_id, regexp_replace(regexp_replace(string_split(regexp_replace(path, '[?#].*$', ''), '/')[-1], '\\.[^.]*$', ''), '_[0-9]+$', '') AS name FROM u)
SELECT name FROM x WHERE page_id % 2 = 0 INTERSECT SELECT name FROM x WHERE page_id % 2 = 1""",
    "resolve_path": f"""WITH {_URLS}, x AS (SELECT path, string_split(path, '/')[-1] AS base FROM u), y AS (SELECT path, CASE WHEN base = '25' THEN 0 WHEN regexp_replace(base, '\\.[^.]*$', '') = '25' THEN 1 WHEN contains(base, '25') THEN 2 END AS r FROM x)
SELECT (SELECT path FROM y WHERE r IS NOT NULL ORDER BY r, length(path), path LIMIT 1) AS path""",
    "view_class_index": f"WITH {_VIEWS} SELECT view, CAST(cls AS VARCHAR) AS cls, view || '/' || cls || '/' || id || '.jpg' AS path FROM vw WHERE cls IN (SELECT cls FROM vw WHERE view = 'satellite')",
    "manifest_roles": "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS role FROM embeddings",
    "feature_by_name": f"WITH {_F}, {_D} SELECT CAST(id % 100 AS VARCHAR) AS image_name, CAST(i - 1 AS INT) AS i, round(arg_max(v[i], id), 6) AS x FROM f, d GROUP BY id % 100, i",
    "image_index_names": f"WITH {_F}, x AS (SELECT label AS scene, 'i' || id || '.jpg' AS name, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS idx FROM f) SELECT scene, CAST(idx AS INT) AS idx, name FROM x",
    "scene_edge_aliases": f"WITH {_EDGES} SELECT scene, u, v, round(w, 6) AS w FROM raw",
    "pair_lines": f"WITH {_N}, {_knn('k', 4)}{_MATCH} SELECT DISTINCT name_a || ' ' || name_b AS value FROM mp",
    "state_key_report": "SELECT 'layer.' || vec_id AS key, 'missing' AS status FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id % 3 = 0 UNION ALL SELECT 'layer.' || vec_id, 'unexpected' FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 4 = 0",
}
