"""The registered queries as self-contained DuckDB SQL.

Written apart from the Spark plans: clusterings are unrolled into chains of common table
expressions, and random draws are inlined as literals. Nothing that Spark computed is read.
"""

from __future__ import annotations

from ..functions.hashing import MODULUS, PLACE_FACTOR, SIGN_PRIME
from ..functions.vec import splits
from .draws import cube_draws, lsh_draws, permutation, probe_masks, uniforms
from .params import CubeParams, IvfParams, KMeansParams, LshParams, PqParams

BASE = """v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS MATERIALIZED (SELECT id AS qid, v AS qv FROM v WHERE id % 100 = 0)"""


def number(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def array(values: list[float]) -> str:
    return "[" + ",".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + select


def ranked(source: str, n: int, by: str = "d", digits: int = 6) -> str:
    return (f"SELECT qid, rank, id, round({by}, {digits}) AS dist FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY qid ORDER BY round({by}, 9), id) AS rank FROM {source}) WHERE rank <= {n}")


# ---------------------------------------------------------------- hash indexes

def lsh(p: LshParams, dim: int) -> list[str]:
    d = lsh_draws(dim, p)
    rows = ",".join(f"({t},{j},{array(d.directions[t][j])},{number(d.offsets[t][j])},{d.weights[t][j]}::HUGEINT)" for t in range(p.tables) for j in range(p.hashes))
    return [
        f"lp(tbl, j, dir, t, r) AS (VALUES {rows})",
        f"lh AS MATERIALIZED (SELECT id, tbl::BIGINT AS tbl, j::BIGINT AS j, floor((list_inner_product(v, dir) + t) / {number(p.width)})::BIGINT AS h, r FROM v, lp)",
        f"li AS MATERIALIZED (SELECT id, tbl, (sum((r * (((h % {MODULUS}) + {MODULUS}) % {MODULUS})::HUGEINT) % {MODULUS}) % {MODULUS})::BIGINT AS hid FROM lh GROUP BY id, tbl)",
        "lc AS MATERIALIZED (SELECT DISTINCT a.id AS qid, b.id FROM li a JOIN li b USING (tbl, hid) WHERE a.id % 100 = 0)",
        "ld AS MATERIALIZED (SELECT qid, lc.id, list_distance(qv, v) AS d FROM lc JOIN q USING (qid) JOIN v ON v.id = lc.id)",
    ]


def twister(seed: int) -> list[str]:
    """cv (id, vertex) of the hashes ch (id, j, h): bits are the lowest of mt19937's first output, seeded by
    (seed xor j * factor xor h) mod 2**32. The seeded state is a fold of 397 steps, of which the first and the last
    are wanted; numbers are those of the generator's definition."""
    low = 4294967295
    return [
        f"cw AS MATERIALIZED (SELECT DISTINCT j, h, xor(xor({seed}::BIGINT, (j::BIGINT * {PLACE_FACTOR}) & {low}), h & {low}) AS s FROM ch)",
        f"cx AS (SELECT *, (1812433253 * xor(s, s >> 30) + 1) & {low} AS s1, list_reduce(list_prepend(s, range(1, 398)), lambda a, i: (1812433253 * xor(a, a >> 30) + i) & {low}) AS sm FROM cw)",
        "cy AS (SELECT *, xor(xor(sm, ((s & 2147483648) | (s1 & 2147483647)) >> 1), CASE WHEN s1 % 2 = 1 THEN 2567483615 ELSE 0 END) AS y0 FROM cx)",
        "cz AS (SELECT *, xor(y0, y0 >> 11) AS y1 FROM cy)",
        "cz2 AS (SELECT *, xor(y1, (y1 << 7) & 2636928640) AS y2 FROM cz)",
        "cz3 AS (SELECT *, xor(y2, (y2 << 15) & 4022730752) AS y3 FROM cz2)",
        "cb AS MATERIALIZED (SELECT j, h, xor(y3, y3 >> 18) % 2 AS bit FROM cz3)",
        "cv AS MATERIALIZED (SELECT id, sum(bit << j)::BIGINT AS vertex FROM ch JOIN cb USING (j, h) GROUP BY id)",
    ]


def cube(p: CubeParams, dim: int) -> list[str]:
    d = cube_draws(dim, p)
    rows = ",".join(f"({j},{array(d.directions[j])},{number(d.offsets[j])},{d.factors[j]}::HUGEINT,{d.shifts[j]}::HUGEINT)" for j in range(p.projections))
    masks = ",".join(f"({i},{m}::BIGINT)" for i, m in enumerate(probe_masks(p.projections, p.max_probes)))
    vertices = f"cv AS MATERIALIZED (SELECT id, sum((((((h % {SIGN_PRIME}) + {SIGN_PRIME}) % {SIGN_PRIME})::HUGEINT * a + b) % {SIGN_PRIME} % 2)::BIGINT << j)::BIGINT AS vertex FROM ch GROUP BY id)"
    return [
        f"cp(j, dir, t, a, b) AS (VALUES {rows})",
        f"ch AS (SELECT id, j, a, b, floor((list_inner_product(v, dir) + t) / {number(p.width)})::BIGINT AS h FROM v, cp)",
        *([vertices] if p.bits == "hash" else twister(p.seed)),
        f"cm(probe_no, mask) AS (VALUES {masks})",
        "cf AS (SELECT vertex, count(*) AS n FROM cv GROUP BY vertex)",
        "cq AS (SELECT id AS qid, probe_no, xor(vertex, mask) AS vertex FROM cv, cm WHERE id % 100 = 0)",
        "cs AS (SELECT qid, probe_no, cq.vertex, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY probe_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM cq LEFT JOIN cf USING (vertex))",
        f"cc AS MATERIALIZED (SELECT qid, id FROM cs JOIN cv USING (vertex) WHERE seen < {p.max_candidates})",
        "cd AS MATERIALIZED (SELECT qid, cc.id, list_distance(qv, v) AS d FROM cc JOIN q USING (qid) JOIN v ON v.id = cc.id)",
    ]


# ---------------------------------------------------------------- clustering

def kmeans(name: str, source: str, k: int, iters: int, draws: dict[int, list[float]]) -> list[str]:
    """Tables {name}_s (seeds: m, i, id, v), {name}_a{t} (assignments) and {name}_g{t} (centres: m,
    cid, c) of a grouped clustering of ``source`` (m, id, v)."""
    u = ",".join(f"({m},{i},{number(x)})" for m, xs in draws.items() for i, x in enumerate(xs))
    out = [f"{name}_u(m, i, u) AS (VALUES {u})",
           f"{name}_c0 AS MATERIALIZED (SELECT m, id, v FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY m) AS n FROM {source}) "
           f"JOIN {name}_u USING (m) WHERE i = 0 AND rn = least(n - 1, floor(u * n)::BIGINT))",
           f"{name}_m0 AS MATERIALIZED (SELECT s.m, s.id, s.v, pow(list_distance(s.v, c.v), 2) AS d2 FROM {source} s JOIN {name}_c0 c USING (m))"]
    for i in range(1, k):
        out += [
            f"{name}_c{i} AS MATERIALIZED (SELECT m, min(id) AS id, arg_min(v, id) AS v FROM (SELECT *, sum(d2) OVER (PARTITION BY m ORDER BY id) AS pf, sum(d2) OVER (PARTITION BY m) AS tot FROM {name}_m{i - 1}) "
            f"JOIN {name}_u USING (m) WHERE i = {i} AND pf >= u * tot GROUP BY m)",
            f"{name}_m{i} AS MATERIALIZED (SELECT s.m, s.id, s.v, least(d2, pow(list_distance(s.v, c.v), 2)) AS d2 FROM {name}_m{i - 1} s JOIN {name}_c{i} c USING (m))",
        ]
    out.append(f"{name}_s AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT m, {i} AS i, id, v FROM {name}_c{i}" for i in range(k)) + ")")
    return [*out, *lloyd(name, source, iters)]


def random_seeds(name: str, source: str, k: int, seed: int) -> str:
    """{name}_s: the first rows of ``source`` in the seeded order of ids."""
    p = permutation(seed)
    return (f"{name}_s AS MATERIALIZED (SELECT m, row_number() OVER w - 1 AS i, id, v FROM {source} "
            f"WINDOW w AS (ORDER BY ((id % {p.prime}) * {p.factor} + {p.shift}) % {p.prime}, id) QUALIFY i < {k})")


def lloyd(name: str, source: str, iters: int, empty: str = "keep") -> list[str]:
    """{name}_a{t} and {name}_g{t} from the seeds {name}_s. With ``farthest`` the empty clusters of a group
    take, in their order, the rows farthest from their centres."""
    out = [f"{name}_g0 AS MATERIALIZED (SELECT m, i AS cid, v AS c FROM {name}_s)"]
    for t in range(1, iters + 1):
        out += [
            f"{name}_a{t} AS MATERIALIZED (SELECT m, id, any_value(v) AS v, min_by(cid, struct_pack(d := d, i := cid)) AS cid, min(d) AS d FROM "
            f"(SELECT s.m, s.id, s.v, c.cid, list_distance(s.v, c.c) AS d FROM {source} s JOIN {name}_g{t - 1} c USING (m)) GROUP BY m, id)",
            f"{name}_n{t} AS (SELECT m, cid, list(x ORDER BY pos) AS c FROM (SELECT m, cid, pos, avg(x) AS x FROM "
            f"(SELECT m, cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {name}_a{t}) GROUP BY m, cid, pos) GROUP BY m, cid)",
        ]
        if empty == "keep":
            out.append(f"{name}_g{t} AS MATERIALIZED (SELECT p.m, p.cid, coalesce(n.c, p.c) AS c FROM {name}_g{t - 1} p LEFT JOIN {name}_n{t} n USING (m, cid))")
            continue
        out += [
            f"{name}_f{t} AS (SELECT m, v, row_number() OVER (PARTITION BY m ORDER BY d DESC, id) AS r FROM {name}_a{t})",
            f"{name}_b{t} AS (SELECT p.m, p.cid, row_number() OVER (PARTITION BY p.m ORDER BY p.cid) AS r FROM {name}_g{t - 1} p ANTI JOIN {name}_n{t} n USING (m, cid))",
            f"{name}_g{t} AS MATERIALIZED (SELECT m, cid, c FROM {name}_n{t} UNION ALL SELECT b.m, b.cid, f.v AS c FROM {name}_b{t} b JOIN {name}_f{t} f USING (m, r))",
        ]
    return out


def whole_kmeans(p: KMeansParams, name: str = "k") -> list[str]:
    return [f"{name}_x AS (SELECT 0 AS m, id, v FROM v)", *kmeans(name, f"{name}_x", p.k, p.max_iters, {0: uniforms(p.seed, p.k)})]


def ivf(p: IvfParams) -> list[str]:
    perm = permutation(p.seed)
    t = p.max_iters
    return [
        f"sub AS MATERIALIZED (SELECT 0 AS m, id, v FROM v QUALIFY row_number() OVER (ORDER BY ((id % {perm.prime}) * {perm.factor} + {perm.shift}) % {perm.prime}, id) "
        f"<= (SELECT greatest({p.clusters}, floor(sqrt(count(*)))) FROM v))",
        *kmeans("f", "sub", p.clusters, t, {0: uniforms(p.seed, p.clusters)}),
        f"fl AS MATERIALIZED (SELECT id, min_by(cid, struct_pack(d := list_distance(v, c), i := cid)) AS cid FROM v, f_g{t} GROUP BY id)",
        f"fa AS (SELECT v.id AS qid, cid, c, round(list_distance(v, c), 9) AS d FROM v, f_g{t})",
        f"fp_all AS MATERIALIZED (SELECT qid, cid, c FROM fa QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, cid) <= {p.nprobe})",
        "fp AS (SELECT * FROM fp_all WHERE qid % 100 = 0)",
        "fc AS MATERIALIZED (SELECT qid, id FROM fp JOIN fl USING (cid))",
        "fd AS MATERIALIZED (SELECT qid, fc.id, list_distance(qv, v) AS d FROM fc JOIN q USING (qid) JOIN v ON v.id = fc.id)",
    ]


def ivfpq(p: IvfParams, pq: PqParams, dim: int) -> list[str]:
    cut = ",".join(f"({m},{a},{n})" for m, (a, n) in enumerate(splits(dim, pq.parts)))
    t = pq.max_iters
    return [
        *ivf(p),
        f"ps(m, a, n) AS (VALUES {cut})",
        f"pr AS MATERIALIZED (SELECT v.id, fl.cid, list_transform(list_zip(v.v, g.c), lambda z: z[1] - z[2]) AS r FROM v JOIN fl USING (id) JOIN f_g{p.max_iters} g ON g.cid = fl.cid)",
        "px AS MATERIALIZED (SELECT m, id, cid, list_slice(r, a + 1, a + n) AS v FROM pr, ps)",
        *kmeans("b", "px", pq.codes, t, {m: uniforms(pq.seed + m, pq.codes) for m in range(pq.parts)}),
        f"pe AS MATERIALIZED (SELECT px.m, id, px.cid, min_by(b.cid, struct_pack(d := list_distance(v, c), i := b.cid)) AS code FROM px JOIN b_g{t} b USING (m) GROUP BY px.m, id, px.cid)",
        "pz AS (SELECT fp.qid, fp.cid, list_transform(list_zip(qv, fp.c), lambda z: z[1] - z[2]) AS r FROM fp JOIN q USING (qid))",
        f"pl AS MATERIALIZED (SELECT qid, pz.cid, ps.m, b.cid AS code, pow(list_distance(list_slice(r, a + 1, a + n), c), 2) AS d2 FROM pz, ps JOIN b_g{t} b USING (m))",
        "pd AS MATERIALIZED (SELECT qid, id, sum(d2) AS d FROM pl JOIN pe USING (cid, m, code) GROUP BY qid, id)",
    ]


# ---------------------------------------------------------------- scores

def silhouette(name: str, clusters: str) -> list[str]:
    """{name}_p (id, cid, s) of ``clusters`` (id, v, cid)."""
    return [
        f"{name}_w AS (SELECT a.id, a.cid, b.cid AS other, avg(list_distance(a.v, b.v)) AS mean FROM {clusters} a, {clusters} b WHERE a.id <> b.id GROUP BY a.id, a.cid, b.cid)",
        f"{name}_ab AS (SELECT id, cid, coalesce(max(mean) FILTER (other = cid), 0) AS a, coalesce(min(mean) FILTER (other <> cid), 3.4028234663852886e38) AS b FROM {name}_w GROUP BY id, cid)",
        f"{name}_p AS MATERIALIZED (SELECT id, cid, CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END AS s FROM {name}_ab)",
    ]


def truth(n: int) -> list[str]:
    return [
        "ta AS (SELECT qid, id, list_distance(qv, v) AS d FROM q, v WHERE id <> qid)",
        f"tt AS MATERIALIZED (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM ta QUALIFY rank <= {n})",
    ]


def scored(found: str, n: int, name: str = "e") -> list[str]:
    """{name} (avg_af, af_found, n_found, recall_at_n) of the distances ``found`` (qid, id, d)."""
    return [
        f"{name}_f AS MATERIALIZED (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM {found} WHERE id <> qid QUALIFY rank <= {n})",
        f"{name}_q AS (SELECT q.qid, CASE WHEN t.d > 1e-12 THEN f.d / t.d END AS af, "
        f"(SELECT count(*) FROM {name}_f x JOIN tt y USING (qid, id) WHERE x.qid = q.qid) AS hits, (SELECT least({n}, count(*)) FROM tt y WHERE y.qid = q.qid) AS size "
        f"FROM q LEFT JOIN {name}_f f ON f.qid = q.qid AND f.rank = 1 LEFT JOIN tt t ON t.qid = q.qid AND t.rank = 1)",
        f"{name} AS MATERIALIZED (SELECT coalesce(avg(coalesce(af, 0)), 0) AS avg_af, avg(af) AS af_found, count(af) AS n_found, coalesce(avg(CASE WHEN size > 0 THEN hits / size ELSE 0 END), 0) AS recall_at_n FROM {name}_q)",
    ]


def relaxed(found: str, epsilon: float) -> str:
    """The ordered fold over all rows from the best candidate."""
    return f"""SELECT q.qid, coalesce(r.id, -1) AS id FROM q LEFT JOIN (
  SELECT qid, list_reduce(list_prepend(struct_pack(id := sid, d := sd), l), lambda a, x: CASE WHEN x.d < a.d / {number(1 + epsilon)} THEN x ELSE a END).id AS id
  FROM (SELECT qid, arg_min(id, struct_pack(r := round(d, 9), i := id)) AS sid, arg_min(d, struct_pack(r := round(d, 9), i := id)) AS sd FROM {found} GROUP BY qid)
  JOIN (SELECT qid, list(struct_pack(id := id, d := list_distance(qv, v)) ORDER BY id) AS l FROM q, v GROUP BY qid) USING (qid)
) r USING (qid)"""
