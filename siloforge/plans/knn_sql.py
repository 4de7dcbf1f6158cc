"""The nearest-neighbour model as SQL, for checking."""

from __future__ import annotations

from siloforge.plans.fixtures import rows_sql


def knn_sql(name: str, sel: list[int], k: int = 5) -> str:
    """CTEs near, cnt, pri, cond, post, pred and ctr over a fixture."""
    positions = ", ".join(map(str, sel))
    return f"""WITH {rows_sql(name)},
p AS (SELECT row_id, silo, split, y, list_transform([{positions}], lambda j: x[j + 1]) x FROM r),
tr AS (SELECT *, count(*) OVER (PARTITION BY silo) n FROM p WHERE split = 'train'),
sims AS (SELECT a.split sp, a.silo, a.row_id, b.row_id nbr_id, b.y nbr_y, b.n,
  round(CASE WHEN sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)) > 0 THEN list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) ELSE 0 END, 9) sim
  FROM p a JOIN tr b ON a.silo = b.silo AND a.row_id <> b.row_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY silo, row_id ORDER BY sim DESC, nbr_id) rank FROM sims) WHERE rank <= greatest(1, least({k}, n - 1))),
cnt AS (SELECT sp, silo, row_id, l, CAST(sum(v) AS BIGINT) c FROM (SELECT sp, silo, row_id, unnest(range(0, len(nbr_y))) l, unnest(nbr_y) v FROM near) GROUP BY ALL),
pri AS (SELECT silo, l, count(*) n, CAST(sum(v) AS BIGINT) pos, (1.0::DOUBLE + sum(v)) / (2.0::DOUBLE + count(*)) prior FROM yl WHERE split = 'train' GROUP BY silo, l),
ctf AS (SELECT c.silo, c.l, c.c, sum(v) ct, sum(1 - v) cf FROM cnt c JOIN yl ON c.row_id = yl.row_id AND c.l = yl.l WHERE sp = 'train' GROUP BY ALL),
spine AS (SELECT *, greatest(1, least({k}, n - 1)) k, unnest(range(0, greatest(1, least({k}, n - 1)) + 1)) c FROM pri),
cond AS (SELECT s.silo, s.l, s.c, prior, (1.0::DOUBLE + coalesce(ct, 0)) / (k + 1 + pos) pt, (1.0::DOUBLE + coalesce(cf, 0)) / (k + 1 + n - pos) pf FROM spine s LEFT JOIN ctf t ON s.silo = t.silo AND s.l = t.l AND s.c = t.c),
post AS (SELECT c.silo, row_id, c.l, CASE WHEN prior * pt + (1 - prior) * pf > 0 THEN prior * pt / (prior * pt + (1 - prior) * pf) ELSE 0.5 END p FROM cnt c JOIN cond d ON c.silo = d.silo AND c.l = d.l AND c.c = d.c WHERE sp = 'val'),
sing AS (SELECT silo, max(len(y)) > 1 AND bool_and(list_sum(y) = 1) single FROM p WHERE split = 'train' GROUP BY silo),
pred AS (SELECT silo, row_id, l, p, CAST(CASE WHEN single THEN row_number() OVER (PARTITION BY silo, row_id ORDER BY round(p, 9) DESC, l) = 1 ELSE round(p, 9) >= 0.5 END AS INT) pred FROM post JOIN sing USING (silo)),
sco AS (SELECT y.silo, y.row_id, y.l, y.v, p, coalesce(pred, 0) pred FROM yl y LEFT JOIN pred d ON y.silo = d.silo AND y.row_id = d.row_id AND y.l = d.l WHERE y.split = 'val'),
ctr AS (SELECT silo, l, CAST(sum(pred * v) AS BIGINT) tp, CAST(sum(pred * (1 - v)) AS BIGINT) fp, CAST(sum((1 - pred) * v) AS BIGINT) fn FROM sco GROUP BY silo, l),
tot AS (SELECT l, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM ctr GROUP BY l),
lf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END f1 FROM tot),
cf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END f1 FROM ctr),
cli AS (SELECT silo, CASE WHEN sum(2 * tp + fp + fn) > 0 THEN 2.0 * sum(tp) / sum(2 * tp + fp + fn) ELSE 0 END micro_f1, avg(f1) macro_f1, coalesce(avg(f1) FILTER (WHERE tp + fn > 0), 0) local_macro_f1 FROM cf GROUP BY silo)
"""
