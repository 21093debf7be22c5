"""Parts of oracle SQL that several queries share: runs of flagged rows, and greedy matching as a recursion."""
from __future__ import annotations


def islands(name: str, source: str, condition: str) -> str:
    """CTE `name` (u, k, s, e): the k-th run of rows of `source` (u, pos, reach, ...) that the condition flags."""
    return f"""
        {name}_f AS (SELECT u, pos, CASE WHEN coalesce(pos - lag(pos) OVER (PARTITION BY u ORDER BY pos) > reach, true) THEN 1 ELSE 0 END AS o FROM {source} WHERE {condition}),
        {name}_n AS (SELECT u, pos, CAST(sum(o) OVER (PARTITION BY u ORDER BY pos RANGE UNBOUNDED PRECEDING) AS BIGINT) AS k FROM {name}_f),
        {name} AS (SELECT u, k, min(pos) AS s, max(pos) AS e FROM {name}_n GROUP BY u, k)"""


def greedy(lookback: float) -> str:
    """CTE x (u, ts, ps): matches of predictions p (u, k, s) with truths t (u, k, s, e).

    Truths follow each other, so the k-th prediction may take truths lo to hi, and takes the first of them after the last one taken.
    """
    return f"""
        w AS (
            SELECT p.u, p.k, p.s, 1 + count(t.k) FILTER (t.e < p.s) AS lo, count(t.k) FILTER (t.s - {lookback} <= p.s) AS hi FROM p LEFT JOIN t ON t.u = p.u GROUP BY ALL
        ),
        m(u, k, last, hit) AS (
            SELECT DISTINCT u, 0::BIGINT, 0::BIGINT, false FROM p
            UNION ALL SELECT w.u, w.k, CASE WHEN greatest(m.last + 1, w.lo) <= w.hi THEN greatest(m.last + 1, w.lo) ELSE m.last END, greatest(m.last + 1, w.lo) <= w.hi FROM m JOIN w ON w.u = m.u AND w.k = m.k + 1
        ),
        x AS (SELECT m.u, t.s AS ts, p.s AS ps FROM m JOIN t ON t.u = m.u AND t.k = m.last JOIN p ON p.u = m.u AND p.k = m.k WHERE m.hit)"""


#: CTE c: counts and metrics of every unit in `units` (u), from t, p and x.
SUMMARY = """
        tn AS (SELECT u, count(*) AS n FROM t GROUP BY u), pn AS (SELECT u, count(*) AS n FROM p GROUP BY u), xn AS (SELECT u, count(*) AS n FROM x GROUP BY u),
        c0 AS (SELECT u, coalesce(tn.n, 0) AS truths, coalesce(pn.n, 0) AS predictions, coalesce(xn.n, 0) AS matched FROM units LEFT JOIN tn USING (u) LEFT JOIN pn USING (u) LEFT JOIN xn USING (u)),
        c AS (
            SELECT *, CASE WHEN predictions > 0 THEN matched / predictions::DOUBLE WHEN truths > 0 THEN 0.0 END AS precision, CASE WHEN truths > 0 THEN matched / truths::DOUBLE END AS recall,
                CASE WHEN truths > 0 THEN 2.0 * matched / (truths + predictions) END AS f1, CASE WHEN truths > 0 THEN 1 - matched / truths::DOUBLE END AS miss_rate FROM c0
        )"""
