"""Queries on spectral evidence that excerpts add to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import accumulate
from . import roles
from .roles import FRAMES_SQL, r6

_RULES = accumulate.Rules(32_000, 64, 64, silent_db=-30.0, cutoff_db=9.0)


def excerpt_evidence(spark, d):
    """Every frame is an excerpt of its label's track: half the sum of it and its noisy copy, and half the difference."""
    f = roles.frames(spark, d).select("track", *(F.transform(F.arrays_zip("a", "b"), _half(s)).alias(c) for c, s in (("mid", 1), ("side", -1))))
    e = accumulate.evidence(accumulate.states(f, _RULES), _RULES)
    return e.select("track", "frames", *(n.r6(F.col(c)).alias(c) for c in accumulate.FOUND))


def _half(sign: int):
    return lambda z: (z["a"] + sign * z["b"]) / 2


QUERIES = {f.__name__: f for f in (excerpt_evidence,)}

_W = "(0.5 - 0.5 * cos(2 * pi() * i / 64))"
_SCALE = 4 / (64 * 24.0)
SQL = {
    "excerpt_evidence": f"""WITH {FRAMES_SQL.split('sp AS')[0].strip().rstrip(',')},
        sp AS (SELECT track, t, f AS bin, {_SCALE!r}::DOUBLE * (pow(sum((a + b) / 2 * {_W} * cos(2 * pi() * f * i / 64)), 2) + pow(sum((a + b) / 2 * {_W} * sin(2 * pi() * f * i / 64)), 2)) AS m,
                      {_SCALE!r}::DOUBLE * (pow(sum((a - b) / 2 * {_W} * cos(2 * pi() * f * i / 64)), 2) + pow(sum((a - b) / 2 * {_W} * sin(2 * pi() * f * i / 64)), 2)) AS d FROM s, (SELECT unnest(range(33)) AS f) GROUP BY track, t, f),
        lv AS (SELECT track, t, 10 * log10(greatest(avg(m) FILTER (bin BETWEEN 2 AND 7), 1e-30)) AS level FROM sp GROUP BY track, t HAVING level > -30),
        sm AS (SELECT track, t, bin, level, CASE WHEN count(*) OVER w = 5 THEN avg(10 * log10(greatest(m, 1e-30))) OVER w END AS v FROM sp JOIN lv USING (track, t) WINDOW w AS (PARTITION BY track, t ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        ct AS (SELECT track, t, coalesce(max(bin) FILTER (v > level - 9 AND bin < 29), 0) * 500.0::DOUBLE AS cut FROM sm GROUP BY track, t),
        q AS (SELECT track, count(*) AS frames, quantile_cont(cut, 0.5) AS q50, quantile_cont(cut, 0.75) - quantile_cont(cut, 0.25) AS iqr FROM ct GROUP BY track),
        l AS (SELECT track, bin, 10 * log10(greatest(avg(m), 1e-30)) AS db, 10 * log10(greatest(avg(d), 1e-30)) AS side FROM sp JOIN lv USING (track, t) GROUP BY track, bin),
        z AS (SELECT track, bin, CASE WHEN count(*) OVER w = 5 THEN avg(db) OVER w END AS v FROM l WINDOW w AS (PARTITION BY track ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        x AS (SELECT track, bin, lead(v, 2) OVER (PARTITION BY track ORDER BY bin) - v AS drop FROM z WHERE v IS NOT NULL),
        k AS (SELECT track, bin * 500 + 250.0::DOUBLE AS knee, -drop AS drop FROM x JOIN q USING (track) WHERE drop IS NOT NULL AND bin * 500 >= least(greatest(q50 - 1500, 2000), 8000) QUALIFY row_number() OVER (PARTITION BY track ORDER BY floor(drop * 1e9 + 0.5), bin) = 1),
        e AS (SELECT track, avg(db) FILTER (bin BETWEEN 2 AND 7) AS level, CASE WHEN count(*) FILTER (bin * 500 BETWEEN knee + 400 AND 15680) >= 4 THEN avg(db) FILTER (bin * 500 BETWEEN knee + 400 AND 15680) END AS rest,
                     CASE WHEN count(*) FILTER (bin >= 16 AND bin * 500 < knee) >= 4 THEN avg(side - db) FILTER (bin >= 16 AND bin * 500 < knee) END AS high, avg(side - db) FILTER (bin BETWEEN 2 AND 7) AS low FROM l JOIN k USING (track) GROUP BY track)
        SELECT track, frames, {r6("level")} AS level_db, {r6("knee")} AS knee_hz, {r6('"drop"')} AS drop_db, NULL::DOUBLE AS wall_hz, {r6("rest - level")} AS floor_db, {r6("q50")} AS cutoff_hz, {r6("iqr")} AS cutoff_iqr_hz, {r6("high - low")} AS side_db
        FROM q JOIN k USING (track) JOIN e USING (track)""",
}
