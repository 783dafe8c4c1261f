"""Independent DuckDB SQL for each registered query (correctness oracle).

Written directly against the raw test tables; it shares no code with the
Spark plans.  Doubles are rounded to 6 decimals like the Spark outputs.
"""

from __future__ import annotations

AREAS = """areas AS (
  SELECT c_custkey AS key, n_name AS ward, c_name AS town,
         greatest(c_acctbal, CAST(0 AS DOUBLE)) AS pop, CAST(c_nationkey AS BIGINT) AS zone
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

YEARLY = """yearly AS (
  SELECT o_custkey AS key, year(o_orderdate) AS yr,
    CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS serious,
    CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS daily,
    CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS visitor,
    CAST(count(*) AS BIGINT) AS total
  FROM orders GROUP BY 1, 2)"""

WIDE = """wide AS (
  SELECT a.key, a.ward, a.town, a.pop, a.zone,
    coalesce(c.serious, 0) AS serious_cur, coalesce(p.serious, 0) AS serious_prev,
    coalesce(c.serious, 0) + coalesce(p.serious, 0) AS serious,
    coalesce(c.daily, 0) AS daily, coalesce(c.visitor, 0) AS visitor,
    coalesce(c.total, 0) AS total
  FROM areas a
  LEFT JOIN yearly c ON c.key = a.key AND c.yr = 2000
  LEFT JOIN yearly p ON p.key = a.key AND p.yr = 1999)"""

SAFETY = """r0 AS (SELECT sum(serious) / sum(pop * 2) AS r0s, sum(daily) / sum(pop) AS r0d FROM wide),
rated AS (
  SELECT w.*,
    CASE WHEN pop >= 100 THEN (serious + 2) / (pop * 2 + 2 / r0s) * 1000 END AS serious_rate,
    CASE WHEN pop >= 100 THEN (daily + 2) / (pop + 2 / r0d) * 1000 END AS daily_rate
  FROM wide w, r0),
ranked AS (
  SELECT key, 100 * cume_dist() OVER (ORDER BY serious_rate DESC) AS serious_score,
         100 * cume_dist() OVER (ORDER BY daily_rate DESC) AS daily_score
  FROM rated WHERE serious_rate IS NOT NULL),
safety AS (
  SELECT r.*, k.serious_score, k.daily_score,
         0.65 * k.serious_score + 0.35 * k.daily_score AS safety_score
  FROM rated r LEFT JOIN ranked k ON k.key = r.key)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["q_safety_score"] = _with(AREAS, YEARLY, WIDE, SAFETY) + """
SELECT key, ward, town, round(pop, 6) AS pop, serious, daily,
  round(serious_rate, 6) AS serious_rate, round(daily_rate, 6) AS daily_rate,
  round(serious_score, 6) AS serious_score, round(daily_score, 6) AS daily_score,
  round(safety_score, 6) AS safety_score
FROM safety"""

def _dealt(priority: str, n: int, places) -> str:
    return (f"count(*) FILTER (WHERE o_orderpriority = '{priority}' AND o_orderkey % {n} IN ({', '.join(map(str, places))}))")


KINDS = f"""kinds AS (
  SELECT o_custkey AS key, year(o_orderdate) AS yr, count(*) AS total,
    {_dealt('1-URGENT', 7, range(7))} AS violent_r, {_dealt('2-HIGH', 3, range(3))} AS burglary_r,
    {_dealt('3-MEDIUM', 7, range(7))} AS daily,
    {_dealt('3-MEDIUM', 7, [4])} + {_dealt('5-LOW', 2, [0, 1])} AS visitor,
    {_dealt('1-URGENT', 7, [0])} AS robbery, {_dealt('1-URGENT', 7, [2, 3, 4, 5])} AS violence,
    {_dealt('2-HIGH', 3, range(3))} AS burglary, {_dealt('3-MEDIUM', 7, [0])} AS bicycle,
    {_dealt('3-MEDIUM', 7, [1, 5, 6])} AS vehicle, {_dealt('3-MEDIUM', 7, [2])} AS snatch,
    {_dealt('3-MEDIUM', 7, [3])} AS pickpocket, {_dealt('1-URGENT', 7, [2])} AS assault,
    {_dealt('1-URGENT', 7, [3])} AS injury, {_dealt('2-HIGH', 3, [0])} AS burglary_akisu,
    {_dealt('2-HIGH', 3, [1])} AS burglary_shinobi, {_dealt('2-HIGH', 3, [2])} AS burglary_izora
  FROM orders GROUP BY 1, 2),
measured AS (
  SELECT a.key, a.pop, coalesce(p.violent_r + p.burglary_r, 0) AS serious_prev, {{}}
  FROM areas a LEFT JOIN kinds c ON c.key = a.key AND c.yr = 2000 LEFT JOIN kinds p ON p.key = a.key AND p.yr = 1999)"""
KINDS = KINDS.replace("{}", ", ".join(f"coalesce(c.{x}, 0) AS {x}" for x in (
    "total violent_r burglary_r daily visitor robbery violence burglary bicycle vehicle snatch pickpocket assault injury "
    "burglary_akisu burglary_shinobi burglary_izora").split()))

ORACLE["q_crime_groups"] = _with(AREAS, YEARLY, WIDE, SAFETY, KINDS) + """
SELECT m.key, violent_r, burglary_r, violent_r + burglary_r AS serious_r, m.daily, m.visitor, m.serious_prev,
  violent_r + burglary_r + m.serious_prev AS serious, round(serious_score, 6) AS serious_score,
  round(daily_score, 6) AS daily_score, round(safety_score, 6) AS safety_score
FROM measured m JOIN safety s ON s.key = m.key"""

ORACLE["q_mart_crime_full"] = _with(AREAS, KINDS) + """
SELECT key, 2025 AS data_year, robbery, violence, burglary, bicycle, vehicle, snatch, pickpocket, total, assault, injury,
  burglary_akisu, burglary_shinobi, burglary_izora, violent_r + burglary_r + serious_prev AS serious_2y,
  violent_r + burglary_r AS serious_r, daily AS daily_r FROM measured"""

ORACLE["q_safety_evidence"] = _with(AREAS, KINDS) + """,
facts AS (
  SELECT key, unnest([0, 1, 2, 3, 4, 5, 6]) AS idx, unnest([violent_r + burglary_r + serious_prev, robbery, assault + injury, burglary,
    bicycle, snatch, CAST(trunc(pop) AS BIGINT)]) AS n FROM measured)
SELECT key, 'safety' AS axis, CAST(idx AS BIGINT) AS idx, ['serious crimes (2 years)', 'robbery', 'assault and injury',
  'residential burglary', 'bicycle theft', 'snatching', 'residents'][idx + 1] AS label, format('{:,}', n) AS value FROM facts"""

ORACLE["q_left_join_fill"] = _with(AREAS, YEARLY) + """
SELECT a.key, a.ward, a.town, round(a.pop, 6) AS pop,
  coalesce(y.serious, 0) AS serious, coalesce(y.daily, 0) AS daily,
  coalesce(y.visitor, 0) AS visitor, coalesce(y.total, 0) AS total
FROM areas a LEFT JOIN yearly y ON y.key = a.key AND y.yr = 2000"""

ORACLE["q_wide_left_chain"] = _with(AREAS, YEARLY) + """
SELECT a.key, a.ward, round(a.pop, 6) AS pop,
  coalesce(y0.serious, 0) AS serious_2000, coalesce(y1.serious, 0) AS serious_1999,
  coalesce(y2.serious, 0) AS serious_1998, coalesce(y3.serious, 0) AS serious_1997,
  coalesce(y0.total, 0) + coalesce(y1.total, 0) + coalesce(y2.total, 0) + coalesce(y3.total, 0) AS total_4y
FROM areas a
LEFT JOIN yearly y0 ON y0.key = a.key AND y0.yr = 2000
LEFT JOIN yearly y1 ON y1.key = a.key AND y1.yr = 1999
LEFT JOIN yearly y2 ON y2.key = a.key AND y2.yr = 1998
LEFT JOIN yearly y3 ON y3.key = a.key AND y3.yr = 1997"""

ORACLE["q_smooth_rate"] = _with(AREAS, YEARLY, WIDE, SAFETY) + """
SELECT key, round(pop, 6) AS pop, serious, round(serious_rate, 6) AS serious_rate FROM rated"""

ORACLE["q_pct_score"] = _with(AREAS, YEARLY, WIDE) + """,
ok AS (SELECT key, 100 * cume_dist() OVER (ORDER BY serious DESC) AS p FROM wide WHERE pop >= 100)
SELECT w.key, w.serious, round(ok.p, 6) AS serious_pct FROM wide w LEFT JOIN ok ON ok.key = w.key"""

ORACLE["q_topk_safety"] = _with(AREAS, YEARLY, WIDE, SAFETY) + """
SELECT key, ward, town, round(safety_score, 6) AS safety_score FROM safety
WHERE safety_score IS NOT NULL ORDER BY safety_score DESC, key LIMIT 10"""

ORACLE["q_business_flag"] = _with(AREAS, YEARLY, WIDE) + """,
v AS (SELECT key, CASE WHEN pop >= 100 THEN visitor / pop * 1000 END AS visitor_rate FROM wide),
t AS (SELECT quantile_cont(visitor_rate, 0.9) AS thr FROM v)
SELECT key, round(visitor_rate, 6) AS visitor_rate,
  coalesce(visitor_rate >= thr, false) AS business_area_flag FROM v, t"""

ORACLE["q_median_by_count"] = _with(AREAS, YEARLY, WIDE, SAFETY) + """
SELECT serious, CAST(count(*) AS BIGINT) AS n_areas, round(median(safety_score), 6) AS median_score
FROM safety WHERE safety_score IS NOT NULL GROUP BY serious"""

ORACLE["q_unmatched"] = _with(AREAS) + """
SELECT key, ward, town, round(pop, 6) AS pop FROM areas a
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = a.key AND year(o.o_orderdate) = 2000)"""

ORACLE["q_mart_crime"] = _with(AREAS, YEARLY, WIDE) + """
SELECT key, 2025 AS data_year, serious AS serious_2y, serious_cur AS serious_r,
  daily AS daily_r, visitor, total FROM wide"""

ORACLE["q_describe"] = _with(AREAS, YEARLY, WIDE, SAFETY) + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(safety_score), 6) AS mean,
  round(stddev_samp(safety_score), 6) AS std, round(min(safety_score), 6) AS min,
  round(quantile_cont(safety_score, 0.25), 6) AS p25, round(quantile_cont(safety_score, 0.5), 6) AS p50,
  round(quantile_cont(safety_score, 0.75), 6) AS p75, round(max(safety_score), 6) AS max,
  count(DISTINCT round(safety_score, 9)) AS n_unique
FROM safety WHERE safety_score IS NOT NULL"""

# --- zones, points, borings, hazards -----------------------------------------

PTS = """pts AS (
  SELECT (l_orderkey * 7919 + l_linenumber * 104729) % 99991 / CAST(1000 AS DOUBLE) AS x,
         (l_orderkey * 15485863 + l_linenumber * 32452843) % 99989 / CAST(1000 AS DOUBLE) AS y,
         round(l_discount * 10, 2) AS depth, l_quantity - 25 AS elev,
         concat(l_returnflag, l_linestatus) AS basin
  FROM lineitem)"""

ZEDGES = """zv AS (SELECT * FROM (VALUES (0, 1, 1), (1, 18, 2), (2, 17, 9), (3, 9, 10), (4, 8, 19), (5, 2, 18)) t(i, vx, vy)),
zedges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS zone,
    CAST((n_nationkey % 5) * 20 + a.vx AS DOUBLE) AS x1, CAST(floor(n_nationkey / 5) * 20 + a.vy AS DOUBLE) AS y1,
    CAST((n_nationkey % 5) * 20 + b.vx AS DOUBLE) AS x2, CAST(floor(n_nationkey / 5) * 20 + b.vy AS DOUBLE) AS y2
  FROM nation, zv a JOIN zv b ON b.i = (a.i + 1) % 6)"""


def _hits(src: str, name: str) -> str:
    """Rows of `src` inside their lattice zone (even-odd ray test)."""
    return f"""{name} AS (
  SELECT s.*, CAST(floor(s.x / 20) + 5 * floor(s.y / 20) AS BIGINT) AS zone FROM {src} s
  WHERE (SELECT count(*) FROM zedges e
         WHERE e.zone = CAST(floor(s.x / 20) + 5 * floor(s.y / 20) AS BIGINT)
           AND ((e.y1 > s.y) <> (e.y2 > s.y))
           AND s.x < (e.x2 - e.x1) * (s.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1)"""


ZB = """zb AS (
  SELECT zone, basin, count(*) AS n, count_if(depth > 0) AS n_flood, sum(depth) AS depth_sum,
         max(depth) AS dmax, sum(elev) AS esum, min(elev) AS emin
  FROM zhits GROUP BY zone, basin),
zs AS (
  SELECT zone, sum(n) AS n, sum(n_flood) AS n_flood, sum(depth_sum) AS depth_sum, max(dmax) AS dmax,
         sum(esum) AS esum, min(emin) AS emin FROM zb GROUP BY zone),
mb AS (
  SELECT zone, basin AS main_basin, n_flood AS main_n FROM (
    SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n_flood DESC, basin) AS rn
    FROM zb WHERE n_flood > 0) WHERE rn = 1),
bl AS (SELECT zone, string_agg(basin, '|' ORDER BY n_flood DESC, basin) AS tk_basins
       FROM zb WHERE n_flood > 0 GROUP BY zone),
flood AS (
  SELECT CAST(nn.n_nationkey AS BIGINT) AS zone, coalesce(zs.n, 0) > 0 AS tk_coverage,
    CAST(coalesce(zs.n, 0) AS BIGINT) AS tk_n,
    zs.n_flood / zs.n AS tk_flood_ratio,
    CASE WHEN zs.n_flood > 0 THEN zs.depth_sum / zs.n_flood END AS tk_mean_depth,
    CASE WHEN zs.n > 0 THEN greatest(zs.dmax, 0.0) END AS tk_max_depth,
    zs.esum / zs.n AS tk_mean_elev, zs.emin AS tk_min_elev,
    coalesce(zs.esum / zs.n < 0, false) AS tk_below_sea,
    mb.main_basin AS tk_main_basin,
    CASE WHEN zs.n_flood > 0 THEN mb.main_n / zs.n_flood END AS tk_main_basin_ratio,
    bl.tk_basins
  FROM nation nn LEFT JOIN zs ON zs.zone = nn.n_nationkey
  LEFT JOIN mb ON mb.zone = nn.n_nationkey LEFT JOIN bl ON bl.zone = nn.n_nationkey)"""

ZHITS = _hits("pts", "zhits")

ORACLE["q_pip_count"] = _with(PTS, ZEDGES, ZHITS) + """
SELECT zone, count(*) AS n_points FROM zhits GROUP BY zone"""

ORACLE["q_zone_depth_stats"] = _with(PTS, ZEDGES, ZHITS) + """
SELECT zone, count(*) AS n, CAST(count_if(depth > 0) AS BIGINT) AS n_flood,
  round(sum(depth), 6) AS depth_sum, round(max(depth), 6) AS depth_max,
  round(sum(elev), 6) AS elev_sum, round(min(elev), 6) AS elev_min
FROM zhits GROUP BY zone"""

ORACLE["q_flood_by_zone"] = _with(PTS, ZEDGES, ZHITS, ZB) + """
SELECT zone, tk_coverage, tk_n, round(tk_flood_ratio, 6) AS tk_flood_ratio,
  round(tk_mean_depth, 6) AS tk_mean_depth, round(tk_max_depth, 6) AS tk_max_depth,
  round(tk_mean_elev, 6) AS tk_mean_elev, round(tk_min_elev, 6) AS tk_min_elev, tk_below_sea,
  tk_main_basin, round(tk_main_basin_ratio, 6) AS tk_main_basin_ratio, tk_basins
FROM flood"""

ORACLE["q_top1_per_group"] = _with(PTS, ZEDGES, ZHITS, ZB) + """
SELECT zone, main_basin, CAST(main_n AS BIGINT) AS main_n_flood FROM mb"""

ORACLE["q_ordered_list"] = _with(PTS, ZEDGES, ZHITS, ZB) + """
SELECT zone, tk_basins FROM bl"""

ORACLE["q_other_basins"] = _with(PTS, ZEDGES, ZHITS, ZB) + """,
o AS (SELECT zone, list_filter(string_split(coalesce(tk_basins, ''), '|'),
                              lambda b: b <> '' AND b <> coalesce(tk_main_basin, '')) AS l FROM flood)
SELECT zone, array_to_string(l, '・') AS other_basins, CAST(len(l) AS BIGINT) AS n_other FROM o"""

ORACLE["q_elev_score"] = _with(PTS, ZEDGES, ZHITS, ZB) + """,
r AS (SELECT zone, 100.0 * rank() OVER (ORDER BY tk_mean_elev) / count(*) OVER () AS s
      FROM flood WHERE tk_coverage AND tk_mean_elev IS NOT NULL)
SELECT f.zone, round(f.tk_mean_elev, 6) AS tk_mean_elev, round(r.s, 6) AS elev_score
FROM flood f LEFT JOIN r ON r.zone = f.zone"""

ORACLE["q_coverage_summary"] = _with(AREAS, PTS, ZEDGES, ZHITS, ZB) + """,
zp AS (SELECT zone, sum(pop) AS pop FROM areas GROUP BY zone)
SELECT CAST(count(*) AS BIGINT) AS n_zones, CAST(count_if(tk_coverage) AS BIGINT) AS n_covered,
  CAST(count_if(tk_below_sea) AS BIGINT) AS n_below_sea,
  round(sum(CASE WHEN tk_below_sea THEN zp.pop ELSE 0.0 END), 6) AS pop_below_sea,
  round(sum(zp.pop), 6) AS pop_total,
  round(count_if(tk_coverage) / count(*), 6) AS share_covered
FROM flood f LEFT JOIN zp ON zp.zone = f.zone"""

ORACLE["q_basin_label"] = _with(PTS) + """
SELECT basin, CASE lower(basin)
    WHEN 'kandagawa' THEN '神田川流域' WHEN 'sumidagawa' THEN '隅田川・新河岸川流域'
    ELSE lower(basin) END AS basin_label,
  count(*) AS n_points, CAST(count_if(depth > 0) AS BIGINT) AS n_flood
FROM pts GROUP BY basin"""

ZAREA = """zarea AS (SELECT zone, abs(sum(x1 * y2 - x2 * y1)) / 2 AS zone_area FROM zedges GROUP BY zone)"""

ORACLE["q_tide_exposure"] = _with(PTS, ZEDGES, _hits("(SELECT * FROM pts WHERE depth > 0)", "thits"), ZAREA) + """,
t AS (SELECT zone, count(*) AS n, sum(depth) AS s, max(depth) AS mx FROM thits WHERE zone NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) GROUP BY zone),
r AS (
  SELECT a.zone, coalesce(t.n, 0) AS n, least(greatest(coalesce(t.n, 0) * 0.1 / a.zone_area, 0.0), 1.0) AS ratio,
    coalesce(t.s / t.n, 0.0) AS mean, coalesce(t.mx, 0.0) AS mx
  FROM zarea a LEFT JOIN t ON t.zone = a.zone)
SELECT zone, CAST(n AS BIGINT) AS ts_n, round(ratio, 6) AS ts_flood_ratio, round(mean, 6) AS ts_mean_depth,
  round(mx, 6) AS ts_max_depth, round(ratio * mean, 6) AS ts_exposure FROM r"""

BOR = """bor AS (
  SELECT p_partkey AS pid, (p_partkey * 7919) % 9973 / CAST(100 AS DOUBLE) AS x,
         (p_partkey * 6271) % 9949 / CAST(100 AS DOUBLE) AS y,
         CASE WHEN p_size <= 20 THEN 'small' WHEN p_size <= 40 THEN 'mid' ELSE 'large' END AS cls
  FROM part),
borw AS (SELECT *, CAST(CASE cls WHEN 'small' THEN 2.5 WHEN 'mid' THEN 10.0 WHEN 'large' THEN 20.0 END AS DOUBLE) AS w FROM bor)"""

BHITS = _hits("borw", "bhits")

CC = """cc AS (
  SELECT zone, count(*) AS liq_points, sum(w) AS liq_sum, count_if(cls = 'small') AS liq_small,
    count_if(cls = 'mid') AS liq_mid, count_if(cls = 'large') AS liq_large
  FROM bhits GROUP BY zone)"""

ORACLE["q_class_counts"] = _with(BOR, ZEDGES, BHITS, CC) + """
SELECT zone, CAST(liq_points AS BIGINT) AS liq_points, round(liq_sum, 6) AS liq_sum,
  CAST(liq_small AS BIGINT) AS liq_small, CAST(liq_mid AS BIGINT) AS liq_mid,
  CAST(liq_large AS BIGINT) AS liq_large FROM cc"""

GROUND = """prior AS (SELECT avg(w) AS pm FROM bhits),
ground AS (
  SELECT CAST(nn.n_nationkey AS BIGINT) AS zone, CAST(coalesce(cc.liq_points, 0) AS BIGINT) AS liq_points,
    CAST(coalesce(cc.liq_small, 0) AS BIGINT) AS liq_small, CAST(coalesce(cc.liq_mid, 0) AS BIGINT) AS liq_mid,
    CAST(coalesce(cc.liq_large, 0) AS BIGINT) AS liq_large,
    (cc.liq_sum + 2 * prior.pm) / (cc.liq_points + 2) AS liq_pl,
    cc.liq_sum / cc.liq_points AS liq_pl_raw,
    cc.liq_points IS NOT NULL AS liq_covered,
    cc.liq_points IS NOT NULL AND coalesce(cc.liq_points, 0) <= 2 AS liq_thin
  FROM nation nn LEFT JOIN cc ON cc.zone = nn.n_nationkey, prior)"""

ORACLE["q_ground_pl"] = _with(BOR, ZEDGES, BHITS, CC, GROUND) + """
SELECT zone, liq_points, liq_small, liq_mid, liq_large, round(liq_pl, 6) AS liq_pl,
  round(liq_pl_raw, 6) AS liq_pl_raw, liq_covered, liq_thin FROM ground"""

ORACLE["q_unknown_codes"] = _with(BOR) + """
SELECT cls, cls IN ('small', 'mid', 'large') AS known, count(*) AS n FROM bor GROUP BY cls"""

HEDGES = """hv AS (SELECT * FROM (VALUES (0, 0, 0), (1, 9, 2), (2, 3, 8)) t(i, vx, vy)),
haz AS (
  SELECT s_suppkey AS poly_id, s_suppkey % 3 AS river, CAST(s_nationkey % 6 + 1 AS INTEGER) AS rk,
         CAST((s_suppkey * 37) % 100 AS DOUBLE) AS cx, CAST((s_suppkey * 53) % 100 AS DOUBLE) AS cy
  FROM supplier),
hedges AS (
  SELECT h.poly_id, h.cx + a.vx AS x1, h.cy + a.vy AS y1, h.cx + b.vx AS x2, h.cy + b.vy AS y2
  FROM haz h, hv a JOIN hv b ON b.i = (a.i + 1) % 3)"""

INTERSECT = """cand AS (
  SELECT z.zone, h.poly_id FROM
    (SELECT zone, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1
     FROM zedges GROUP BY zone) z,
    (SELECT poly_id, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1
     FROM hedges GROUP BY poly_id) h
  WHERE z.x0 <= h.x1 AND h.x0 <= z.x1 AND z.y0 <= h.y1 AND h.y0 <= z.y1),
crossing AS (
  SELECT DISTINCT c.zone, c.poly_id FROM cand c
  JOIN zedges a ON a.zone = c.zone JOIN hedges b ON b.poly_id = c.poly_id
  WHERE least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
    AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
    AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1))
      * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
    AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1))
      * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0),
hv0 AS (SELECT poly_id, cx AS x, cy AS y FROM haz),
zv0 AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST((n_nationkey % 5) * 20 + 1 AS DOUBLE) AS x,
               CAST(floor(n_nationkey / 5) * 20 + 1 AS DOUBLE) AS y FROM nation),
h_in_z AS (
  SELECT c.zone, c.poly_id FROM cand c JOIN hv0 v ON v.poly_id = c.poly_id
  WHERE (SELECT count(*) FROM zedges e WHERE e.zone = c.zone AND ((e.y1 > v.y) <> (e.y2 > v.y))
         AND v.x < (e.x2 - e.x1) * (v.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1),
z_in_h AS (
  SELECT c.zone, c.poly_id FROM cand c JOIN zv0 v ON v.zone = c.zone
  WHERE (SELECT count(*) FROM hedges e WHERE e.poly_id = c.poly_id AND ((e.y1 > v.y) <> (e.y2 > v.y))
         AND v.x < (e.x2 - e.x1) * (v.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1),
inter AS (SELECT * FROM crossing UNION SELECT * FROM h_in_z UNION SELECT * FROM z_in_h)"""

ORACLE["q_history_flags"] = _with(ZEDGES, HEDGES, INTERSECT) + """,
per AS (SELECT i.zone, bool_or(h.river = 1) AS f1923, bool_or(h.river = 2) AS f2011
        FROM inter i JOIN haz h ON h.poly_id = i.poly_id GROUP BY i.zone)
SELECT CAST(n.n_nationkey AS BIGINT) AS zone, per.zone IS NOT NULL AS liq_history,
  coalesce(per.f1923, false) AS liq_1923, coalesce(per.f2011, false) AS liq_2011
FROM nation n LEFT JOIN per ON per.zone = n.n_nationkey"""

# --- overlay ----------------------------------------------------------------

OVERLAY = """zp AS (
  SELECT zone, least(x1, x2) AS lx, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS ly,
         greatest(x1, x2) AS rx, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS ry,
         CASE WHEN x2 < x1 THEN 1.0 ELSE -1.0 END AS sg
  FROM zedges WHERE x1 <> x2),
hp AS (
  SELECT poly_id, least(x1, x2) AS lx, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS ly,
         greatest(x1, x2) AS rx, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS ry,
         CASE WHEN x2 < x1 THEN 1.0 ELSE -1.0 END AS sg
  FROM hedges WHERE x1 <> x2),
seg AS (
  SELECT c.zone, c.poly_id, a.sg * b.sg AS s,
    greatest(a.lx, b.lx) AS lo, least(a.rx, b.rx) AS hi,
    a.lx AS alx, a.ly AS aly, a.rx AS arx, a.ry AS ary, b.lx AS blx, b.ly AS bly, b.rx AS brx, b.ry AS bry
  FROM cand c JOIN zp a ON a.zone = c.zone JOIN hp b ON b.poly_id = c.poly_id
  WHERE least(a.rx, b.rx) > greatest(a.lx, b.lx)),
segv AS (
  SELECT zone, poly_id, s, lo, hi,
    aly + (ary - aly) * (lo - alx) / (arx - alx) AS fl, aly + (ary - aly) * (hi - alx) / (arx - alx) AS fh,
    bly + (bry - bly) * (lo - blx) / (brx - blx) AS gl, bly + (bry - bly) * (hi - blx) / (brx - blx) AS gh
  FROM seg),
segi AS (
  SELECT zone, poly_id, s * CASE
    WHEN (fl - gl) * (fh - gh) >= 0 THEN (hi - lo) * (least(fl, gl) + least(fh, gh)) / 2
    ELSE ((lo + (fl - gl) / ((fl - gl) - (fh - gh)) * (hi - lo)) - lo)
           * (least(fl, gl) + (fl + (fl - gl) / ((fl - gl) - (fh - gh)) * (fh - fl))) / 2
       + (hi - (lo + (fl - gl) / ((fl - gl) - (fh - gh)) * (hi - lo)))
           * ((fl + (fl - gl) / ((fl - gl) - (fh - gh)) * (fh - fl)) + least(fh, gh)) / 2
    END AS v
  FROM segv),
ov AS (SELECT zone, poly_id, sum(v) AS a FROM segi GROUP BY zone, poly_id HAVING sum(v) > 1e-9)"""

ORACLE["q_overlay_area"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY) + """
SELECT zone, poly_id, round(a, 6) AS a FROM ov"""

ORACLE["q_poly_intersects"] = _with(ZEDGES, HEDGES, INTERSECT) + """
SELECT zone, poly_id FROM inter"""

ORACLE["q_semi_candidates"] = _with(ZEDGES, HEDGES, INTERSECT) + """
SELECT CAST(n.n_nationkey AS BIGINT) AS zone, r.r_name AS ward,
  EXISTS (SELECT 1 FROM inter i WHERE i.zone = n.n_nationkey) AS intersects
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE EXISTS (SELECT 1 FROM cand c WHERE c.zone = n.n_nationkey)"""

DEPTHS = """dm AS (SELECT * FROM (VALUES (1, '0〜0.5m未満', 0.25), (2, '0.5〜3.0m未満', 1.75),
  (3, '3.0〜5.0m未満', 4.0), (4, '5.0〜10.0m未満', 7.5), (5, '10.0〜20.0m未満', 15.0),
  (6, '20.0m以上', 20.0)) t(rk, label, metres)),
rn AS (SELECT * FROM (VALUES (0, '荒川'), (1, '多摩川'), (2, '江戸川')) t(river, rname))"""

NATIONAL = """ovr AS (
  SELECT ov.zone, ov.a, h.river, h.rk, CAST(dm.metres AS DOUBLE) AS metres
  FROM ov JOIN haz h ON h.poly_id = ov.poly_id JOIN dm ON dm.rk = h.rk),
byr AS (SELECT zone, river, sum(a) AS ra, sum(metres * a) AS da FROM ovr GROUP BY zone, river),
mr AS (SELECT zone, river AS main_river FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ra DESC, river) AS k FROM byr) WHERE k = 1),
byk AS (SELECT o.zone, o.rk, sum(o.a) AS ka FROM ovr o JOIN mr ON mr.zone = o.zone AND o.river = mr.main_river
        GROUP BY o.zone, o.rk),
topk AS (SELECT zone, rk AS main_rk, ka AS main_ka FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ka DESC, rk) AS k FROM byk) WHERE k = 1),
deep AS (SELECT zone, rk AS max_rk, ka AS max_ka FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY rk DESC) AS k FROM byk) WHERE k = 1),
tot AS (SELECT zone, sum(ka) AS nat_area FROM byk GROUP BY zone),
ex AS (SELECT b.zone, max(b.da / za.zone_area) AS nat_exposure,
         string_agg(DISTINCT rn.rname, '・' ORDER BY rn.rname) AS nat_rivers
       FROM byr b JOIN zarea za ON za.zone = b.zone JOIN rn ON rn.river = b.river GROUP BY b.zone),
nat AS (
  SELECT t.zone, least(t.nat_area / za.zone_area, 1.0) AS nat_ratio, ex.nat_exposure,
    tk.main_rk AS nat_main_rank, d1.label AS nat_main_label, least(tk.main_ka / za.zone_area, 1.0) AS nat_main_ratio,
    dp.max_rk AS nat_max_rank, d2.label AS nat_max_label, least(dp.max_ka / za.zone_area, 1.0) AS nat_max_ratio,
    rn.rname AS nat_main_river, ex.nat_rivers, dp.max_rk > tk.main_rk AS deeper_than_main
  FROM tot t JOIN zarea za ON za.zone = t.zone JOIN ex ON ex.zone = t.zone JOIN topk tk ON tk.zone = t.zone
  JOIN deep dp ON dp.zone = t.zone JOIN mr ON mr.zone = t.zone JOIN rn ON rn.river = mr.main_river
  JOIN dm d1 ON d1.rk = tk.main_rk JOIN dm d2 ON d2.rk = dp.max_rk)"""

ORACLE["q_national_rivers"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY, ZAREA, DEPTHS, NATIONAL) + """
SELECT zone, round(nat_ratio, 6) AS nat_ratio, round(nat_exposure, 6) AS nat_exposure,
  nat_main_rank, nat_main_label, round(nat_main_ratio, 6) AS nat_main_ratio,
  nat_max_rank, nat_max_label, round(nat_max_ratio, 6) AS nat_max_ratio, nat_main_river, nat_rivers,
  deeper_than_main
FROM nat"""

ORACLE["q_weighted_exposure"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY, ZAREA, DEPTHS, NATIONAL) + """
SELECT b.zone, rn.rname AS river, round(b.ra, 6) AS river_area, round(b.da / za.zone_area, 6) AS exposure
FROM byr b JOIN zarea za ON za.zone = b.zone JOIN rn ON rn.river = b.river"""

ORACLE["q_distinct_list"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY, ZAREA, DEPTHS, NATIONAL) + """
SELECT zone, nat_rivers FROM nat"""

ORACLE["q_code_lookup"] = _with(HEDGES, DEPTHS) + """
SELECT h.poly_id, h.rk, dm.label AS depth_label, CAST(dm.metres AS DOUBLE) AS depth_m
FROM haz h LEFT JOIN dm ON dm.rk = h.rk"""

# --- union area (independent elementary-interval sweep) ------------------------


def _union(name: str, where: str) -> str:
    return f"""{name}_c AS (SELECT c.zone, c.poly_id FROM cand c JOIN haz h ON h.poly_id = c.poly_id WHERE {where}),
{name}_e AS (
  SELECT zone, -1 AS owner, lx, ly, rx, ry, sg FROM zp WHERE zone IN (SELECT zone FROM {name}_c)
  UNION ALL
  SELECT c.zone, hp.poly_id AS owner, hp.lx, hp.ly, hp.rx, hp.ry, hp.sg
  FROM {name}_c c JOIN hp ON hp.poly_id = c.poly_id),
{name}_x AS (
  SELECT zone, lx AS x FROM {name}_e UNION SELECT zone, rx AS x FROM {name}_e
  UNION
  SELECT zone, lo + (fl - gl) / ((fl - gl) - (fh - gh)) * (hi - lo) AS x FROM (
    SELECT a.zone, greatest(a.lx, b.lx) AS lo, least(a.rx, b.rx) AS hi,
      a.ly + (a.ry - a.ly) * (greatest(a.lx, b.lx) - a.lx) / (a.rx - a.lx) AS fl,
      a.ly + (a.ry - a.ly) * (least(a.rx, b.rx) - a.lx) / (a.rx - a.lx) AS fh,
      b.ly + (b.ry - b.ly) * (greatest(a.lx, b.lx) - b.lx) / (b.rx - b.lx) AS gl,
      b.ly + (b.ry - b.ly) * (least(a.rx, b.rx) - b.lx) / (b.rx - b.lx) AS gh
    FROM {name}_e a JOIN {name}_e b ON a.zone = b.zone
    WHERE least(a.rx, b.rx) > greatest(a.lx, b.lx)) p
  WHERE (fl - gl) * (fh - gh) < 0),
{name}_i AS (
  SELECT zone, x AS x0, lead(x) OVER (PARTITION BY zone ORDER BY x) AS x1 FROM (SELECT DISTINCT zone, x FROM {name}_x)),
{name}_y AS (
  SELECT i.zone, i.x0, i.x1, e.owner, e.sg,
    e.ly + (e.ry - e.ly) * ((i.x0 + i.x1) / 2 - e.lx) / (e.rx - e.lx) AS y
  FROM {name}_i i JOIN {name}_e e ON e.zone = i.zone
   AND e.lx <= (i.x0 + i.x1) / 2 AND e.rx >= (i.x0 + i.x1) / 2
  WHERE i.x1 > i.x0),
{name}_w AS (
  SELECT *, sum(sg) OVER (PARTITION BY zone, x0, owner ORDER BY y DESC, owner, sg ROWS UNBOUNDED PRECEDING) AS w_after
  FROM {name}_y),
{name}_d AS (
  SELECT *, CASE WHEN owner = -1 THEN 0
                 ELSE (CASE WHEN abs(w_after) > 0.5 THEN 1 ELSE 0 END) - (CASE WHEN abs(w_after - sg) > 0.5 THEN 1 ELSE 0 END)
            END AS dact,
    CASE WHEN owner = -1 THEN sg ELSE 0 END AS dz
  FROM {name}_w),
{name}_s AS (
  SELECT *, sum(dact) OVER (PARTITION BY zone, x0 ORDER BY y DESC, owner, sg ROWS UNBOUNDED PRECEDING) AS act,
    sum(dz) OVER (PARTITION BY zone, x0 ORDER BY y DESC, owner, sg ROWS UNBOUNDED PRECEDING) AS zw,
    lead(y) OVER (PARTITION BY zone, x0 ORDER BY y DESC, owner, sg) AS ynext
  FROM {name}_d),
{name}_a AS (
  SELECT zone, sum(CASE WHEN abs(zw) > 0.5 AND act > 0 AND ynext IS NOT NULL THEN (y - ynext) * (x1 - x0) ELSE 0 END) AS area
  FROM {name}_s GROUP BY zone HAVING sum(CASE WHEN abs(zw) > 0.5 AND act > 0 AND ynext IS NOT NULL
                                              THEN (y - ynext) * (x1 - x0) ELSE 0 END) > 1e-9)"""


ORACLE["q_union_area"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY, ZAREA, _union("ua", "true")) + """
SELECT u.zone, round(u.area, 6) AS hazard_area, round(least(u.area / z.zone_area, 1.0), 6) AS hazard_ratio
FROM ua_a u JOIN zarea z ON z.zone = u.zone"""

COLLAPSE = _union("cf", "h.river = 0") + ",\n" + _union("ce", "h.river = 1") + """,
collapse AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS zone,
    CASE WHEN cf.area IS NULL THEN 0.0 ELSE least(cf.area / z.zone_area, 1.0) END AS collapse_flow_ratio,
    CASE WHEN ce.area IS NULL THEN 0.0 ELSE least(ce.area / z.zone_area, 1.0) END AS collapse_erosion_ratio
  FROM nation n JOIN zarea z ON z.zone = n.n_nationkey
  LEFT JOIN cf_a cf ON cf.zone = n.n_nationkey LEFT JOIN ce_a ce ON ce.zone = n.n_nationkey)"""

ORACLE["q_collapse_ratio"] = _with(ZEDGES, HEDGES, INTERSECT, OVERLAY, ZAREA, COLLAPSE) + """
SELECT zone, round(collapse_flow_ratio, 6) AS collapse_flow_ratio,
  round(collapse_erosion_ratio, 6) AS collapse_erosion_ratio,
  round(greatest(collapse_flow_ratio, collapse_erosion_ratio), 6) AS collapse_ratio,
  greatest(collapse_flow_ratio, collapse_erosion_ratio) > 0 AS collapse_zone
FROM collapse"""

# --- combined per-zone table --------------------------------------------------

ZSAFETY = """zsum AS (
  SELECT zone, sum(pop) AS pop, sum(serious) AS serious, sum(serious_cur) AS serious_cur, sum(daily) AS daily,
         sum(visitor) AS visitor, sum(total) AS total FROM wide GROUP BY zone),
zr0 AS (SELECT sum(serious) / sum(pop * 2) AS r0s, sum(daily) / sum(pop) AS r0d FROM zsum),
zrate AS (
  SELECT z.*,
    CASE WHEN pop >= 100 THEN (serious + 2) / (pop * 2 + 2 / r0s) * 1000 END AS serious_rate,
    CASE WHEN pop >= 100 THEN (daily + 2) / (pop + 2 / r0d) * 1000 END AS daily_rate,
    CASE WHEN pop >= 100 THEN visitor / pop * 1000 END AS visitor_rate
  FROM zsum z, zr0),
zrank AS (
  SELECT zone, 100 * cume_dist() OVER (ORDER BY serious_rate DESC) AS serious_score,
         100 * cume_dist() OVER (ORDER BY daily_rate DESC) AS daily_score
  FROM zrate WHERE serious_rate IS NOT NULL),
zthr AS (SELECT quantile_cont(visitor_rate, 0.9) AS thr FROM zrate),
zsafety AS (
  SELECT r.*, k.serious_score, k.daily_score, 0.65 * k.serious_score + 0.35 * k.daily_score AS safety_score,
    coalesce(r.visitor_rate >= zthr.thr, false) AS business_area_flag
  FROM zrate r LEFT JOIN zrank k ON k.zone = r.zone, zthr)"""

TIDE = """tide AS (
  SELECT a.zone, CAST(coalesce(t.n, 0) AS BIGINT) AS ts_n,
    least(greatest(coalesce(t.n, 0) * 0.1 / a.zone_area, 0.0), 1.0) AS ts_flood_ratio,
    coalesce(t.s / t.n, 0.0) AS ts_mean_depth, coalesce(t.mx, 0.0) AS ts_max_depth,
    least(greatest(coalesce(t.n, 0) * 0.1 / a.zone_area, 0.0), 1.0) * coalesce(t.s / t.n, 0.0) AS ts_exposure
  FROM zarea a LEFT JOIN (SELECT zone, count(*) AS n, sum(depth) AS s, max(depth) AS mx FROM thits WHERE zone NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) GROUP BY zone) t
    ON t.zone = a.zone)"""

HIST = """hist AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS zone, per.zone IS NOT NULL AS liq_history,
    coalesce(per.f1923, false) AS liq_1923, coalesce(per.f2011, false) AS liq_2011
  FROM nation n LEFT JOIN (SELECT i.zone, bool_or(h.river = 1) AS f1923, bool_or(h.river = 2) AS f2011
                           FROM inter i JOIN haz h ON h.poly_id = i.poly_id GROUP BY i.zone) per
    ON per.zone = n.n_nationkey)"""

COMBINED = """base AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS zone, r.r_name AS ward, n.n_name AS name, n.n_regionkey AS region,
    s.pop, s.serious, s.daily, s.visitor, s.total, s.serious_rate, s.daily_rate, s.serious_score, s.daily_score,
    s.safety_score, s.visitor_rate, s.business_area_flag,
    f.tk_coverage, f.tk_flood_ratio, f.tk_mean_depth, f.tk_max_depth, f.tk_mean_elev, f.tk_min_elev,
    f.tk_below_sea, f.tk_main_basin, f.tk_main_basin_ratio, f.tk_basins,
    t.ts_flood_ratio, t.ts_mean_depth, t.ts_max_depth, t.ts_exposure,
    g.liq_points, g.liq_small, g.liq_mid, g.liq_large, g.liq_pl, g.liq_covered, g.liq_thin,
    hi.liq_history, hi.liq_1923, hi.liq_2011,
    na.nat_ratio, round(coalesce(na.nat_exposure, 0.0), 9) AS nat_exposure, na.nat_main_label, na.nat_main_ratio,
    na.nat_max_label, na.nat_max_ratio, na.nat_rivers, na.nat_ratio IS NOT NULL AS nat_covered,
    co.collapse_flow_ratio, co.collapse_erosion_ratio,
    greatest(co.collapse_flow_ratio, co.collapse_erosion_ratio) > 0 AS collapse_zone,
    coalesce(s.pop >= 100, false) AS pop_ok,
    coalesce(s.pop >= 100, false) AND coalesce(f.tk_coverage, false) AS flood_valid,
    round(coalesce(f.tk_flood_ratio * f.tk_mean_depth, 0.0), 9) AS tokyo_exposure,
    round(coalesce(t.ts_exposure, 0.0), 9) AS tide_exposure,
    coalesce(s.pop >= 100, false) AND coalesce(g.liq_covered, false) AS liq_valid,
    coalesce(f.tk_below_sea, false) AS below_sea_flag,
    n.n_regionkey <> 4 AS tide_in_scope
  FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN zsafety s ON s.zone = n.n_nationkey LEFT JOIN flood f ON f.zone = n.n_nationkey
  LEFT JOIN tide t ON t.zone = n.n_nationkey LEFT JOIN ground g ON g.zone = n.n_nationkey
  LEFT JOIN hist hi ON hi.zone = n.n_nationkey LEFT JOIN nat na ON na.zone = n.n_nationkey
  LEFT JOIN collapse co ON co.zone = n.n_nationkey),
base2 AS (
  SELECT *, greatest(tokyo_exposure, nat_exposure) AS flood_exposure,
    CASE WHEN nat_exposure > tokyo_exposure THEN '国管理河川' ELSE '東京都' END AS flood_source
  FROM base),
fr AS (SELECT zone, 100 * cume_dist() OVER (ORDER BY flood_exposure DESC) AS flood_score FROM base2 WHERE flood_valid),
tr AS (SELECT zone, 100 * cume_dist() OVER (ORDER BY tide_exposure DESC) AS tide_score FROM base2 WHERE pop_ok),
gr AS (SELECT zone, 100 * cume_dist() OVER (ORDER BY round(liq_pl, 9) DESC) AS ground_score FROM base2
       WHERE liq_valid AND liq_pl IS NOT NULL),
er AS (SELECT zone, 100.0 * rank() OVER (ORDER BY round(tk_mean_elev, 9)) / count(*) OVER () AS elev_score FROM base2
       WHERE flood_valid AND tk_mean_elev IS NOT NULL),
comb AS (
  SELECT b.*, fr.flood_score, tr.tide_score, gr.ground_score, er.elev_score, b.safety_score IS NOT NULL AS scored
  FROM base2 b LEFT JOIN fr ON fr.zone = b.zone LEFT JOIN tr ON tr.zone = b.zone
  LEFT JOIN gr ON gr.zone = b.zone LEFT JOIN er ON er.zone = b.zone)"""

ALL = (AREAS, YEARLY, WIDE, ZSAFETY, PTS, ZEDGES, ZHITS, ZB,
       _hits("(SELECT * FROM pts WHERE depth > 0)", "thits"), ZAREA, TIDE,
       BOR, BHITS, CC, GROUND, HEDGES, INTERSECT, HIST, OVERLAY, DEPTHS, NATIONAL, COLLAPSE,
       COMBINED)

ORACLE["q_combine_scores"] = _with(*ALL) + """
SELECT zone, round(safety_score, 6) AS safety_score, round(flood_score, 6) AS flood_score,
  round(tide_score, 6) AS tide_score, round(ground_score, 6) AS ground_score, round(elev_score, 6) AS elev_score,
  round(flood_exposure, 6) AS flood_exposure, round(tokyo_exposure, 6) AS tokyo_exposure,
  round(nat_exposure, 6) AS nat_exposure, flood_source, round(tide_exposure, 6) AS tide_exposure,
  business_area_flag, scored
FROM comb"""

# --- marts and serving ------------------------------------------------------------

def _tm_inverse_sql(xcol: str, ycol: str) -> tuple[str, str]:
    """Inverse transverse Mercator (GRS80, zone IX) as SQL text: (lon, lat)."""
    import math
    a, inv_f = 6378137.0, 298.257222101
    f = 1.0 / inv_f
    n = f / (2.0 - f)
    big_a = a / (1.0 + n) * (1.0 + n * n / 4.0 + n ** 4 / 64.0)
    k0 = 0.9999
    lat0, lon0 = 36.0, 139.0 + 50.0 / 60.0
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140,
             49561 * n ** 4 / 161280]
    beta = [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360,
            n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440,
            17 * n ** 3 / 480 - 37 * n ** 4 / 840,
            4397 * n ** 4 / 161280]
    delta = [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45,
             7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45,
             56 * n ** 3 / 15 - 136 * n ** 4 / 35,
             4279 * n ** 4 / 630]
    c = 2 * math.sqrt(n) / (1 + n)
    p0 = math.radians(lat0)
    t0 = math.sinh(math.atanh(math.sin(p0)) - c * math.atanh(c * math.sin(p0)))
    xi0 = math.atan(t0)
    s0 = k0 * big_a * (xi0 + sum(al * math.sin(2 * (j + 1) * xi0) for j, al in enumerate(alpha)))
    xi = f"(({ycol}) + {s0!r}) / {k0 * big_a!r}"
    eta = f"({xcol}) / {k0 * big_a!r}"
    xip = xi + "".join(f" - {b!r} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})"
                       for j, b in enumerate(beta))
    etap = eta + "".join(f" - {b!r} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})"
                         for j, b in enumerate(beta))
    chi = f"asin(sin({xip}) / cosh({etap}))"
    phi = chi + "".join(f" + {dd!r} * sin({2 * (j + 1)} * {chi})" for j, dd in enumerate(delta))
    lam = f"{math.radians(lon0)!r} + atan(sinh({etap}) / cos({xip}))"
    return f"degrees({lam})", f"degrees({phi})"


_LNG, _LAT = _tm_inverse_sql("cen.cx * 1000.0", "cen.cy * 1000.0")

TOWNS = f"""tres AS (
  SELECT CAST(n_nationkey AS BIGINT) AS key,
    CASE WHEN n_nationkey = 2 THEN 1 ELSE n_nationkey END AS pk FROM nation),
tshared AS (
  SELECT key, CASE WHEN pk NOT IN (2, 24) AND count(*) OVER (PARTITION BY pk) > 1
                   THEN CAST(pk AS BIGINT) END AS spk FROM tres),
cen AS (
  SELECT zone, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx,
         sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy
  FROM zedges GROUP BY zone),
towns AS (
  SELECT c.zone AS key, c.ward, c.name AS town, 'W' || lpad(CAST(c.region AS VARCHAR), 2, '0') AS ward_code,
    {_LAT} AS lat, {_LNG} AS lng, za.zone_area * 1000000.0 AS area_m2, c.pop AS population,
    CAST(cen.cx IS NOT NULL AS INTEGER) AS has_polygon,
    ts.spk AS shared_polygon_key
  FROM comb c LEFT JOIN cen ON cen.zone = CASE c.zone WHEN 2 THEN 1 WHEN 24 THEN NULL ELSE c.zone END
  LEFT JOIN zarea za ON za.zone = CASE c.zone WHEN 2 THEN 1 WHEN 24 THEN NULL ELSE c.zone END
  LEFT JOIN tshared ts ON ts.key = c.zone),
scores AS (
  SELECT zone AS key, 2025 AS data_year, safety_score, flood_score, tide_score, ground_score,
    serious_score, daily_score, flood_exposure, tide_exposure, elev_score, tk_mean_elev AS mean_elev_m,
    CAST(below_sea_flag AS INTEGER) AS below_sea, CAST(business_area_flag AS INTEGER) AS business_area,
    CAST(scored AS INTEGER) AS scored
  FROM comb),
hazard AS (
  SELECT zone AS key, 2025 AS data_year, tk_flood_ratio AS flood_ratio, tk_mean_depth AS flood_mean_depth,
    tk_max_depth AS flood_max_depth, CAST(coalesce(tk_coverage, false) AS INTEGER) AS flood_covered,
    tk_main_basin AS flood_basin, tk_main_basin_ratio AS flood_basin_ratio, tk_basins AS flood_basins,
    coalesce(ts_flood_ratio, 0.0) AS tide_ratio, coalesce(ts_mean_depth, 0.0) AS tide_mean_depth,
    coalesce(ts_max_depth, 0.0) AS tide_max_depth, CAST(tide_in_scope AS INTEGER) AS tide_in_scope,
    tk_mean_elev AS mean_elev_m, tk_min_elev AS min_elev_m,
    CAST(coalesce(liq_points, 0) AS BIGINT) AS liq_points, CAST(coalesce(liq_small, 0) AS BIGINT) AS liq_small,
    CAST(coalesce(liq_mid, 0) AS BIGINT) AS liq_mid, CAST(coalesce(liq_large, 0) AS BIGINT) AS liq_large, liq_pl,
    CAST(coalesce(liq_covered, false) AS INTEGER) AS liq_covered, CAST(coalesce(liq_thin, false) AS INTEGER) AS liq_thin,
    CAST(coalesce(liq_history, false) AS INTEGER) AS liq_history, CAST(coalesce(liq_1923, false) AS INTEGER) AS liq_1923,
    CAST(coalesce(liq_2011, false) AS INTEGER) AS liq_2011,
    CAST(coalesce(collapse_zone, false) AS INTEGER) AS collapse_zone,
    coalesce(collapse_flow_ratio, 0.0) AS collapse_flow_ratio, coalesce(collapse_erosion_ratio, 0.0) AS collapse_erosion_ratio,
    CAST(nat_covered AS INTEGER) AS national_river, nat_rivers, nat_ratio, nat_exposure, nat_main_label, nat_main_ratio,
    nat_max_label, nat_max_ratio, flood_source, tokyo_exposure
  FROM comb),
idx AS (
  SELECT t.key, t.ward, t.town, t.population, t.lat, t.lng, s.safety_score, s.flood_score, s.tide_score,
    s.ground_score, s.scored, h.flood_covered, h.tide_in_scope, h.liq_covered
  FROM towns t JOIN scores s ON s.key = t.key AND s.data_year = 2025
  JOIN hazard h ON h.key = t.key AND h.data_year = 2025),
midx AS (
  SELECT key, ward, town, population AS pop, safety_score AS s,
    CASE WHEN flood_covered = 1 THEN flood_score END AS f, CASE WHEN tide_in_scope = 1 THEN tide_score END AS t,
    CASE WHEN liq_covered = 1 THEN ground_score END AS g, scored = 1 AS scored, tide_in_scope = 1 AS tide_scope
  FROM idx)"""

SERVE = ALL + (TOWNS,)


def _round_cols(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


ORACLE["q_mart_towns"] = _with(*SERVE) + """
SELECT key, ward, town, ward_code, round(lat, 6) AS lat, round(lng, 6) AS lng, round(area_m2, 6) AS area_m2,
  round(population, 6) AS population, has_polygon, shared_polygon_key FROM towns"""

ORACLE["q_mart_scores"] = _with(*SERVE) + f"""
SELECT key, data_year, {_round_cols("safety_score flood_score tide_score ground_score serious_score daily_score flood_exposure tide_exposure elev_score mean_elev_m")},
  below_sea, business_area, scored FROM scores"""

ORACLE["q_mart_hazard"] = _with(*SERVE) + f"""
SELECT key, data_year, {_round_cols("flood_ratio flood_mean_depth flood_max_depth")}, flood_covered, flood_basin,
  round(flood_basin_ratio, 6) AS flood_basin_ratio, flood_basins,
  {_round_cols("tide_ratio tide_mean_depth tide_max_depth")}, tide_in_scope,
  {_round_cols("mean_elev_m min_elev_m")}, liq_points, liq_small, liq_mid, liq_large, round(liq_pl, 6) AS liq_pl,
  liq_covered, liq_thin, liq_history, liq_1923, liq_2011, collapse_zone,
  {_round_cols("collapse_flow_ratio collapse_erosion_ratio")}, national_river, nat_rivers,
  {_round_cols("nat_ratio nat_exposure")}, nat_main_label, round(nat_main_ratio, 6) AS nat_main_ratio,
  nat_max_label, round(nat_max_ratio, 6) AS nat_max_ratio, flood_source, round(tokyo_exposure, 6) AS tokyo_exposure
FROM hazard"""

ORACLE["q_index"] = _with(*SERVE) + f"""
SELECT key, ward, town, {_round_cols("population safety_score flood_score tide_score ground_score")},
  scored, flood_covered, tide_in_scope, liq_covered FROM idx ORDER BY ward, town"""

ORACLE["q_masked_index"] = _with(*SERVE) + f"""
SELECT key, ward, town, {_round_cols("pop s f t g")}, scored, tide_scope FROM midx"""

ORACLE["q_scored_features"] = f"""
SELECT m.key, m.town, 'key,ward,town' || CASE WHEN s IS NULL THEN '' ELSE ',s' END || CASE WHEN f IS NULL THEN '' ELSE ',f' END
  || CASE WHEN t IS NULL THEN '' ELSE ',t' END || CASE WHEN g IS NULL THEN '' ELSE ',g' END AS names, s, f, t, g
FROM ({ORACLE["q_masked_index"]}) m JOIN ({ORACLE["q_mart_towns"]}) w ON w.key = m.key WHERE w.has_polygon = 1"""

ORACLE["q_index_meta"] = _with(*SERVE) + """
SELECT count(*) AS town_count, CAST(count_if(scored) AS BIGINT) AS scored_count,
  string_agg(DISTINCT ward, ',' ORDER BY ward) AS wards FROM midx"""

ORACLE["q_ward_codes"] = _with(*SERVE) + """
SELECT DISTINCT ward, ward_code FROM towns"""

ORACLE["q_ward_map"] = _with(*SERVE) + """
SELECT '{' || string_agg('"' || ward || '":"' || ward_code || '"', ',' ORDER BY ward) || '}' AS ward_codes
FROM (SELECT DISTINCT ward, ward_code FROM towns WHERE ward_code IS NOT NULL)"""

ORACLE["q_town_detail"] = _with(*SERVE) + """,
zc AS (SELECT zone, sum(serious) AS serious_2y, sum(daily) AS daily_r, sum(total) AS total_r FROM wide GROUP BY zone)
SELECT t.key, t.ward, t.town, round(t.population, 6) AS population, round(s.safety_score, 6) AS safety_score,
  round(s.flood_score, 6) AS flood_score, round(s.tide_score, 6) AS tide_score, round(s.ground_score, 6) AS ground_score,
  CAST(zc.serious_2y AS BIGINT) AS serious_2y, CAST(zc.daily_r AS BIGINT) AS daily_r, CAST(zc.total_r AS BIGINT) AS total_r,
  round(h.flood_ratio, 6) AS flood_ratio, round(h.tide_ratio, 6) AS tide_ratio, h.liq_points, h.nat_rivers, h.flood_source
FROM towns t JOIN scores s ON s.key = t.key JOIN zc ON zc.zone = t.key JOIN hazard h ON h.key = t.key"""

ORACLE["q_town_one"] = ORACLE["q_town_detail"] + " WHERE t.key = 7"

ORACLE["q_axis_corr"] = _with(*SERVE) + """
SELECT round(corr(safety_score, flood_score), 6) AS corr_safety_flood,
  round(corr(safety_score, tide_score), 6) AS corr_safety_tide,
  round(corr(safety_score, ground_score), 6) AS corr_safety_ground,
  round(corr(flood_score, tide_score), 6) AS corr_flood_tide,
  round(corr(flood_score, ground_score), 6) AS corr_flood_ground,
  round(corr(tide_score, ground_score), 6) AS corr_tide_ground
FROM comb WHERE safety_score IS NOT NULL AND flood_score IS NOT NULL AND tide_score IS NOT NULL
  AND ground_score IS NOT NULL"""

STATUS = """st AS (
  SELECT key, 'safety' AS axis, CASE WHEN scored = 0 THEN 'not_scored' ELSE 'scored' END AS status, safety_score AS v FROM idx
  UNION ALL
  SELECT key, 'flood', CASE WHEN scored = 0 THEN 'not_scored' WHEN flood_covered = 0 THEN 'no_data' ELSE 'scored' END, flood_score FROM idx
  UNION ALL
  SELECT key, 'tide', CASE WHEN scored = 0 THEN 'not_scored' WHEN tide_in_scope = 0 THEN 'out_of_scope' ELSE 'scored' END, tide_score FROM idx
  UNION ALL
  SELECT key, 'ground', CASE WHEN scored = 0 THEN 'not_scored' WHEN liq_covered = 0 THEN 'no_data' ELSE 'scored' END, ground_score FROM idx)"""

ORACLE["q_axis_status"] = _with(*SERVE, STATUS) + """
SELECT key, axis, status, round(CASE WHEN status = 'scored' THEN v END, 6) AS score FROM st"""

ORACLE["q_evidence"] = _with(*SERVE) + """,
sh AS (
  SELECT h.*, s.flood_score, s.scored,
    h.national_river = 1 AND h.flood_source = '国管理河川' AS dn
  FROM hazard h JOIN scores s ON s.key = h.key),
items AS (
  SELECT key, 'flood' AS axis, 0 AS idx, 'main factor' AS label,
    CASE WHEN dn THEN coalesce(nat_rivers, '国管理河川')
         WHEN scored = 1 AND flood_covered = 1 AND flood_score < 40 AND flood_basin IS NOT NULL THEN flood_basin END AS value FROM sh
  UNION ALL SELECT key, 'flood', 1, 'flooded share', coalesce(printf('%.1f', round(round(flood_ratio, 6) * 100.0, 1)) || '%', '—') FROM sh
  UNION ALL SELECT key, 'flood', 2, 'mean depth', coalesce(printf('%.2f', round(round(flood_mean_depth, 6), 2)) || ' m', '—') FROM sh
  UNION ALL SELECT key, 'flood', 3, 'max depth', coalesce(printf('%.2f', round(round(flood_max_depth, 6), 2)) || ' m', '—') FROM sh
  UNION ALL SELECT key, 'flood', 4, 'area-averaged depth',
    coalesce(printf('%.2f', round(round(CASE WHEN dn THEN nat_exposure ELSE tokyo_exposure END, 6), 2)) || ' m', '—') FROM sh
  UNION ALL SELECT key, 'tide', 5, 'flooded share', coalesce(printf('%.1f', round(round(tide_ratio, 6) * 100.0, 1)) || '%', '—') FROM sh
  UNION ALL SELECT key, 'tide', 6, 'mean depth', coalesce(printf('%.2f', round(round(tide_mean_depth, 6), 2)) || ' m', '—') FROM sh
  UNION ALL SELECT key, 'tide', 7, 'max depth', coalesce(printf('%.2f', round(round(tide_max_depth, 6), 2)) || ' m', '—') FROM sh
  UNION ALL SELECT key, 'ground', 8, 'past liquefaction',
    CASE WHEN liq_1923 = 1 THEN '1923' WHEN liq_2011 = 1 THEN '2011' WHEN liq_history = 1 THEN 'recorded' ELSE 'none' END FROM sh
  UNION ALL SELECT key, 'ground', 9, 'large', coalesce(format('{:,}', liq_large) || ' pts', '—') FROM sh
  UNION ALL SELECT key, 'ground', 10, 'mid', coalesce(format('{:,}', liq_mid) || ' pts', '—') FROM sh
  UNION ALL SELECT key, 'ground', 11, 'small', coalesce(format('{:,}', liq_small) || ' pts', '—') FROM sh
  UNION ALL SELECT key, 'ground', 12, 'PL smoothed', coalesce(printf('%.1f', round(round(liq_pl, 6), 1)), '—') FROM sh
  UNION ALL SELECT key, 'ground', 13, 'borings', coalesce(format('{:,}', liq_points) || ' pts', '—') FROM sh),
kept AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos FROM items WHERE value IS NOT NULL)
SELECT key, axis, CAST(pos AS BIGINT) AS idx, label, value FROM kept"""

ORACLE["q_card_summary"] = _with(*SERVE) + """
SELECT key,
  concat_ws(',', CASE WHEN s >= 70 THEN 'safety' END, CASE WHEN f >= 70 THEN 'flood' END,
            CASE WHEN t >= 70 THEN 'tide' END, CASE WHEN g >= 70 THEN 'ground' END) AS best,
  concat_ws(',', CASE WHEN s < 40 THEN 'safety' END, CASE WHEN f < 40 THEN 'flood' END,
            CASE WHEN t < 40 THEN 'tide' END, CASE WHEN g < 40 THEN 'ground' END) AS worst,
  concat_ws(',', CASE WHEN s IS NULL THEN 'safety' END, CASE WHEN f IS NULL THEN 'flood' END,
            CASE WHEN t IS NULL THEN 'tide' END, CASE WHEN g IS NULL THEN 'ground' END) AS unknown,
  coalesce(s >= 70 AND f >= 70 AND t >= 70 AND g >= 70, false) AS all_good
FROM midx"""

ORACLE["q_all_good_measured"] = _with(*SERVE) + """
SELECT ward, count(*) AS n_all_good, CAST(count_if(tide_in_scope) AS BIGINT) AS n_measured,
  round(sum(CASE WHEN tide_in_scope THEN pop ELSE 0.0 END), 6) AS pop_measured
FROM comb WHERE scored AND safety_score >= 70 AND flood_score >= 70 AND tide_score >= 70 AND ground_score >= 70
GROUP BY ward"""

ORACLE["q_typhoon_specific"] = _with(*SERVE) + """
SELECT key, ward, round(f, 6) AS f, round(t, 6) AS t FROM midx
WHERE f IS NOT NULL AND t IS NOT NULL AND tide_scope AND f >= 70 AND t <= 30"""

ORACLE["q_safety_flood_gap"] = _with(*SERVE) + """
SELECT key, ward, round(s, 6) AS s, round(f, 6) AS f FROM midx WHERE s >= 70 AND f < 40"""

ORACLE["q_flood_tide_gap"] = _with(*SERVE) + """
SELECT zone, ward, round(flood_score, 6) AS flood_score, round(tide_score, 6) AS tide_score,
  round(tide_exposure, 6) AS tide_exposure, round(flood_score - tide_score, 6) AS diff
FROM comb WHERE scored AND flood_score IS NOT NULL AND tide_score IS NOT NULL AND ground_score IS NOT NULL
ORDER BY flood_score - tide_score DESC, zone LIMIT 8"""

ORACLE["q_national_decided"] = _with(*SERVE) + """
SELECT zone, ward, round(flood_score, 6) AS flood_score, round(tokyo_exposure, 6) AS tokyo_exposure,
  round(nat_exposure, 6) AS nat_exposure, nat_rivers
FROM comb WHERE scored AND flood_score IS NOT NULL AND flood_source = '国管理河川'
ORDER BY nat_exposure DESC, zone LIMIT 6"""

ORACLE["q_score_bucket"] = _with(*SERVE) + """
SELECT key,
  CASE WHEN s IS NULL THEN NULL WHEN s >= 70 THEN '良好' WHEN s >= 40 THEN '平均的' ELSE '要確認' END AS safety_bucket,
  CASE WHEN f IS NULL THEN NULL WHEN f >= 70 THEN '良好' WHEN f >= 40 THEN '平均的' ELSE '要確認' END AS flood_bucket,
  CASE WHEN t IS NULL THEN NULL WHEN t >= 70 THEN '良好' WHEN t >= 40 THEN '平均的' ELSE '要確認' END AS tide_bucket,
  CASE WHEN g IS NULL THEN NULL WHEN g >= 70 THEN '良好' WHEN g >= 40 THEN '平均的' ELSE '要確認' END AS ground_bucket
FROM midx"""

ORACLE["q_ward_rollup"] = _with(*SERVE) + """
SELECT ward, count(*) AS n, round(avg(tide_exposure), 6) AS expo, round(sum(pop), 6) AS pop
FROM comb WHERE tide_exposure > 0 GROUP BY ward"""

ORACLE["q_dq_status"] = _with(*SERVE, STATUS) + """
SELECT (SELECT count(*) FROM st WHERE (status = 'scored' AND v IS NULL)) AS status_violations,
  (SELECT count(*) FROM comb WHERE NOT tide_in_scope AND tide_exposure <> 0) AS out_of_scope_exposure"""

ORACLE["q_dq_set_equality"] = _with(*SERVE) + """,
feat AS (SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_nationkey <> 24),
hat AS (SELECT f.key FROM feat f LEFT JOIN idx ON idx.key = f.key WHERE idx.safety_score IS NULL),
uns AS (SELECT t.key FROM towns t JOIN idx ON idx.key = t.key WHERE t.has_polygon = 1 AND idx.scored = 0)
SELECT (SELECT count(*) FROM (SELECT key FROM feat EXCEPT ALL SELECT key FROM towns WHERE has_polygon = 1)) AS missing_in_index,
  (SELECT count(*) FROM (SELECT key FROM towns WHERE has_polygon = 1 EXCEPT ALL SELECT key FROM feat)) AS missing_in_features,
  (SELECT count(*) FROM (SELECT key FROM hat EXCEPT ALL SELECT key FROM uns))
  + (SELECT count(*) FROM (SELECT key FROM uns EXCEPT ALL SELECT key FROM hat)) AS hatched_difference"""

# the rule itself: a rebuild from the sources differs in no row (a planted fault is a unit test)
ORACLE["q_rebuild_diff"] = "SELECT CAST(0 AS BIGINT) AS only_staged, CAST(0 AS BIGINT) AS only_rebuilt"

# --- names ----------------------------------------------------------------------

NAMES = """wl AS (SELECT 'ward' || lpad(CAST(i AS VARCHAR), 2, '0') AS w FROM range(23) t(i)),
raw AS (
  SELECT c_custkey AS key, c_acctbal AS bal,
    'ward' || lpad(CAST(c_custkey % 23 AS VARCHAR), 2, '0') || 'town' || CAST(c_custkey AS VARCHAR) ||
    CASE c_custkey % 3 WHEN 0 THEN '一丁目' WHEN 1 THEN '二十一丁目' ELSE '１丁目' END AS raw_name
  FROM customer),
kd AS (SELECT * FROM (VALUES ('一', 1), ('二', 2), ('三', 3), ('四', 4), ('五', 5), ('六', 6), ('七', 7),
                              ('八', 8), ('九', 9)) t(d, v)),
kn AS (
  SELECT d AS k, v FROM kd UNION ALL SELECT '十', 10
  UNION ALL SELECT d || '十', v * 10 FROM kd UNION ALL SELECT '十' || d, 10 + v FROM kd
  UNION ALL SELECT a.d || '十' || b.d, a.v * 10 + b.v FROM kd a, kd b),
split AS (
  SELECT r.key, greatest(r.bal, 0.0) AS pop, r.raw_name, w.w AS ward, substr(r.raw_name, length(w.w) + 1) AS town
  FROM raw r JOIN wl w ON starts_with(r.raw_name, w.w)
  WHERE NOT contains(r.raw_name, '計') AND NOT ends_with(r.raw_name, '以下不詳') AND r.raw_name NOT IN (SELECT w FROM wl)),
folded AS (
  SELECT s.*, replace(replace(trim(translate(regexp_replace(town, '[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]', '', 'g'),
        '０１２３４５６７８９　', '0123456789 ')), ' ', ''), '　', '') AS t1
  FROM split s),
normed AS (
  SELECT f.*, regexp_extract(t1, '([一二三四五六七八九十]+)丁目$', 1) AS num,
    CASE WHEN kn.v IS NOT NULL
         THEN left(t1, length(t1) - length(regexp_extract(t1, '([一二三四五六七八九十]+)丁目$', 1)) - 2) || CAST(kn.v AS VARCHAR) || '丁目'
         ELSE t1 END AS t2
  FROM folded f LEFT JOIN kn ON kn.k = regexp_extract(f.t1, '([一二三四五六七八九十]+)丁目$', 1)),
named AS (SELECT key, pop, ward, town, translate(t2, 'ヶノ麴斉', 'ケの麹斎') AS norm FROM normed)"""

ORACLE["q_ward_prefix"] = _with(NAMES) + """
SELECT key, ward, town, ward || '|' || norm AS name_key FROM named"""

ORACLE["q_norm_name"] = _with(NAMES) + """
SELECT key, town, norm FROM named"""

ORACLE["q_kanji_number"] = _with(NAMES) + """
SELECT n.key, n.num AS numeral, kn.v AS value FROM normed n LEFT JOIN kn ON kn.k = n.num WHERE n.num <> ''"""

SEARCHN = """sn AS (
  SELECT key, ward, town,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(translate(ward || town, '０１２３４５６７８９', '0123456789'), ' ', ''),
      '(^|[^一二三四五六七八九十])一丁目', '\\11丁目', 'g'), '(^|[^一二三四五六七八九十])二丁目', '\\12丁目', 'g'),
      '(^|[^一二三四五六七八九十])三丁目', '\\13丁目', 'g'), '(^|[^一二三四五六七八九十])四丁目', '\\14丁目', 'g'),
      '(^|[^一二三四五六七八九十])五丁目', '\\15丁目', 'g'), '(^|[^一二三四五六七八九十])六丁目', '\\16丁目', 'g'),
      '(^|[^一二三四五六七八九十])七丁目', '\\17丁目', 'g'), '(^|[^一二三四五六七八九十])八丁目', '\\18丁目', 'g'),
      '(^|[^一二三四五六七八九十])九丁目', '\\19丁目', 'g'), '(^|[^一二三四五六七八九十])十丁目', '\\110丁目', 'g')
    AS search_key
  FROM named)"""

ORACLE["q_search_normalize"] = _with(NAMES, SEARCHN) + """
SELECT key, search_key FROM sn"""

ORACLE["q_town_search"] = _with(NAMES, SEARCHN) + """
SELECT key, ward, town FROM sn WHERE contains(search_key, '1丁目') ORDER BY ward, town LIMIT 60"""

ORACLE["q_ward_search"] = _with(NAMES, SEARCHN) + """
SELECT key, ward, town FROM sn WHERE ward = 'ward03' AND contains(search_key, '9二') ORDER BY ward, town LIMIT 60"""

SLUGS = """slugs AS (
  SELECT key, ward, 'w' || substr(ward, 5, 2) AS ward_slug,
    't' || CAST(key AS VARCHAR) || '-' || regexp_extract(norm, '([0-9]+)丁目$', 1) AS town_slug
  FROM named),
lk AS (
  SELECT n.key, CASE WHEN ws.ward_slug IS NOT NULL AND s.town_slug IS NOT NULL THEN ws.ward_slug END AS ward_slug,
    CASE WHEN ws.ward_slug IS NOT NULL AND s.town_slug IS NOT NULL THEN s.town_slug END AS town_slug
  FROM named n LEFT JOIN (SELECT DISTINCT ward, ward_slug FROM slugs) ws ON ws.ward = n.ward
  LEFT JOIN slugs s ON s.key = n.key)"""

ORACLE["q_slug_lookup"] = _with(NAMES, SLUGS) + """
SELECT key, ward_slug, town_slug FROM lk"""

ORACLE["q_detail_paths"] = _with(NAMES, SLUGS) + """
SELECT l.key, '/area/' || l.ward_slug || '/' || l.town_slug AS path, s.key AS key_back
FROM lk l JOIN slugs s ON s.ward_slug = l.ward_slug AND s.town_slug = l.town_slug
WHERE l.town_slug IS NOT NULL"""

# --- zones alone --------------------------------------------------------------------

ORACLE["q_ring_area"] = _with(ZEDGES, ZAREA) + """
SELECT zone, round(zone_area, 6) AS area FROM zarea"""

ORACLE["q_ring_centroid"] = _with(ZEDGES) + """
SELECT zone, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cx,
  round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cy
FROM zedges GROUP BY zone"""


def _tm_forward_sql(lon: str, lat: str) -> tuple[str, str]:
    """Forward transverse Mercator (GRS80, zone IX) as SQL text: (x, y)."""
    import math
    a, f = 6378137.0, 1.0 / 298.257222101
    n = f / (2.0 - f)
    big_a = a / (1.0 + n) * (1.0 + n * n / 4.0 + n ** 4 / 64.0)
    k0, lat0, lon0 = 0.9999, 36.0, 139.0 + 50.0 / 60.0
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140,
             49561 * n ** 4 / 161280]
    c = 2 * math.sqrt(n) / (1 + n)
    p0 = math.radians(lat0)
    t0 = math.sinh(math.atanh(math.sin(p0)) - c * math.atanh(c * math.sin(p0)))
    xi0 = math.atan(t0)
    s0 = k0 * big_a * (xi0 + sum(al * math.sin(2 * (j + 1) * xi0) for j, al in enumerate(alpha)))
    t = f"sinh(atanh(sin(radians({lat}))) - {c!r} * atanh({c!r} * sin(radians({lat}))))"
    dl = f"(radians({lon}) - {math.radians(lon0)!r})"
    xi = f"atan({t} / cos({dl}))"
    eta = f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    x = eta + "".join(f" + {al!r} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})"
                      for j, al in enumerate(alpha))
    y = xi + "".join(f" + {al!r} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})"
                     for j, al in enumerate(alpha))
    return f"{k0 * big_a!r} * ({x})", f"{k0 * big_a!r} * ({y}) - {s0!r}"


_PX, _PY = _tm_forward_sql("v.lon", "v.lat")

ZVERT = """zvert AS (
  SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(i AS BIGINT) AS i,
    139.5 + CAST((n_nationkey % 5) * 20 + vx AS DOUBLE) * (1.0 / 250.0) AS lon,
    35.5 + CAST(floor(n_nationkey / 5) * 20 + vy AS DOUBLE) * (1.0 / 250.0) AS lat
  FROM nation, zv)"""

ORACLE["q_project"] = _with(ZEDGES, ZVERT) + f"""
SELECT v.zone, v.i, round({_PX}, 3) AS px, round({_PY}, 3) AS py,
  round(6378137.0 * radians(v.lon), 3) AS mx,
  round(6378137.0 * ln(tan(pi() / 4 + radians(v.lat) / 2)), 3) AS my
FROM zvert v"""

ORACLE["q_snap_precision"] = _with(ZEDGES, ZVERT) + """
SELECT zone, count(*) AS n_vertices,
  string_agg(printf('%.6f', round(lon, 6)) || ' ' || printf('%.6f', round(lat, 6)), ',' ORDER BY i) AS wkt_ring
FROM zvert GROUP BY zone"""

ORACLE["q_ward_outline_edges"] = """WITH sq AS (
  SELECT CAST(floor(n_nationkey / 5) AS BIGINT) AS ward, CAST((n_nationkey % 5) * 20 AS DOUBLE) AS x0,
         CAST(floor(n_nationkey / 5) * 20 AS DOUBLE) AS y0 FROM nation),
e AS (
  SELECT ward, x0 AS ax, y0 AS ay, x0 + 20 AS bx, y0 AS qy FROM sq
  UNION ALL SELECT ward, x0 + 20, y0, x0 + 20, y0 + 20 FROM sq
  UNION ALL SELECT ward, x0 + 20, y0 + 20, x0, y0 + 20 FROM sq
  UNION ALL SELECT ward, x0, y0 + 20, x0, y0 FROM sq),
u AS (
  SELECT ward,
    CASE WHEN ax < bx OR (ax = bx AND ay <= qy) THEN ax ELSE bx END AS x1,
    CASE WHEN ax < bx OR (ax = bx AND ay <= qy) THEN ay ELSE qy END AS y1,
    CASE WHEN ax < bx OR (ax = bx AND ay <= qy) THEN bx ELSE ax END AS x2,
    CASE WHEN ax < bx OR (ax = bx AND ay <= qy) THEN qy ELSE ay END AS y2
  FROM e)
SELECT ward, x1, y1, x2, y2 FROM u GROUP BY ward, x1, y1, x2, y2 HAVING count(*) = 1"""

ORACLE["q_dissolve_attrs"] = _with(ZEDGES, ZAREA) + """
SELECT n.n_regionkey AS region, round(sum(z.zone_area), 6) AS area, arg_min(n.n_name, n.n_nationkey) AS name,
  count(*) AS n_parts
FROM nation n JOIN zarea z ON z.zone = n.n_nationkey GROUP BY n.n_regionkey"""

RESOLVE = """res AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS key, CASE WHEN n.n_nationkey = 2 THEN 1 ELSE n.n_nationkey END AS pk
  FROM nation n),
res2 AS (
  SELECT r.key, CAST(r.pk AS BIGINT) AS poly_key, r.pk NOT IN (2, 24) AS has_polygon,
    CASE WHEN r.pk NOT IN (2, 24) THEN z.zone_area END AS zone_area
  FROM res r JOIN zarea z ON z.zone = r.pk)"""

ORACLE["q_alias_resolve"] = _with(ZEDGES, ZAREA, RESOLVE) + """
SELECT key, poly_key, has_polygon FROM res2"""

ORACLE["q_shared_keys"] = _with(ZEDGES, ZAREA, RESOLVE) + """
SELECT poly_key, count(*) AS n_areas FROM res2 WHERE has_polygon GROUP BY poly_key HAVING count(*) > 1"""

ORACLE["q_shared_polygon_key"] = _with(ZEDGES, ZAREA, RESOLVE) + """
SELECT key, CASE WHEN has_polygon AND count(*) OVER (PARTITION BY poly_key) > 1 THEN poly_key END AS shared_polygon_key
FROM res2"""

ORACLE["q_density"] = _with(AREAS, ZEDGES, ZAREA, RESOLVE) + """,
zp AS (SELECT zone, sum(pop) AS pop FROM areas GROUP BY zone)
SELECT r.key, round(zp.pop, 6) AS pop, round(r.zone_area, 6) AS area_km2, round(zp.pop / r.zone_area, 6) AS density
FROM res2 r JOIN zp ON zp.zone = r.key WHERE r.has_polygon"""

# --- quality -----------------------------------------------------------------------

_HAZARD_COLS = """key data_year flood_ratio flood_mean_depth flood_max_depth flood_covered flood_basin
flood_basin_ratio flood_basins tide_ratio tide_mean_depth tide_max_depth tide_in_scope mean_elev_m
min_elev_m liq_points liq_small liq_mid liq_large liq_pl liq_covered liq_thin liq_history liq_1923
liq_2011 collapse_zone collapse_flow_ratio collapse_erosion_ratio national_river nat_rivers nat_ratio
nat_exposure nat_main_label nat_main_ratio nat_max_label nat_max_ratio flood_source tokyo_exposure""".split()
_FORCED = ("key", "ward", "town", "ward_code", "kokusei_code", "shared_polygon_key", "nat_rivers",
           "nat_main_label", "nat_max_label", "flood_source", "flood_basin", "flood_basins")

_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, {i} AS pos, coalesce(CAST({c} AS VARCHAR), '') AS v FROM hazard"
    for i, c in enumerate(_HAZARD_COLS))

ORACLE["q_infer_types"] = _with(*SERVE) + f""",
cells AS ({_CELLS}),
cls AS (
  SELECT col, pos, v <> '' AS filled, regexp_matches(v, '^\\s*[+-]?[0-9]+\\s*$') AS is_int,
    regexp_matches(v, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$')
      OR regexp_matches(lower(v), '^\\s*[+-]?(nan|inf|infinity)\\s*$') AS is_real
  FROM cells),
g AS (SELECT col, pos, count_if(filled AND NOT is_int AND NOT is_real) AS n_text,
             count_if(filled AND NOT is_int AND is_real) AS n_real FROM cls GROUP BY col, pos)
SELECT col AS "column", CAST(pos AS BIGINT) AS pos,
  CASE WHEN col IN {_FORCED!r} THEN 'TEXT' WHEN n_text > 0 THEN 'TEXT' WHEN n_real > 0 THEN 'REAL'
       ELSE 'INTEGER' END AS type
FROM g"""

ORACLE["q_pk_violations"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

ORACLE["q_mart_pk_check"] = _with(AREAS) + """
SELECT count(*) AS violating_keys FROM (SELECT key FROM areas GROUP BY key HAVING count(*) > 1)"""

ORACLE["q_stream_zone_stats"] = ORACLE["q_zone_depth_stats"]

ORACLE["q_match_rate"] = _with(AREAS) + """
SELECT count(*) AS n_areas, count(m.key) AS n_matched, round(count(m.key) / count(*), 6) AS match_rate
FROM areas a LEFT JOIN (SELECT DISTINCT o_custkey AS key FROM orders WHERE year(o_orderdate) = 2000) m
  ON m.key = a.key"""

ORACLE["q_top_wards"] = _with(AREAS) + """
SELECT ward, count(*) AS n_areas FROM areas WHERE pop >= 100 GROUP BY ward ORDER BY n_areas DESC, ward LIMIT 8"""

ORACLE["q_ward_outline_rings"] = ORACLE["q_ward_outline_edges"].replace(
    "SELECT ward, x1, y1, x2, y2 FROM u GROUP BY ward, x1, y1, x2, y2 HAVING count(*) = 1",
    """, oe AS (SELECT ward, x1, y1, x2, y2 FROM u GROUP BY ward, x1, y1, x2, y2 HAVING count(*) = 1),
per AS (SELECT ward, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS perimeter FROM oe GROUP BY ward),
ar AS (SELECT ward, CAST(sum(400.0) AS DOUBLE) AS area FROM sq GROUP BY ward)
SELECT ar.ward, round(ar.area, 6) AS area, round(per.perimeter, 6) AS perimeter, CAST(1 AS BIGINT) AS n_rings
FROM ar JOIN per ON per.ward = ar.ward""")

ORACLE["q_byte_batch_totals"] = _with(AREAS, YEARLY, WIDE) + """,
txt AS (
  SELECT '(' || CAST(key AS VARCHAR) || ', 2025, ' || CAST(serious AS VARCHAR) || ', ' ||
         CAST(serious_cur AS VARCHAR) || ', ' || CAST(daily AS VARCHAR) || ', ' ||
         CAST(visitor AS VARCHAR) || ', ' || CAST(total AS VARCHAR) || ')' AS t FROM wide)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(strlen(t)) AS BIGINT) AS n_bytes,
  true AS within_limit FROM txt"""

ORACLE["q_ring_validity"] = _with(ZEDGES, HEDGES) + """,
ze AS (
  SELECT 'zone' AS kind, CAST(n_nationkey AS BIGINT) AS id, a.i AS ei, 6 AS rn,
    CAST((n_nationkey % 5) * 20 + a.vx AS DOUBLE) AS x1, CAST(floor(n_nationkey / 5) * 20 + a.vy AS DOUBLE) AS y1,
    CAST((n_nationkey % 5) * 20 + b.vx AS DOUBLE) AS x2, CAST(floor(n_nationkey / 5) * 20 + b.vy AS DOUBLE) AS y2
  FROM nation, zv a JOIN zv b ON b.i = (a.i + 1) % 6),
he AS (
  SELECT 'hazard' AS kind, h.poly_id AS id, a.i AS ei, 3 AS rn,
    h.cx + a.vx AS x1, h.cy + a.vy AS y1, h.cx + b.vx AS x2, h.cy + b.vy AS y2
  FROM haz h, hv a JOIN hv b ON b.i = (a.i + 1) % 3),
ed AS (SELECT * FROM ze UNION ALL SELECT * FROM he),
crossed AS (
  SELECT DISTINCT a.kind, a.id FROM ed a JOIN ed b ON a.kind = b.kind AND a.id = b.id AND a.ei < b.ei
  WHERE NOT (b.ei - a.ei = 1 OR (a.ei = 0 AND b.ei = a.rn - 1))
    AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
    AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
    AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1))
      * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
    AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1))
      * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0),
polys AS (SELECT kind, id, count(*) AS n FROM ed GROUP BY kind, id)
SELECT p.kind, p.id, CAST(p.n AS BIGINT) AS n_vertices, p.n >= 3 AS enough_vertices, c.id IS NULL AS simple
FROM polys p LEFT JOIN crossed c ON c.kind = p.kind AND c.id = p.id"""


# --- regions by vertical strips ----------------------------------------------
# Between two neighbouring x of ends and crossings no edges cross, so a region's part is a stack of trapezoids.

def _strips(edges: str, inside: str) -> str:
    """CTEs over ``edges`` (k, x1, y1, x2, y2): gap(k, x0, x1, y, next_y) of each strip's middle where ``inside`` holds."""
    return f"""xs AS (
  SELECT k, x1 AS x FROM {edges} UNION
  SELECT a.k, a.x1 + ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1))
         / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) * (a.x2 - a.x1)
  FROM {edges} a JOIN {edges} b ON a.k = b.k AND (a.x2 - a.x1) * (b.y2 - b.y1) <> (a.y2 - a.y1) * (b.x2 - b.x1)
  WHERE ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1))
        / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) BETWEEN 0 AND 1
    AND ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1))
        / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) BETWEEN 0 AND 1),
strip AS (SELECT * FROM (SELECT k, x AS x0, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1 FROM xs) WHERE x1 - x0 > 1e-9),
span AS (
  SELECT s.k, s.x0, s.x1, CASE WHEN e.x2 > e.x1 THEN 1 ELSE -1 END AS sg,
         e.y1 + ((s.x0 + s.x1) / 2 - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1) AS y
  FROM strip s JOIN {edges} e ON e.k = s.k AND least(e.x1, e.x2) <= (s.x0 + s.x1) / 2 AND greatest(e.x1, e.x2) >= (s.x0 + s.x1) / 2
  WHERE e.x1 <> e.x2),
stack AS (
  SELECT *, lead(y) OVER w AS next_y, sum(sg) OVER (w ROWS UNBOUNDED PRECEDING) AS winding, row_number() OVER w AS nth
  FROM span WINDOW w AS (PARTITION BY k, x0 ORDER BY y)),
gap AS (SELECT k, x0, x1, y, next_y FROM stack WHERE {inside} AND next_y IS NOT NULL)"""


_KINDS = ", ".join(f"({kind}, {i}, {x}, {y}, {len(ring)})" for kind, ring in enumerate((
    ((0, 0), (8, 6), (8, 0), (0, 6)),
    ((0, 6), (12, 6), (2, 14), (6, 0), (10, 14)),
    ((0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (14, 4), (14, 14), (0, 14)),
    ((0, 0), (12, 0), (12, 12), (0, 12), (0, 6), (4, 6), (4, 8), (8, 8), (8, 4), (4, 4), (4, 6), (0, 6)),
)) for i, (x, y) in enumerate(ring))

ORACLE["q_ring_repair"] = f"""WITH v(kind, i, x, y, n) AS (VALUES {_KINDS}),
e AS (
  SELECT s_suppkey AS k, (s_suppkey * 37) % 100 + a.x::DOUBLE AS x1, (s_suppkey * 53) % 100 + a.y::DOUBLE AS y1,
         (s_suppkey * 37) % 100 + b.x::DOUBLE AS x2, (s_suppkey * 53) % 100 + b.y::DOUBLE AS y2
  FROM supplier JOIN v a ON a.kind = s_suppkey % 4 JOIN v b ON b.kind = a.kind AND b.i = (a.i + 1) % a.n),
""" + _strips("e", "nth % 2 = 1") + """
-- two wings; five points around the centre, which is outside; a loop's inside is a hole; a hole in a square
SELECT k AS poly_id, round(sum((x1 - x0) * (next_y - y)), 5) AS area,
       CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 2 END AS BIGINT) AS n_rings,
       CAST(CASE k % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n_holes, true AS valid
FROM gap GROUP BY k"""

# the outline's length: parts of edges with the union on one side only
ORACLE["q_union_outline"] = _with(HEDGES) + """,
e AS (SELECT DISTINCT h.river AS k, x1, y1, x2, y2 FROM hedges JOIN haz h USING (poly_id)),
""" + _strips("e", "winding > 0") + """,
sides AS (
  SELECT s.k, s.x0, s.x1, s.winding, s.winding - s.sg AS before, (e.y2 - e.y1) / (e.x2 - e.x1) AS slope
  FROM stack s JOIN e ON e.k = s.k AND e.x1 <> e.x2 AND least(e.x1, e.x2) <= (s.x0 + s.x1) / 2 AND greatest(e.x1, e.x2) >= (s.x0 + s.x1) / 2
   AND s.y = e.y1 + ((s.x0 + s.x1) / 2 - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1) AND s.sg = CASE WHEN e.x2 > e.x1 THEN 1 ELSE -1 END)
SELECT a.k AS river, round(a.area, 3) AS area, round(p.len, 3) AS perimeter
FROM (SELECT k, sum((x1 - x0) * (next_y - y)) AS area FROM gap GROUP BY k) a
JOIN (SELECT k, sum((x1 - x0) * sqrt(1 + slope * slope)) AS len FROM sides WHERE (winding = 0) <> (before = 0) GROUP BY k) p USING (k)"""

ORACLE["q_big_ring_count"] = _with(PTS) + """,
v AS (SELECT p_partkey AS i, 50.0::DOUBLE + (30.0 + 10.0 * ((p_partkey * 7919) % 101) / 101.0::DOUBLE) * cos(2 * pi() * p_partkey / n) AS x,
             50.0::DOUBLE + (30.0 + 10.0 * ((p_partkey * 7919) % 101) / 101.0::DOUBLE) * sin(2 * pi() * p_partkey / n) AS y, n
      FROM part, (SELECT count(*) AS n FROM part)),
e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.i % b.n = (a.i + 1) % a.n),
p AS (SELECT row_number() OVER () AS r, * FROM pts),
hit AS (SELECT r, count(*) % 2 AS odd FROM p JOIN e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY r)
SELECT basin, CAST(count(*) AS BIGINT) AS n_points, round(max(depth), 6) AS depth_max FROM p JOIN hit USING (r) WHERE odd = 1 GROUP BY basin"""

ORACLE["q_overlay_chunks"] = ORACLE["q_overlay_area"]

ORACLE["q_geojson_split"] = _with(HEDGES) + """
SELECT poly_id, CAST(any_value(river) AS BIGINT) AS river, count(*) AS n_vertices,
       round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, true AS valid
FROM hedges JOIN haz USING (poly_id) GROUP BY poly_id"""
