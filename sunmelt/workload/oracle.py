"""SQL counterparts of the queries, written for DuckDB over the same tables.

Each statement states the rule anew in SQL (joins and windows rather than the plans used
by the operators), so agreement is evidence and not repetition.
"""

from __future__ import annotations

import math

from sunmelt.workload import queries as q

PI2_365 = repr(2.0 * math.pi / 365.0)


def r(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits}::DOUBLE + 0.501::DOUBLE) / 1e{digits}::DOUBLE)"


def pmod(a: str, n: str) -> str:
    return f"(((({a}) % {n}) + {n}) % {n})"


def clip(x: str, lo: str | None = None, hi: str | None = None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo}::DOUBLE)"
    if hi is not None:
        out = f"least({out}, {hi}::DOUBLE)"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {out} END)"


def season(month: str) -> str:
    return (
        f"(CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} BETWEEN 3 AND 5 "
        f"THEN 'pre-monsoon' WHEN {month} BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post-monsoon' END)"
    )


def season_code(name: str) -> str:
    return (
        f"(CASE {name} WHEN 'winter' THEN 0 WHEN 'pre-monsoon' THEN 1 WHEN 'monsoon' THEN 2 "
        f"WHEN 'post-monsoon' THEN 3 END)::INTEGER"
    )


def litres(hour: str) -> str:
    return (
        f"(CASE {hour} WHEN 5 THEN 5 WHEN 6 THEN 25 WHEN 7 THEN 30 WHEN 8 THEN 20 WHEN 9 THEN 10 "
        f"WHEN 10 THEN 5 WHEN 11 THEN 5 WHEN 12 THEN 5 WHEN 13 THEN 5 WHEN 14 THEN 5 "
        f"WHEN 15 THEN 5 WHEN 16 THEN 5 WHEN 17 THEN 10 WHEN 18 THEN 20 WHEN 19 THEN 25 "
        f"WHEN 20 THEN 15 WHEN 21 THEN 10 WHEN 22 THEN 5 WHEN 23 THEN 3 ELSE 2 END)::DOUBLE"
    )


def level(x: str) -> str:
    return f"(CASE WHEN {x} >= 20 THEN 'high' WHEN {x} >= 10 THEN 'medium' ELSE 'low' END)"


def index_bin(x: str) -> str:
    return f"(CASE WHEN {x} < 4.0 THEN 'low' WHEN {x} < 5.7 THEN 'medium' ELSE 'high' END)"


EVENT_HOURS = """SELECT event_type AS city, ts AS timestamp, value AS "GHI", value * 0.5::DOUBLE AS "DNI",
  value % 40 AS "T_amb", value % 12 AS "W_spd", (user_id % 100) / 100.0::DOUBLE AS cloud_cover,
  least(value / 300.0::DOUBLE, 1.5::DOUBLE) AS "CSI", value / 1000.0::DOUBLE AS precipitation,
  user_id AS altitude_m, month(ts)::INTEGER AS month, hour(ts)::INTEGER AS hour FROM events"""

ORDER_HOURS = """SELECT o_orderkey, c_mktsegment AS city, o_orderdate AS timestamp,
  o_totalprice / 1000.0::DOUBLE AS "GHI", o_totalprice % 40 AS "T_amb"
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

ORDER_DAYS = f"""SELECT city, timestamp::DATE AS date, avg("GHI") AS "GHI_mean",
  avg("T_amb") AS "T_amb_mean", max("T_amb") AS "T_amb_max" FROM ({ORDER_HOURS})
  WHERE city IS NOT NULL AND timestamp IS NOT NULL GROUP BY ALL"""

DAILY_STATS = f"""avg("GHI") AS "GHI_mean", max("GHI") AS "GHI_max",
  coalesce(sum("GHI"), 0) / 1000.0::DOUBLE AS "GHI_daily_kWh_m2", avg("DNI") AS "DNI_mean",
  max("DNI") AS "DNI_max", avg("T_amb") AS "T_amb_mean", max("T_amb") AS "T_amb_max",
  min("T_amb") AS "T_amb_min", avg("W_spd") AS "W_spd_mean", max("W_spd") AS "W_spd_max",
  avg(cloud_cover) AS cloud_cover_mean, avg("CSI") AS "CSI_mean",
  coalesce(sum(precipitation), 0) AS precipitation_sum,
  coalesce(sum({litres('hour')}), 0) AS "demand_total_L" """


def rounded_columns(names: list[str], digits: int = 6) -> str:
    return ", ".join(f'{r(chr(34) + n + chr(34), digits)} AS "{n}"' for n in names)


STAT_COLUMNS = [
    "GHI_mean", "GHI_max", "GHI_daily_kWh_m2", "DNI_mean", "DNI_max", "T_amb_mean", "T_amb_max",
    "T_amb_min", "W_spd_mean", "W_spd_max", "cloud_cover_mean", "CSI_mean", "precipitation_sum",
    "demand_total_L",
]


def lags(columns: list[str]) -> str:
    return ", ".join(
        f'lag("{c}", {k}) OVER w AS "{c}_lag{k}"' for c in columns for k in (1, 2, 7)
    )


def roll7(columns: list[str]) -> str:
    return ", ".join(
        f'avg("{c}") OVER (PARTITION BY city ORDER BY date ROWS BETWEEN 6 PRECEDING AND '
        f'CURRENT ROW) AS "{c}_roll7"'
        for c in columns
    )


NEXT = 'lead("GHI_mean") OVER w AS "GHI_next_day", lead("T_amb_mean") OVER w AS "T_amb_next_day"'
W = "WINDOW w AS (PARTITION BY city ORDER BY date)"


def lag_names(columns: list[str]) -> list[str]:
    return [f"{c}_lag{k}" for c in columns for k in (1, 2, 7)]


def fourier(b: str, c: list[str]) -> str:
    terms = [c[0]]
    for i, x in enumerate(c[1:]):
        terms.append(f"{x} * {'sin' if i % 2 else 'cos'}({b} * {i // 2 + 1}.0::DOUBLE)")
    return "(" + " + ".join(terms) + ")"


DECL = ["0.006918::DOUBLE", "(-0.399912)::DOUBLE", "0.070257::DOUBLE", "(-0.006758)::DOUBLE",
        "0.000907::DOUBLE", "(-0.002697)::DOUBLE", "0.00148::DOUBLE"]
EOT = ["0.000075::DOUBLE", "0.001868::DOUBLE", "(-0.032077)::DOUBLE", "(-0.014615)::DOUBLE",
       "(-0.040849)::DOUBLE"]
SUN = ["1.00011::DOUBLE", "0.034221::DOUBLE", "0.00128::DOUBLE", "0.000719::DOUBLE",
       "0.000077::DOUBLE"]
PRESSURE = "(100.0::DOUBLE * pow((44331.514::DOUBLE - altitude_m) / 11880.516::DOUBLE, 1.0::DOUBLE / 0.1902632::DOUBLE))"


def solar(source: str) -> str:
    """Adds SZA, solar_azimuth and ETR to rows with timestamp, lat, lon and altitude_m."""
    secs = "(hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp))"
    return f"""SELECT * EXCLUDE (b, eot, decl, ha, zen, el), CASE WHEN el < -0.8337 THEN zen ELSE
    zen - (1.02::DOUBLE / 60.0::DOUBLE) / tan(radians(el + 10.3::DOUBLE / (el + 5.11::DOUBLE)))
      * ({PRESSURE} / 101000.0::DOUBLE * (283.0::DOUBLE / 285.0::DOUBLE)) END AS "SZA"
    FROM (SELECT *, 90.0::DOUBLE - zen AS el FROM (SELECT *,
      degrees(acos(least(greatest(sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(ha), -1.0::DOUBLE), 1.0::DOUBLE))) AS zen,
      {pmod("degrees(atan2(sin(ha), cos(ha) * sin(radians(lat)) - tan(decl) * cos(radians(lat)))) + 180.0::DOUBLE", "360.0::DOUBLE")} AS solar_azimuth,
      1366.1::DOUBLE * {fourier(f"((dayofyear(timestamp) - 1) * {PI2_365}::DOUBLE)", SUN)} AS "ETR"
    FROM (SELECT *, {fourier('b', DECL)} AS decl, radians((hour(timestamp) * 60.0::DOUBLE + minute(timestamp)
        + second(timestamp) / 60.0::DOUBLE + 4.0::DOUBLE * lon + eot) / 4.0::DOUBLE - 180.0::DOUBLE) AS ha
    FROM (SELECT *, 229.18::DOUBLE * {fourier('b', EOT)} AS eot
    FROM (SELECT *, (dayofyear(timestamp) + {secs} / 86400.0::DOUBLE - 1.0::DOUBLE) * {PI2_365}::DOUBLE AS b
    FROM ({source}))))))"""


MIDS = []
_start = 0
for _days in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31):
    MIDS.append(_start + (_days + 1) / 2)
    _start += _days


def clearsky(source: str) -> str:
    """Adds GHI_clearsky to rows with SZA, ETR, altitude_m, city, timestamp."""
    base = f"(CASE city WHEN 'Coimbatore' THEN {q.TURBIDITY_BASE['Coimbatore']} ELSE {q.TURBIDITY_BASE['Jaisalmer']} END)::DOUBLE"

    def tl(m: str) -> str:
        return f"({base} + 0.1::DOUBLE * {m})"

    ext = [MIDS[11] - 365, *MIDS, MIDS[0] + 365]
    array = "[" + ", ".join(f"{x}::DOUBLE" for x in ext) + "]"
    return f"""SELECT * EXCLUDE (tl, am, m, d, mid, m0, m1), CASE WHEN "SZA" > 90 THEN 0.0::DOUBLE ELSE
      (5.09e-5::DOUBLE * altitude_m + 0.868::DOUBLE) * "ETR" * greatest(cos(radians("SZA")), 0.0::DOUBLE)
      * exp(-(3.92e-5::DOUBLE * altitude_m + 0.0387::DOUBLE) * am
        * (exp(-altitude_m / 8000.0::DOUBLE) + exp(-altitude_m / 1250.0::DOUBLE) * (tl - 1.0::DOUBLE))) END AS "GHI_clearsky"
    FROM (SELECT *, 1.0::DOUBLE / (cos(radians("SZA")) + 0.50572::DOUBLE * pow(96.07995::DOUBLE - least("SZA", 90.0::DOUBLE), -1.6364::DOUBLE))
        * {PRESSURE} / 101325.0::DOUBLE AS am,
      CASE WHEN d < mid THEN {tl("m0")} + ({tl("m")} - {tl("m0")}) * (d - ({array})[m]) / (mid - ({array})[m])
        ELSE {tl("m")} + ({tl("m1")} - {tl("m")}) * (d - mid) / (({array})[m + 2] - mid) END AS tl
    FROM (SELECT *, month(timestamp) AS m, dayofyear(timestamp) AS d, ({array})[month(timestamp) + 1] AS mid,
      (month(timestamp) + 10) % 12 + 1 AS m0, month(timestamp) % 12 + 1 AS m1 FROM ({source})))"""


CSI = """(CASE WHEN "GHI_clearsky" > 10 THEN (CASE WHEN "GHI" IS NOT NULL THEN
  least(greatest("GHI" / "GHI_clearsky", 0.0::DOUBLE), 1.5::DOUBLE) END) ELSE 0.0::DOUBLE END)"""

SITED_EVENTS = " UNION ALL ".join(
    f"""SELECT event_id, ts AS timestamp, value AS "GHI", '{city}' AS city, {lat}::DOUBLE AS lat,
    {lon}::DOUBLE AS lon, {alt} AS altitude_m FROM events"""
    for city, lat, lon, alt, _, _ in q.SITES
)


def sun_hour(rising: bool) -> str:
    b = f"((dayofyear(timestamp::DATE) + 0.5::DOUBLE - 1.0::DOUBLE) * {PI2_365}::DOUBLE)"
    decl = fourier(b, DECL)
    arc = (
        f"degrees(acos((sin(radians(-0.833::DOUBLE)) - sin(radians(lat)) * sin({decl})) "
        f"/ (cos(radians(lat)) * cos({decl}))))"
    )
    minutes = (
        f"720.0::DOUBLE - 4.0::DOUBLE * (lon {'+' if rising else '-'} {arc}) "
        f"- 229.18::DOUBLE * {fourier(b, EOT)} + 330.0::DOUBLE"
    )
    return f"(floor({pmod(minutes, '1440.0::DOUBLE')}) / 60.0::DOUBLE)"


def rh(t: str, d: str) -> str:
    part = "17.625::DOUBLE * {0} / (243.04::DOUBLE + {0})"
    return clip(f"(100.0::DOUBLE * exp({part.format(d)} - {part.format(t)}))", "0", "100")


GRID_MEAN = """SELECT CASE WHEN l_linestatus = 'O' THEN 'Coimbatore' ELSE 'Jaisalmer' END AS city,
  l_shipdate + to_hours((l_partkey % 24)::INTEGER) AS timestamp,
  avg(l_quantity + 265.15::DOUBLE) - 273.15::DOUBLE AS "T_amb",
  avg(l_quantity * 0.8::DOUBLE + 262.15::DOUBLE) - 273.15::DOUBLE AS "T_dew",
  avg(l_extendedprice * 20.0::DOUBLE - 100000.0::DOUBLE) / 3600.0::DOUBLE AS ssrd_h,
  avg(l_quantity * 8.0::DOUBLE) AS "DNI", avg(l_extendedprice * 15.0::DOUBLE) / 3600.0::DOUBLE AS strd_h,
  avg(l_quantity - 25.0::DOUBLE) AS u, avg(l_discount * 100.0::DOUBLE - 5.0::DOUBLE) AS v,
  avg(l_tax / 100.0::DOUBLE) * 1000.0::DOUBLE AS precipitation,
  avg(l_discount * 11.0::DOUBLE) AS tcc, avg(l_extendedprice + 90000.0::DOUBLE) / 100.0::DOUBLE AS "P_atm"
  FROM lineitem GROUP BY ALL"""


def _climate() -> str:
    places = " UNION ALL ".join(
        f"""SELECT '{c}' AS city, {la}::DOUBLE AS lat, {lo}::DOUBLE AS lon, {al} AS altitude_m,
        '{zone}' AS climate_zone, {t}::DOUBLE AS "T_set" """
        for c, la, lo, al, zone, t in q.SITES
    )
    month = "month(timestamp)"
    base = f"""SELECT city, timestamp, "T_amb", "T_dew", {rh('"T_amb"', '"T_dew"')} AS "RHum",
      sqrt(u * u + v * v) AS "W_spd", {pmod("degrees(atan2(u, v))", "360.0::DOUBLE")} AS "W_dir",
      greatest(ssrd_h, 0.0::DOUBLE) AS "GHI", "DNI", greatest(strd_h, 0.0::DOUBLE) AS "LW_down",
      least(greatest(tcc, 0.0::DOUBLE), 1.0::DOUBLE) AS cloud_cover, precipitation, "P_atm",
      hour(timestamp)::INTEGER AS hour, month(timestamp)::INTEGER AS month,
      dayofyear(timestamp)::INTEGER AS "DOY", year(timestamp)::INTEGER AS year,
      {season(month)} AS season, {season_code(season(month))} AS season_code,
      lat, lon, altitude_m, climate_zone, "T_set"
      FROM ({GRID_MEAN}) JOIN ({places}) USING (city)"""
    return f"""WITH hourly AS ({clearsky(solar(base))}),
    indexed AS (SELECT *, greatest(avg("GHI") OVER m / ("T_set" - avg("T_amb") OVER m), 0.0::DOUBLE) AS "RRTDHS"
      FROM hourly WINDOW m AS (PARTITION BY city, date_trunc('month', timestamp)::DATE)),
    climate AS (SELECT *, {CSI} AS "CSI", greatest("GHI" - "DNI" * cos(radians("SZA")), 0.0::DOUBLE) AS "DHI",
      {sun_hour(True)} AS sunrise_hour, {sun_hour(False)} AS sunset_hour,
      ("RRTDHS" > 5.7)::INTEGER AS high_solar_resource FROM indexed)"""


CLIMATE_DOUBLES = [
    "T_amb", "T_dew", "RHum", "W_spd", "W_dir", "GHI", "DNI", "LW_down", "cloud_cover",
    "precipitation", "P_atm", "SZA", "solar_azimuth", "ETR", "GHI_clearsky", "CSI", "DHI",
    "RRTDHS", "sunrise_hour", "sunset_hour", "lat", "lon", "T_set",
]
CLIMATE_OTHERS = [
    "timestamp", "hour", "month", "DOY", "year", "season", "season_code", "city", "altitude_m",
    "climate_zone", "high_solar_resource",
]


def _hole(value: str, every: int, name: str) -> str:
    return f'CASE WHEN p_partkey % {every} <> 0 THEN {value} END AS "{name}"'


HOLED = "SELECT " + ", ".join(
    [
        "p_partkey AS material_id",
        "p_name || ' ' || p_partkey::VARCHAR AS product",
        "CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS pcm_type",
        "CASE p_partkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS flammability",
        _hole("s + 25.0::DOUBLE", 11, "Tm_melting"),
        _hole("s + 24.0::DOUBLE + p_partkey % 3", 5, "Tm_freezing"),
        _hole("s + 20.0::DOUBLE", 3, "Tm_nucleation"),
        _hole("s * 4.0::DOUBLE + 50.0::DOUBLE", 13, "latent_heat_melting"),
        _hole("s * 4.0::DOUBLE + 45.0::DOUBLE", 2, "latent_heat_freezing"),
        _hole("s + 30.0::DOUBLE", 4, "heat_storage_Wh_kg"),
        _hole("p_retailprice", 6, "density_liquid"),
        _hole("p_retailprice + 60.0::DOUBLE", 7, "density_solid"),
        _hole("s / 20.0::DOUBLE", 8, "Cp_liquid"),
        _hole("s / 25.0::DOUBLE", 9, "Cp_solid"),
        _hole("s / 100.0::DOUBLE", 2, "TC_liquid"),
        _hole("s / 80.0::DOUBLE", 5, "TC_solid"),
        _hole("s / 90.0::DOUBLE", 3, "TC_both"),
        _hole("s / 5.0::DOUBLE", 10, "volume_expansion"),
        _hole("s + 60.0::DOUBLE", 4, "max_op_temp"),
        _hole("s + 150.0::DOUBLE", 5, "flash_point"),
        _hole("s * 40.0::DOUBLE", 2, "cycles_tested"),
    ]
) + " FROM (SELECT *, p_size::DOUBLE AS s FROM part)"

RULED = f"""SELECT * REPLACE (coalesce("Tm_nucleation", "Tm_freezing") AS "Tm_nucleation") FROM (
  SELECT * REPLACE (
    CASE WHEN "TC_both" IS NULL AND "TC_liquid" IS NOT NULL AND "TC_solid" IS NOT NULL
      THEN ("TC_liquid" + "TC_solid") / 2.0::DOUBLE ELSE "TC_both" END AS "TC_both",
    coalesce(latent_heat_freezing, latent_heat_melting) AS latent_heat_freezing,
    coalesce("Tm_freezing", "Tm_melting" - 1.0::DOUBLE) AS "Tm_freezing",
    coalesce(max_op_temp, "Tm_melting" + 30.0::DOUBLE) AS max_op_temp,
    coalesce(cycles_tested, 0.0::DOUBLE) AS cycles_tested) FROM ({HOLED}))"""

FILLED = f"""SELECT * REPLACE (coalesce("TC_liquid", "TC_both") AS "TC_liquid", coalesce("TC_solid", "TC_both") AS "TC_solid",
    coalesce("Cp_solid", "Cp_liquid" * 0.9::DOUBLE, 2.0::DOUBLE) AS "Cp_solid",
    coalesce(density_solid, density_liquid * 1.1::DOUBLE, 900.0::DOUBLE) AS density_solid) FROM (
  SELECT * REPLACE (coalesce("TC_both", "TC_liquid", "TC_solid", 0.5::DOUBLE) AS "TC_both",
    coalesce("Cp_liquid", "Cp_solid" * 1.1::DOUBLE, 2.2::DOUBLE) AS "Cp_liquid",
    coalesce(density_liquid, density_solid * 0.9::DOUBLE, 850.0::DOUBLE) AS density_liquid,
    coalesce(heat_storage_Wh_kg, 200.0::DOUBLE) AS heat_storage_Wh_kg,
    coalesce(volume_expansion, 10.0::DOUBLE) AS volume_expansion,
    coalesce(flammability, 'Unknown') AS flammability, coalesce(pcm_type, 'Unknown') AS pcm_type)
  FROM ({RULED}))"""

MATERIAL_DOUBLES = [
    "Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting", "latent_heat_freezing",
    "heat_storage_Wh_kg", "density_liquid", "density_solid", "Cp_liquid", "Cp_solid",
    "TC_liquid", "TC_solid", "TC_both", "volume_expansion", "max_op_temp", "flash_point",
    "cycles_tested",
]


def derived(source: str) -> str:
    return f"""SELECT *, coalesce(density_solid, 800.0::DOUBLE) * latent_heat_avg / 1000.0::DOUBLE AS "rho_H_MJ_m3" FROM (
      SELECT * REPLACE (coalesce(heat_storage_Wh_kg, latent_heat_melting / 3.6::DOUBLE) AS heat_storage_Wh_kg),
      latent_heat_melting / ("Tm_melting" - coalesce("Tm_freezing", "Tm_melting" - 2.0::DOUBLE) + 1e-6::DOUBLE) AS latent_per_degree,
      (coalesce(latent_heat_melting, 0.0::DOUBLE) + coalesce(latent_heat_freezing, 0.0::DOUBLE)) / 2.0::DOUBLE AS latent_heat_avg,
      "Tm_melting" - "Tm_freezing" AS "Tm_range",
      coalesce(density_solid, 800.0::DOUBLE) * latent_heat_melting / 1000.0::DOUBLE AS "rho_H_melting",
      coalesce("TC_liquid", "TC_both") / nullif(coalesce("TC_solid", "TC_both"), 0) AS "TC_ratio",
      (coalesce("Cp_liquid", 2.0::DOUBLE) + coalesce("Cp_solid", 2.0::DOUBLE)) / 2.0::DOUBLE AS "Cp_avg",
      (coalesce(density_liquid, 800.0::DOUBLE) + coalesce(density_solid, 850.0::DOUBLE)) / 2.0::DOUBLE AS density_avg,
      CASE WHEN top > 0 THEN ln(1 + coalesce(cycles_tested, 0.0::DOUBLE)) / ln(1 + top) ELSE 0.5::DOUBLE END AS cycles_confidence,
      (flash_point IS NOT NULL)::INTEGER AS flash_point_known,
      coalesce((flammability = 'Yes')::INTEGER, 0) AS is_flammable
      FROM (SELECT *, max(coalesce(cycles_tested, 0.0::DOUBLE)) OVER () AS top FROM ({source})))"""


CRITERIA = {
    "latent_heat_melting": "0.40", "TC_both": "0.25", "Cp_avg": "0.10", "rho_H_MJ_m3": "0.15",
    "cycles_confidence": "0.10",
}
SUPPLIERS = """SELECT l_suppkey, avg(l_extendedprice) AS latent_heat_melting, avg(l_discount) AS "TC_both",
  avg(l_tax) AS "Cp_avg", max(l_extendedprice) AS "rho_H_MJ_m3", count(*)::DOUBLE AS cycles_confidence
  FROM lineitem GROUP BY l_suppkey"""


def topsis(source: str, keep: str) -> str:
    v = ", ".join(
        f"""coalesce("{c}", 0) / (sqrt(sum(coalesce("{c}", 0) * coalesce("{c}", 0)) OVER ()) + 1e-8::DOUBLE) * {w}::DOUBLE AS v{i}"""
        for i, (c, w) in enumerate(CRITERIA.items())
    )
    best = " + ".join(f"pow(v{i} - max(v{i}) OVER (), 2)" for i in range(len(CRITERIA)))
    worst = " + ".join(f"pow(v{i} - min(v{i}) OVER (), 2)" for i in range(len(CRITERIA)))
    return f"""SELECT {keep}, sw / (sb + sw + 1e-8::DOUBLE) AS score FROM (
      SELECT *, sqrt({best}) AS sb, sqrt({worst}) AS sw FROM (SELECT *, {v} FROM ({source})))"""


MINMAX = " + ".join(
    f"""{w}::DOUBLE * coalesce(("{c}" - min("{c}") OVER ()) / nullif(max("{c}") OVER () - min("{c}") OVER (), 0), 0)"""
    for c, w in CRITERIA.items()
)

OFFSETS = "(CASE season WHEN 'winter' THEN -3.0 WHEN 'pre-monsoon' THEN 2.0 WHEN 'monsoon' THEN -1.0 ELSE 0.0 END)::DOUBLE"


def assign(site_season: str, catalogue: str) -> str:
    """Every site and season against every material: fine for a small reference run."""
    return f"""SELECT city, season, "T_set", rrtdhs_approx, target AS "optimal_Tm_target", product AS best_pcm_product,
      material_id AS best_pcm_id, "Tm_melting" AS "best_pcm_Tm", pcm_suitability_score AS best_pcm_score
    FROM (SELECT *, row_number() OVER (PARTITION BY city, season ORDER BY near DESC,
        CASE WHEN near = 1 THEN -pcm_suitability_score ELSE abs("Tm_melting" - target) END, product, material_id) AS rn
      FROM (SELECT *, ("Tm_melting" BETWEEN target - tol AND target + tol)::INTEGER AS near
        FROM (SELECT *, "T_set" + {OFFSETS} AS target,
          CASE WHEN rrtdhs_approx < 5.7 THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END AS tol FROM ({site_season}))
        CROSS JOIN (SELECT product, material_id, "Tm_melting", pcm_suitability_score FROM ({catalogue})
          WHERE "Tm_melting" IS NOT NULL)))
    WHERE rn = 1"""


SUPPLIER_SEASONS = """SELECT s_suppkey AS city, (s_nationkey % 5) * 6.5::DOUBLE + 38.0::DOUBLE AS "T_set", season,
  (s_acctbal + 1000.0::DOUBLE) / 900.0::DOUBLE * factor AS rrtdhs_approx FROM supplier,
  (VALUES ('winter', 0.7::DOUBLE), ('pre-monsoon', 1.0::DOUBLE), ('monsoon', 0.5::DOUBLE), ('post-monsoon', 0.85::DOUBLE)) AS f(season, factor)"""

SPLIT_MARK = "chr(1)"
ELEMENT = (
    r'''(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>'''
    r'''|</?[a-z](?:[^"'>]|"[^"]*"|'[^']*')*>|<[!?][^>]*>|[^<]+|<'''
).replace("'", "''")
TOKENS = rf"""SELECT page_id, i, CASE
    WHEN regexp_matches(t, '(?is)^<(script|style)\b') THEN regexp_extract(t, '(?is)^<(?:script|style)\b[^>]*>(.*)</(?:script|style)\s*>$', 1)
    WHEN t LIKE '<%' AND length(t) > 1 THEN ''
    ELSE regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') END AS node
  FROM (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS i
    FROM (SELECT page_id, regexp_extract_all(html, '{ELEMENT}') AS ts FROM pages))"""
BODY = rf"""SELECT page_id, coalesce(string_agg(node, ' ' ORDER BY i), '') AS body
  FROM (SELECT page_id, i, regexp_replace(node, '^\s+|\s+$', '', 'g') AS node FROM ({TOKENS}))
  WHERE node <> '' GROUP BY page_id"""

HOLED_ITEMS = """SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount,
  nullif(l_tax, 0) AS l_tax FROM lineitem"""


def _describe(source: str, columns: tuple[str, ...], by: str = "") -> str:
    parts, group = [], f"GROUP BY {by}" if by else ""
    for c in columns:
        stats = {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
            "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)",
            "q75": f"quantile_cont({c}, 0.75)",
        }
        cols = ", ".join(f'{r(x, 4)} AS "{n}"' for n, x in stats.items())
        keys = f"{by}, " if by else ""
        parts.append(f"SELECT {keys}'{c}' AS column_name, count({c}) AS \"count\", {cols} FROM ({source}) {group}")
    return " UNION ALL ".join(parts)


def _nulls() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM ({HOLED_ITEMS})"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE null_count > 0"


def _diff() -> str:
    names = ["material_id", "product", "pcm_type", "flammability", *MATERIAL_DOUBLES]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, (SELECT count(*) - count("{c}") FROM ({HOLED})) AS null_before,
        (SELECT count(*) - count("{c}") FROM ({RULED})) AS null_after"""
        for c in names
    )


def _hole_of(i: int) -> str:
    return f"l_suppkey % {5 + i} = {i % 5}"


def _mice() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({_hole_of(i)}) AS holes, 0::BIGINT AS changed,
        0::BIGINT AS left_empty, 0::BIGINT AS outside FROM (SELECT DISTINCT l_suppkey FROM lineitem)"""
        for i, c in enumerate(q.MICE_COLUMNS)
    )


def _mice_cells() -> str:
    values = ["avg(l_quantity)", "avg(l_extendedprice)", "avg(l_discount)", "avg(l_tax)"]
    cells = ", ".join(
        f"""{r(f"CASE WHEN NOT {_hole_of(i)} THEN {values[i % 4]} * {1.0 + i}::DOUBLE END")} AS "{c}", true AS "{c}_ok\""""
        for i, c in enumerate(q.MICE_COLUMNS)
    )
    return f"SELECT l_suppkey, {cells} FROM lineitem GROUP BY l_suppkey"


FUSED_FIRSTS = [
    "RRTDHS", "month", "DOY", "year", "season_code", "sunrise_hour", "sunset_hour",
    "high_solar_resource", "lat", "lon", "altitude_m", "T_set",
]
FUSED_STATS = {
    "GHI_mean": 'avg("GHI")', "GHI_max": 'max("GHI")', "GHI_daily_kWh_m2": 'sum("GHI") / 1000.0::DOUBLE',
    "DNI_mean": 'avg("DNI")', "DNI_max": 'max("DNI")', "DHI_mean": 'avg("DHI")',
    "T_amb_mean": 'avg("T_amb")', "T_amb_max": 'max("T_amb")', "T_amb_min": 'min("T_amb")',
    "RHum_mean": 'avg("RHum")', "W_spd_mean": 'avg("W_spd")', "W_spd_max": 'max("W_spd")',
    "cloud_cover_mean": "avg(cloud_cover)", "CSI_mean": 'avg("CSI")', "SZA_mean": 'avg("SZA")',
    "ETR_mean": 'avg("ETR")', "ETR_max": 'max("ETR")', "P_atm_mean": 'avg("P_atm")',
    "precipitation_sum": "sum(precipitation)", "demand_total_L": f"sum({litres('hour')})",
}
FUSED_MATERIAL = [
    "Tm_melting", "Tm_freezing", "latent_heat_melting", "heat_storage_Wh_kg", "TC_both",
    "density_solid", "Cp_avg", "rho_H_MJ_m3", "pcm_suitability_score", "best_pcm_Tm",
    "optimal_Tm_target",
]
LAGGED = ["GHI_mean", "T_amb_mean", "T_amb_max", "CSI_mean", "cloud_cover_mean"]


def _suited() -> str:
    """The printed catalogue read back, filled, limited to its range, complete, with codes."""
    printed = ", ".join(f"""printf('%.6f', "{c}")::DOUBLE AS "{c}\"""" for c in MATERIAL_DOUBLES)
    filled = FILLED.replace(HOLED, f"SELECT * REPLACE ({printed}) FROM ({HOLED})")
    return f"""SELECT * FROM ({filled}) WHERE "Tm_melting" BETWEEN 35 AND 75 AND latent_heat_melting IS NOT NULL"""


def _catalogue() -> str:
    doubles = ["Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting", "latent_heat_avg", "Tm_range", "max_op_temp", "cycles_confidence"]
    return f"""SELECT product, pcm_type, (dense_rank() OVER (ORDER BY pcm_type) - 1)::INTEGER AS pcm_type_code,
      (dense_rank() OVER (ORDER BY flammability) - 1)::INTEGER AS flammability_enc, is_flammable, flash_point_known,
      {rounded_columns(doubles)}, true AS fill_ok FROM ({derived(_suited())})"""


def _chosen() -> str:
    """Climate, scored catalogue and best material per city and season."""
    coded = f"""SELECT *, (dense_rank() OVER (ORDER BY pcm_type) - 1)::INTEGER AS pcm_type_code FROM ({derived(_suited())})"""
    catalogue = topsis(coded, "*").replace("AS score FROM", "AS pcm_suitability_score FROM", 1)
    index = """SELECT city, season, max("T_set") AS "T_set", avg("RRTDHS") AS rrtdhs_approx FROM climate GROUP BY city, season"""
    return f"""{_climate()}, catalogue AS ({catalogue}), chosen AS ({assign(index, "SELECT * FROM catalogue")})"""


def _fused_hourly() -> str:
    doubles = ["GHI", "RRTDHS", "best_pcm_Tm", "optimal_Tm_target", "rrtdhs_approx", "Tm_melting",
               "latent_heat_melting", "TC_both", "cycles_confidence", "pcm_suitability_score"]
    return f"""{_chosen()} SELECT city, timestamp, season, {litres("hour")} AS "demand_L_per_hr",
      (CASE {level(litres("hour"))} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)::INTEGER AS demand_code,
      {index_bin('"RRTDHS"')} AS rrtdhs_bin, best_pcm_product, best_pcm_id, is_flammable, pcm_type_code,
      coalesce(best_pcm_product, 'unknown') AS pcm_label,
      (dense_rank() OVER (ORDER BY coalesce(best_pcm_product, 'unknown')) - 1)::INTEGER AS pcm_label_code,
      {rounded_columns(doubles, 4)}
      FROM climate LEFT JOIN (SELECT * EXCLUDE ("T_set") FROM chosen) USING (city, season)
      LEFT JOIN (SELECT product, "Tm_melting", latent_heat_melting, "TC_both", cycles_confidence,
        pcm_suitability_score, is_flammable, pcm_type_code FROM catalogue) ON best_pcm_product = product"""


def _fused() -> str:
    firsts = ", ".join(
        f"""(min({{'t': timestamp, 'v': "{c}"}}) FILTER ("{c}" IS NOT NULL)).v AS "{c}\""""
        for c in [*FUSED_FIRSTS, "season", "climate_zone"]
    )
    stats = ", ".join(f'{x} AS "{n}"' for n, x in FUSED_STATS.items())
    material = ", ".join(f'"{c}"' for c in FUSED_MATERIAL[:9])
    ints = {"month", "DOY", "year", "season_code", "high_solar_resource", "altitude_m"}
    doubles = [
        *FUSED_STATS, *[c for c in FUSED_FIRSTS if c not in ints], *FUSED_MATERIAL,
        *lag_names(LAGGED), "GHI_mean_roll7", "T_amb_mean_roll7", "GHI_next_day", "T_amb_next_day",
    ]
    others = ["city", "date", "season", "climate_zone", *sorted(ints), "is_flammable",
              "pcm_type_code", "pcm_label", "pcm_label_code", "best_pcm_product"]
    return f"""{_chosen()},
    daily AS (SELECT city, timestamp::DATE AS date, {stats}, {firsts} FROM climate GROUP BY city, timestamp::DATE),
    fused AS (SELECT daily.*, best_pcm_product, "best_pcm_Tm", "optimal_Tm_target", {material}, is_flammable, pcm_type_code,
      coalesce(best_pcm_product, 'unknown') AS pcm_label,
      (dense_rank() OVER (ORDER BY coalesce(best_pcm_product, 'unknown')) - 1)::INTEGER AS pcm_label_code
      FROM daily LEFT JOIN (SELECT * EXCLUDE ("T_set", rrtdhs_approx) FROM chosen) USING (city, season)
      LEFT JOIN (SELECT product, {material}, is_flammable, pcm_type_code FROM catalogue) ON best_pcm_product = product)
    SELECT {', '.join(f'"{c}"' for c in others)}, {rounded_columns(doubles, 4)}
    FROM (SELECT *, {lags(LAGGED)}, {roll7(["GHI_mean", "T_amb_mean"])}, {NEXT} FROM fused {W})"""


def _lineitem(columns: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem"


def _numeric() -> str:
    n, above = "p_size::VARCHAR", "(p_size + 7)::VARCHAR"
    forms = [
        f"'~' || {n}", f"{n} || '-' || {above}", f"{n} || '-' || {above} || ' (Peak: ' || {n} || '.5)'",
        f"'> ' || {n} || '.25'", f"{n} || ' (provisional)'", "'Under Trial'",
        f"'-' || {n} || '-' || {above}", f"'  ' || {n} || ' - ' || {above} || ' '", "'   '",
    ]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms))
    return rf"""SELECT p_partkey, cell, CASE WHEN peak <> '' THEN peak::DOUBLE
      WHEN trimmed LIKE '%-%' AND trimmed NOT LIKE '-%' AND len(nums) >= 2 THEN (nums[1]::DOUBLE + nums[2]::DOUBLE) / 2.0::DOUBLE
      ELSE nums[1]::DOUBLE END AS number
    FROM (SELECT *, regexp_extract(trimmed, '(?i)peak:\s*([0-9.]+)', 1) AS peak,
      regexp_extract_all(regexp_replace(trimmed, '([0-9.])\s*-\s*([0-9])', '\1 \2', 'g'), '-?[0-9]+\.?[0-9]*') AS nums
      FROM (SELECT p_partkey, cell, trim(cell) AS trimmed
        FROM (SELECT p_partkey, CASE p_partkey % {len(forms)} {cases} END AS cell FROM part)))"""


def oracle_sql() -> dict[str, str]:
    order_firsts = ["GHI_mean", "T_amb_mean", "T_amb_max"]
    order_base = f"city, date, {rounded_columns(order_firsts)}"
    month_window = f"""SELECT *, greatest(avg("GHI") OVER m / nullif(45.0::DOUBLE - avg("T_amb") OVER m, 0), 0.0::DOUBLE) AS idx
      FROM ({ORDER_HOURS}) WINDOW m AS (PARTITION BY city, date_trunc('month', timestamp)::DATE)"""
    t, dew = "(l_quantity - 5.0::DOUBLE)", "(l_quantity * (l_discount + 0.9::DOUBLE) - 5.0::DOUBLE)"
    u, v = "(l_quantity - 25.0::DOUBLE)", "(l_discount * 100.0::DOUBLE - 5.0::DOUBLE)"
    events_month = season("month(ts)")
    keywords = "(?i)" + "|".join(q.PAGE_KEYWORDS)
    first_altitude = "(min({'t': timestamp, 'v': altitude_m}) FILTER (altitude_m IS NOT NULL)).v"
    labels = " UNION ALL ".join(
        f"SELECT '{c}' AS city, '{s}' AS season, '{p}' AS best_pcm_product" for c, s, p in q.SITE_LABELS
    )
    return {
        "daily_rollup": f"""SELECT city, date, altitude_m, season, {rounded_columns(STAT_COLUMNS)} FROM (
          SELECT city, timestamp::DATE AS date, {DAILY_STATS}, {first_altitude} AS altitude_m,
          arg_min({season('month')}, timestamp) AS season FROM ({EVENT_HOURS}) GROUP BY ALL)""",
        "daily_increment": f"""SELECT city, date, altitude_m, season, {rounded_columns(STAT_COLUMNS)} FROM (
          SELECT city, timestamp::DATE AS date, {DAILY_STATS}, {first_altitude} AS altitude_m,
          arg_min({season('month')}, timestamp) AS season FROM ({EVENT_HOURS}) GROUP BY ALL)""",
        "daily_lags": f"""SELECT {order_base}, {rounded_columns(lag_names(order_firsts))}
          FROM (SELECT *, {lags(order_firsts)} FROM ({ORDER_DAYS}) {W})""",
        "daily_roll7": f"""SELECT {order_base}, {rounded_columns(["GHI_mean_roll7", "T_amb_mean_roll7"])}
          FROM (SELECT *, {roll7(["GHI_mean", "T_amb_mean"])} FROM ({ORDER_DAYS}))""",
        "next_day_target": f"""SELECT {order_base}, {rounded_columns(["GHI_next_day", "T_amb_next_day"])}
          FROM (SELECT *, {NEXT} FROM ({ORDER_DAYS}) {W})""",
        "daily_features": f"""SELECT city, date, altitude_m, month, "DOY", year, season, season_code,
          {rounded_columns([*STAT_COLUMNS, *lag_names(LAGGED), "GHI_mean_roll7", "T_amb_mean_roll7", "GHI_next_day", "T_amb_next_day"])}
          FROM (SELECT *, {lags(LAGGED)}, {roll7(["GHI_mean", "T_amb_mean"])}, {NEXT} FROM (
            SELECT city, timestamp::DATE AS date, {DAILY_STATS}, {first_altitude} AS altitude_m,
            arg_min(month, timestamp) AS month, arg_min(dayofyear(timestamp)::INTEGER, timestamp) AS "DOY",
            arg_min(year(timestamp)::INTEGER, timestamp) AS year, arg_min({season('month')}, timestamp) AS season,
            arg_min({season_code(season('month'))}, timestamp) AS season_code
            FROM ({EVENT_HOURS}) GROUP BY city, timestamp::DATE) {W})""",
        "monthly_means": f"""SELECT city, date_trunc('month', timestamp)::DATE AS month_start,
          {r('avg("GHI")')} AS "Q_sol_ave", {r('avg("T_amb")')} AS "T_out_ave" FROM ({ORDER_HOURS}) GROUP BY ALL""",
        "monthly_index": f"""SELECT o_orderkey, city, {r("idx")} AS "RRTDHS", coalesce((idx > 5.7)::INTEGER, 0) AS high_solar_resource,
          {index_bin("idx")} AS rrtdhs_bin FROM ({month_window})""",
        "season_index": f"""SELECT city, {season("month(timestamp)")} AS season, {r("avg(idx)")} AS rrtdhs_approx
          FROM ({month_window}) GROUP BY ALL""",
        "season_features": f"""SELECT o_orderkey, hour(o_orderdate)::INTEGER AS hour, month(o_orderdate)::INTEGER AS month,
          dayofyear(o_orderdate)::INTEGER AS "DOY", year(o_orderdate)::INTEGER AS year,
          {season("month(o_orderdate)")} AS season, {season_code(season("month(o_orderdate)"))} AS season_code,
          date_trunc('month', o_orderdate)::DATE AS month_start, o_orderdate::DATE AS date FROM orders""",
        "demand_profile": f"""SELECT event_id, hour, x AS "demand_L_per_hr", {level("x")} AS demand_level,
          (CASE {level("x")} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)::INTEGER AS demand_code,
          (hour BETWEEN 6 AND 8)::INTEGER AS is_morning_peak, (hour BETWEEN 18 AND 20)::INTEGER AS is_evening_peak
          FROM (SELECT event_id, hour(ts)::INTEGER AS hour, {litres("hour(ts)")} AS x FROM events)""",
        "demand_bins": f"""SELECT event_id, {index_bin("x")} AS rrtdhs_bin, coalesce((x > 5.7)::INTEGER, 0) AS high_solar_resource
          FROM (SELECT event_id, nullif(floor(value), 5) / 5.0::DOUBLE AS x FROM events)""",
        "humidity": _lineitem(f'{r(rh(t, dew))} AS "RHum"'),
        "wind": _lineitem(
            f'{r(f"sqrt({u} * {u} + {v} * {v})")} AS "W_spd", '
            f'{r(pmod(f"degrees(atan2({u}, {v}))", "360.0::DOUBLE"))} AS "W_dir"'
        ),
        "unit_convert": _lineitem(
            f'{r("l_quantity + 260.0::DOUBLE - 273.15::DOUBLE")} AS "T_amb", '
            f'{r("greatest((l_extendedprice * 20.0::DOUBLE - 100000.0::DOUBLE) / 3600.0::DOUBLE, 0.0::DOUBLE)")} AS "GHI", '
            f'{r("least(greatest(l_discount * 20.0::DOUBLE - 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)")} AS cloud_cover, '
            f'{r("l_tax / 100.0::DOUBLE * 1000.0::DOUBLE")} AS precipitation, '
            f'{r("(l_extendedprice + 90000.0::DOUBLE) / 100.0::DOUBLE")} AS "P_atm"'
        ),
        "solar_geometry": f"""SELECT event_id, city, {rounded_columns(["SZA", "solar_azimuth", "ETR"])}
          FROM ({solar(SITED_EVENTS)})""",
        "clear_sky": f"""SELECT event_id, city, {r('"GHI_clearsky"')} AS "GHI_clearsky", {r(CSI)} AS "CSI"
          FROM ({clearsky(solar(SITED_EVENTS))})""",
        "diffuse": f"""SELECT event_id, city, {r('greatest("GHI" - "GHI" * 0.7::DOUBLE * cos(radians("SZA")), 0.0::DOUBLE)')} AS "DHI"
          FROM ({solar(SITED_EVENTS)})""",
        "sun_times": f"""SELECT event_id, city, {r(sun_hour(True))} AS sunrise_hour, {r(sun_hour(False))} AS sunset_hour
          FROM ({SITED_EVENTS})""",
        "climate_hourly": f"""{_climate()} SELECT {', '.join(f'"{c}"' for c in CLIMATE_OTHERS)},
          {rounded_columns(CLIMATE_DOUBLES, 5)} FROM climate""",
        "label_join": f"""SELECT event_id, city, season, best_pcm_product, label AS pcm_label,
          (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS pcm_label_code
          FROM (SELECT event_id, e.city, e.season, best_pcm_product, coalesce(best_pcm_product, 'unknown') AS label
            FROM (SELECT event_id, event_type AS city, {events_month} AS season FROM events) e
            LEFT JOIN ({labels}) l ON e.city = l.city AND e.season = l.season)""",
        "label_classes": """SELECT (row_number() OVER (ORDER BY x) - 1)::INTEGER AS pcm_label_code, x AS pcm_label FROM (
          SELECT DISTINCT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'unknown') AS x FROM orders)""",
        "label_encode": f"""SELECT material_id, coalesce(pcm_type, 'Unknown') AS pcm_type, product,
          (dense_rank() OVER (ORDER BY coalesce(pcm_type, 'Unknown')) - 1)::INTEGER AS pcm_type_code,
          (dense_rank() OVER (ORDER BY product) - 1)::INTEGER AS product_code FROM ({HOLED})""",
        "material_join": """SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS best_pcm_product,
          p_size::DOUBLE AS "Tm_melting", p_retailprice AS latent_heat_melting
          FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
        "site_metadata": f"""SELECT l_orderkey, l_linenumber, l_suppkey, {r("s_acctbal / 100.0::DOUBLE")} AS lat,
          s_nationkey AS altitude_m, s_name AS climate_zone FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
        "label_assign": f"""SELECT city, season, best_pcm_product, best_pcm_id,
          {rounded_columns(["T_set", "rrtdhs_approx", "optimal_Tm_target", "best_pcm_Tm", "best_pcm_score"])}
          FROM ({assign(SUPPLIER_SEASONS, '''SELECT p_partkey AS material_id, p_name || ' ' || p_partkey::VARCHAR AS product,
          (p_size % 4) * 12.0::DOUBLE + 33.0::DOUBLE + (p_partkey % 20) / 10.0::DOUBLE AS "Tm_melting",
          p_retailprice / 1000.0::DOUBLE AS pcm_suitability_score FROM part''')})""",
        "numeric_extract": _numeric(),
        "rule_fill": f"SELECT material_id, product, pcm_type, flammability, {rounded_columns(MATERIAL_DOUBLES)} FROM ({FILLED})",
        "range_filter": f"""SELECT material_id, "Tm_melting", latent_heat_melting, (flash_point IS NOT NULL)::INTEGER AS flash_point_known
          FROM ({HOLED}) WHERE "Tm_melting" BETWEEN 35 AND 75 AND latent_heat_melting IS NOT NULL""",
        "stage_counts": f"""SELECT 'input' AS stage, count(*) AS "rows" FROM ({HOLED}) UNION ALL
          SELECT 'in_range', count(*) FROM ({HOLED}) WHERE "Tm_melting" BETWEEN 35 AND 75 UNION ALL
          SELECT 'complete', count(*) FROM ({HOLED}) WHERE "Tm_melting" BETWEEN 35 AND 75 AND latent_heat_melting IS NOT NULL""",
        "stage_observe": f"""SELECT 'input' AS stage, count(*) AS "rows" FROM ({HOLED}) UNION ALL
          SELECT 'in_range', count(*) FROM ({HOLED}) WHERE "Tm_melting" BETWEEN 35 AND 75 UNION ALL
          SELECT 'complete', count(*) FROM ({HOLED}) WHERE "Tm_melting" BETWEEN 35 AND 75 AND latent_heat_melting IS NOT NULL""",
        "sketch_quartiles": " UNION ALL ".join(
            f"""SELECT l_returnflag, '{c}' AS column_name, count(*) AS count, min({c}) AS min, max({c}) AS max,
            true AS q25_ok, true AS q50_ok, true AS q75_ok FROM lineitem GROUP BY l_returnflag"""
            for c in ("l_quantity", "l_extendedprice")
        ),
        "derived_props": f"""SELECT material_id, flash_point_known, is_flammable, {r("latent_per_degree", 1)} AS latent_per_degree,
          {rounded_columns(["latent_heat_avg", "Tm_range", "heat_storage_Wh_kg", "rho_H_MJ_m3", "TC_ratio", "Cp_avg",
                            "density_avg", "cycles_confidence", "rho_H_melting"])}
          FROM ({derived(HOLED)})""",
        "topsis": f"SELECT l_suppkey, {r('score')} AS score FROM ({topsis(SUPPLIERS, 'l_suppkey')})",
        "minmax_score": f"SELECT l_suppkey, {r(MINMAX)} AS score FROM ({SUPPLIERS})",
        "rank_materials": """SELECT p_partkey, row_number() OVER (ORDER BY floor(p_retailprice) / 10.0::DOUBLE DESC,
          p_name || ' ' || p_partkey::VARCHAR) AS place FROM part""",
        "describe": _describe(HOLED_ITEMS, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "describe_by": _describe("FROM lineitem", ("l_quantity", "l_extendedprice"), "l_returnflag"),
        "null_profile": _nulls(),
        "missing_diff": _diff(),
        "spatial_mean": f"""SELECT l_returnflag AS site, l_shipdate AS timestamp, {r("avg(l_quantity)")} AS t2m,
          {r("avg(nullif(l_discount, 0))")} AS tcc, {r("avg(l_extendedprice)")} AS ssrd FROM lineitem GROUP BY ALL""",
        "grid_slice": """SELECT l_orderkey, l_linenumber, l_shipdate AS timestamp, l_quantity AS latitude,
          l_extendedprice AS longitude FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_extendedprice BETWEEN 1000 AND 60000
          AND year(l_shipdate) IN (1996, 1998, 1999) AND month(l_shipdate) IN (1, 2, 6, 7, 12)
          AND day(l_shipdate) <= 20 AND hour(l_shipdate) IN (0, 6, 12)""",
        "assign_sites": """SELECT l_orderkey, l_linenumber, l_quantity AS latitude,
          l_extendedprice / 1000.0::DOUBLE AS longitude, s_suppkey AS site FROM lineitem JOIN supplier
          ON l_quantity BETWEEN (s_suppkey % 50) - 0.5::DOUBLE AND (s_suppkey % 50) + 1.0::DOUBLE
          AND l_extendedprice / 1000.0::DOUBLE BETWEEN s_acctbal / 100.0::DOUBLE AND s_acctbal / 100.0::DOUBLE + 1.5::DOUBLE""",
        "union_sites": """SELECT event_type AS city, ts AS timestamp, value AS "GHI", NULL::DOUBLE AS "P_atm" FROM events
          UNION ALL SELECT o_orderstatus, o_orderdate, NULL::DOUBLE, o_totalprice FROM orders""",
        "distinct_days": "SELECT DISTINCT ts::DATE AS date FROM events",
        "page_title": r"""SELECT page_id, CASE WHEN regexp_matches(html, '"title":"(.*?)","') THEN regexp_extract(html, '"title":"(.*?)","', 1)
          WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title\s*>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1) END AS title,
          CASE WHEN regexp_matches(html, '"abstract":"(.*?)","') THEN regexp_extract(html, '"abstract":"(.*?)","', 1) END AS abstract
          FROM pages""",
        "page_text": f"SELECT page_id, length(body)::INTEGER AS n_chars, md5(body) AS digest FROM ({BODY})",
        "keyword_sentences": rf"""SELECT page_id, no::INTEGER AS sentence_no, sentence FROM (
          SELECT page_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS no FROM (
            SELECT page_id, string_split(regexp_replace(body, '([.!?]) +', '\1' || {SPLIT_MARK}, 'g'), {SPLIT_MARK}) AS parts
            FROM ({BODY}))) WHERE regexp_matches(sentence, '{keywords}')""",
        "mice_impute": _mice_cells(),
        "mice_check": _mice(),
        "catalogue_path": _catalogue(),
        "csv_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
        "site_sink": "SELECT p_partkey, p_name, p_brand, p_size FROM part",
        "box_slice": """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_shipdate AS "timestamp", l_quantity,
            (l_orderkey * 7919 + l_suppkey * 104729) % 720 / 4.0::DOUBLE - 90.0::DOUBLE AS latitude,
            ((l_orderkey * 7919 + l_suppkey * 104729) * 31 + l_partkey) % 1440 / 4.0::DOUBLE - 180.0::DOUBLE AS longitude FROM lineitem)
          WHERE latitude BETWEEN 10 AND 50 AND longitude BETWEEN -20 AND 60.5""",
        "site_resume": """SELECT o_orderkey, o_totalprice * CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS o_totalprice,
          o_orderstatus, year(o_orderdate)::INTEGER AS o_year FROM orders""",
        "year_replace": """SELECT o_orderkey, o_totalprice * CASE WHEN rerun THEN -1 ELSE 1 END AS o_totalprice, o_orderstatus, o_year
          FROM (SELECT *, year(o_orderdate)::INTEGER AS o_year, year(o_orderdate) = 1995 AND o_orderstatus <> 'O'
            AND max(o_orderkey % 2 = 0) OVER (PARTITION BY o_orderstatus, year(o_orderdate)) AS rerun FROM orders)
          WHERE NOT rerun OR o_orderkey % 2 = 0""",
        "grid_scan": """SELECT l_linestatus AS site, l_shipdate AS "timestamp", l_suppkey AS latitude, l_linenumber AS longitude,
          l_quantity AS t2m, nullif(l_discount, 0) AS tcc FROM lineitem""",
        "dedupe_drop": """SELECT event_id, event_type AS city, value AS "GHI" FROM events""",
        "local_day": f"""SELECT event_type AS city, (ts + INTERVAL 330 MINUTE)::DATE AS date, {r("avg(value)")} AS "GHI_mean",
          month(any_value(ts + INTERVAL 330 MINUTE))::INTEGER AS month FROM events
          WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
        "fused_hourly": _fused_hourly(),
        "fused_daily": _fused(),
    }
