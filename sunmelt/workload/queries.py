"""Each operator applied to the given tables.

The tables hold no weather or materials, so columns stand in for them: an event type or a
market segment is a site, an event value is irradiance, a part is a material. Every query
runs over whole tables. Computed doubles are rounded so that results of two engines that
add up in different orders compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmelt.functions import calendar as cal
from sunmelt.functions import materials as props
from sunmelt.functions import meteo, text
from sunmelt.functions.nulls import flag_gt, known_flag
from sunmelt.operators import columns, daily, encode, fuse, grid, impute, labels, profile, ranking, sites, sketches
from sunmelt.operators import textscan
from sunmelt.operators.filters import drop_missing, filter_range
from sunmelt.plans import climate, fusion, increment
from sunmelt.plans.materials import derived_properties, materials_clean, parse_numbers, scored_materials
from sunmelt.runtime import attach, checkpoint_dir, cut_lineage, spread_rows, written_table
from sunmelt.sources import sinks
from sunmelt.sources.tables import read_csv, read_grid, write_grid, write_table

# The two sites (see SITE_DIM) and a plain turbidity year for each.
SITES = (
    ("Coimbatore", 11.0, 77.0, 411, "hot-humid", 45.0),
    ("Jaisalmer", 26.9, 70.9, 225, "hot-arid", 55.0),
)
TURBIDITY_BASE = {"Coimbatore": 3.6, "Jaisalmer": 3.2}
TURBIDITY_STEP = 0.1
SITE_LABELS = (
    ("click", "winter", "beta"),
    ("view", "winter", "alpha"),
    ("error", "winter", "gamma"),
)
PAGE_KEYWORDS = (*text.KEYWORDS, "ation", "ough")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Round half up, with the halfway point moved a little, so that exact halves go the same
    way in every engine."""
    scale = F.lit(10.0**digits)
    return F.floor(c * scale + F.lit(0.501)) / scale


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [n for n, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: rounded(F.col(n), digits) for n in doubles})


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A few constant rows, kept in the plan."""
    structs = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names.split())]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def site_dim(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, SITES, "city lat lon altitude_m climate_zone T_set")


def turbidity(spark: SparkSession) -> DataFrame:
    rows = [
        (city, month, base + TURBIDITY_STEP * month)
        for city, base in TURBIDITY_BASE.items()
        for month in range(1, 13)
    ]
    return literal_rows(spark, rows, "city month TL")


# --- stand-in tables -------------------------------------------------------------------


def event_hours(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf, "events").select(
        F.col("event_type").alias("city"),
        F.col("ts").alias("timestamp"),
        v.alias("GHI"),
        (v * 0.5).alias("DNI"),
        F.pmod(v, F.lit(40.0)).alias("T_amb"),
        F.pmod(v, F.lit(12.0)).alias("W_spd"),
        (F.pmod("user_id", F.lit(100)) / F.lit(100.0)).alias("cloud_cover"),
        F.least(v / 300.0, F.lit(1.5)).alias("CSI"),
        (v / 1000.0).alias("precipitation"),
        F.col("user_id").alias("altitude_m"),
    )


def order_hours(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate"
    )
    segments = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = attach(orders, segments, ["c_custkey"], spread_by=["o_orderkey"])
    return joined.select(
        "o_orderkey",
        F.col("c_mktsegment").alias("city"),
        F.col("o_orderdate").alias("timestamp"),
        (F.col("o_totalprice") / 1000.0).alias("GHI"),
        F.pmod("o_totalprice", F.lit(40.0)).alias("T_amb"),
    )


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_rollup(
        order_hours(spark, sf), stats={"GHI": ("mean",), "T_amb": ("mean", "max")}, firsts=()
    )


def sited_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event seen from both sites."""
    places = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(city).alias("city"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"),
                    F.lit(alt).alias("altitude_m"),
                )
                for city, lat, lon, alt, _, _ in SITES
            ]
        )
    )
    return read(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("GHI"),
        places.alias("p"),
    ).select("event_id", "timestamp", "GHI", "p.*")


def weather_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as grid readings: the status is the site, the supplier is the cell."""
    site = F.when(F.col("l_linestatus") == "O", "Coimbatore").otherwise("Jaisalmer")
    hours = F.pmod("l_partkey", F.lit(24)).cast("int")
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, sf, "lineitem").select(
        site.alias("site"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), hours)).alias("time"),
        (F.pmod("l_suppkey", F.lit(10)) / F.lit(10.0)).alias("latitude"),
        (F.floor(F.col("l_suppkey") / 10) / F.lit(10.0)).alias("longitude"),
        (q + 265.15).alias("2m_temperature"),
        (q * 0.8 + 262.15).alias("2m_dewpoint_temperature"),
        (price * 20.0 - 100000.0).alias("surface_solar_radiation_downwards"),
        (q * 8.0).alias("mean_surface_direct_short_wave_radiation_flux"),
        (price * 15.0).alias("surface_thermal_radiation_downwards"),
        (q - 25.0).alias("10m_u_component_of_wind"),
        (F.col("l_discount") * 100.0 - 5.0).alias("10m_v_component_of_wind"),
        (F.col("l_tax") / 100.0).alias("total_precipitation"),
        (F.col("l_discount") * 11.0).alias("total_cloud_cover"),
        (price + 90000.0).alias("surface_pressure"),
    )


def supplier_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier with the five criteria of the score."""
    return (
        read(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.avg("l_extendedprice").alias("latent_heat_melting"),
            F.avg("l_discount").alias("TC_both"),
            F.avg("l_tax").alias("Cp_avg"),
            F.max("l_extendedprice").alias("rho_H_MJ_m3"),
            F.count(F.lit(1)).cast("double").alias("cycles_confidence"),
        )
    )


def holed_materials(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as materials with holes in every property."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")

    def hole(value: Column, every: int) -> Column:
        return F.when(F.pmod(k, F.lit(every)) != 0, value)

    return read(spark, sf, "part").select(
        k.alias("material_id"),
        F.concat_ws(" ", "p_name", k.cast("string")).alias("product"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.col("p_type")).alias("pcm_type"),
        F.when(F.pmod(k, F.lit(3)) == 0, "Yes").when(F.pmod(k, F.lit(3)) == 1, "No").alias("flammability"),
        hole(size + 25.0, 11).alias("Tm_melting"),
        hole(size + 24.0 + F.pmod(k, F.lit(3)), 5).alias("Tm_freezing"),
        hole(size + 20.0, 3).alias("Tm_nucleation"),
        hole(size * 4.0 + 50.0, 13).alias("latent_heat_melting"),
        hole(size * 4.0 + 45.0, 2).alias("latent_heat_freezing"),
        hole(size + 30.0, 4).alias("heat_storage_Wh_kg"),
        hole(F.col("p_retailprice"), 6).alias("density_liquid"),
        hole(F.col("p_retailprice") + 60.0, 7).alias("density_solid"),
        hole(size / 20.0, 8).alias("Cp_liquid"),
        hole(size / 25.0, 9).alias("Cp_solid"),
        hole(size / 100.0, 2).alias("TC_liquid"),
        hole(size / 80.0, 5).alias("TC_solid"),
        hole(size / 90.0, 3).alias("TC_both"),
        hole(size / 5.0, 10).alias("volume_expansion"),
        hole(size + 60.0, 4).alias("max_op_temp"),
        hole(size + 150.0, 5).alias("flash_point"),
        hole(size * 40.0, 2).alias("cycles_tested"),
    )


def holed_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier with ten linked averages, each with its own holes."""
    k = F.col("l_suppkey")
    means = (
        read(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"),
            F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"),
        )
    )
    values = (F.col("q"), F.col("p"), F.col("d"), F.col("t"))
    return means.select(
        "l_suppkey",
        *[
            F.when(F.pmod(k, F.lit(5 + i)) != i % 5, values[i % 4] * F.lit(1.0 + i)).alias(c)
            for i, c in enumerate(MICE_COLUMNS)
        ],
    )


MICE_COLUMNS = impute.CHAINED_COLUMNS


# --- queries ---------------------------------------------------------------------------


def demand_hours(spark: SparkSession, sf: str) -> DataFrame:
    hours = event_hours(spark, sf).withColumn(
        "season", cal.season_of(F.month("timestamp"))
    ).withColumn("hour", F.hour("timestamp"))
    return fuse.with_demand(hours)


def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(daily.daily_rollup(demand_hours(spark, sf)))


def daily_increment(spark: SparkSession, sf: str) -> DataFrame:
    """The daily table from stored days: early hours, then late ones of the same days, then January anew."""
    path, hours = shared_path(spark, "days"), demand_hours(spark, sf)
    late = F.coalesce(F.hour("timestamp") % 5 == 2, F.lit(False))
    increment.update_days(hours.where(~late), path)
    increment.update_days(hours.where(late), path)
    increment.update_days(hours.where(F.month("timestamp") == 1), path, redo=True)
    return round_all(increment.stored_days(spark, path, hours))


def daily_lags(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(daily.with_lags(order_days(spark, sf)))


def daily_roll7(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(daily.with_rolling_mean(order_days(spark, sf)))


def next_day_target(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(daily.with_next_day(order_days(spark, sf)))


def daily_features(spark: SparkSession, sf: str) -> DataFrame:
    hours = climate.time_features(event_hours(spark, sf))
    return round_all(daily.forecast_columns(daily.daily_rollup(fuse.with_demand(hours))))


def monthly_means(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(sites.monthly_means(order_hours(spark, sf)))


def monthly_index(spark: SparkSession, sf: str) -> DataFrame:
    hours = order_hours(spark, sf).withColumn("T_set", F.lit(45.0))
    out = fuse.with_index_bin(sites.with_heating_index(hours))
    return out.select(
        "o_orderkey", "city", rounded(F.col("RRTDHS")).alias("RRTDHS"), "high_solar_resource",
        "rrtdhs_bin",
    )


def season_index(spark: SparkSession, sf: str) -> DataFrame:
    hours = climate.time_features(order_hours(spark, sf).withColumn("T_set", F.lit(45.0)))
    return round_all(labels.season_index(sites.with_heating_index(hours)))


def season_features(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("timestamp"))
    return climate.time_features(orders).select(
        "o_orderkey", "hour", "month", "DOY", "year", "season", "season_code",
        cal.month_key(F.col("timestamp")).alias("month_start"),
        cal.day_key(F.col("timestamp")).alias("date"),
    )


def demand_profile(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("event_id", F.hour("ts").alias("hour"))
    return fuse.with_demand(events)


def demand_bins(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select(
        "event_id", (F.nullif(F.floor("value"), F.lit(5)) / F.lit(5.0)).alias("RRTDHS")
    )
    return fuse.with_index_bin(events).select(
        "event_id", "rrtdhs_bin",
        flag_gt(F.col("RRTDHS"), sites.HIGH_RESOURCE).alias("high_solar_resource"),
    )


def humidity(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("l_quantity") - 5.0
    dew = F.col("l_quantity") * (F.col("l_discount") + 0.9) - 5.0
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(meteo.relative_humidity(t, dew)).alias("RHum")
    )


def wind(spark: SparkSession, sf: str) -> DataFrame:
    u, v = F.col("l_quantity") - 25.0, F.col("l_discount") * 100.0 - 5.0
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        rounded(meteo.wind_speed(u, v)).alias("W_spd"),
        rounded(meteo.wind_direction(u, v)).alias("W_dir"),
    )


def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        rounded(meteo.celsius(q + 260.0)).alias("T_amb"),
        rounded(meteo.hourly_flux(price * 20.0 - 100000.0)).alias("GHI"),
        rounded(meteo.cloud_fraction(F.col("l_discount") * 20.0 - 0.5)).alias("cloud_cover"),
        rounded(meteo.millimetres(F.col("l_tax") / 100.0)).alias("precipitation"),
        rounded(meteo.hectopascal(price + 90000.0)).alias("P_atm"),
    )


def solar_geometry(spark: SparkSession, sf: str) -> DataFrame:
    out = sites.with_solar_position(sited_events(spark, sf))
    return round_all(out.select("event_id", "city", "SZA", "solar_azimuth", "ETR"))


def clear_sky(spark: SparkSession, sf: str) -> DataFrame:
    out = sites.with_clear_sky(
        sites.with_solar_position(sited_events(spark, sf)), turbidity(spark)
    )
    return round_all(out.select("event_id", "city", "GHI_clearsky", "CSI"))


def diffuse(spark: SparkSession, sf: str) -> DataFrame:
    out = sites.with_solar_position(sited_events(spark, sf))
    dhi = meteo.diffuse_irradiance(F.col("GHI"), F.col("GHI") * 0.7, F.col("SZA"))
    return round_all(out.select("event_id", "city", dhi.alias("DHI")))


def sun_times(spark: SparkSession, sf: str) -> DataFrame:
    out = sites.with_sun_times(sited_events(spark, sf))
    return round_all(out.select("event_id", "city", "sunrise_hour", "sunset_hour"))


def climate_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(
        climate.climate_hourly(weather_grid(spark, sf), site_dim(spark), turbidity(spark)), 5
    )


def site_labels(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, SITE_LABELS, "city season best_pcm_product")


def label_join(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("city"),
        cal.season_of(F.month("ts")).alias("season"),
    )
    joined = fuse.join_labels(events, site_labels(spark), spread_by=["event_id"])
    return fuse.with_label_code(joined, fuse.label_classes(joined), spread_by=["event_id"])


def label_classes(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("best_pcm_product")
    )
    return fuse.label_classes(orders)


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    parts = holed_materials(spark, sf).select("material_id", "pcm_type", "product")
    return encode.label_encode(
        encode.label_encode(parts, "pcm_type", "pcm_type_code"), "product", "product_code"
    )


def material_join(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("best_pcm_product")
    )
    parts = read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("product"),
        F.col("p_size").cast("double").alias("Tm_melting"),
        F.col("p_retailprice").alias("latent_heat_melting"),
        F.col("p_brand").alias("manufacturer"),
    )
    return fuse.join_materials(items, parts, spread_by=["l_orderkey", "l_linenumber"])


def site_metadata(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    meta = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        (F.col("s_acctbal") / 100.0).alias("lat"),
        F.col("s_nationkey").alias("altitude_m"),
        F.col("s_name").alias("climate_zone"),
    )
    return round_all(sites.with_site(items, meta, "l_suppkey"))


def supplier_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as sites, each with an index of its own for the four seasons."""
    suppliers = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("city"),
        (F.pmod("s_nationkey", F.lit(5)) * 6.5 + 38.0).alias("T_set"),
        ((F.col("s_acctbal") + 1000.0) / 900.0).alias("base_index"),
    )
    return labels.approximate_index(suppliers).drop("base_index")


def label_assign(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = read(spark, sf, "part").select(
        F.col("p_partkey").alias("material_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("product"),
        (F.pmod("p_size", F.lit(4)) * 12.0 + 33.0 + F.pmod("p_partkey", F.lit(20)) / 10.0).alias("Tm_melting"),
        (F.col("p_retailprice") / 1000.0).alias("pcm_suitability_score"),
    )
    return round_all(labels.assign_labels(supplier_seasons(spark, sf), catalogue))


def numeric_extract(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    above = (F.col("p_size") + 7).cast("string")
    forms = [
        F.concat(F.lit("~"), n),
        F.concat(n, F.lit("-"), above),
        F.concat(n, F.lit("-"), above, F.lit(" (Peak: "), n, F.lit(".5)")),
        F.concat(F.lit("> "), n, F.lit(".25")),
        F.concat(n, F.lit(" (provisional)")),
        F.lit("Under Trial"),
        F.concat(F.lit("-"), n, F.lit("-"), above),
        F.concat(F.lit("  "), n, F.lit(" - "), above, F.lit(" ")),
        F.lit("   "),
    ]
    cell = F.get(F.array(*forms), F.pmod(k, F.lit(len(forms))).cast("int"))
    return read(spark, sf, "part").select(
        "p_partkey", cell.alias("cell"), text.messy_number(cell).alias("number")
    )


def rule_fill(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(impute.fallback_fill(impute.rule_fill(holed_materials(spark, sf))))


def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = drop_missing(filter_range(holed_materials(spark, sf)))
    return kept.select(
        "material_id", "Tm_melting", "latent_heat_melting",
        known_flag(F.col("flash_point")).alias("flash_point_known"),
    )


def stages() -> dict[str, Column]:
    return {"in_range": F.col("Tm_melting").between(35.0, 75.0), "complete": F.col("latent_heat_melting").isNotNull()}


def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_stages(holed_materials(spark, sf), stages())


def stage_observe(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, taken by the job that writes the table."""
    counted, seen = profile.observe_stages(holed_materials(spark, sf), stages())
    written_table(counted)
    return profile.observed_stages(spark, seen)


def derived_props(spark: SparkSession, sf: str) -> DataFrame:
    out = derived_properties(holed_materials(spark, sf))
    v1 = props.volumetric_enthalpy(F.col("density_solid"), F.col("latent_heat_melting"))
    kept = out.select(
        "material_id", "latent_per_degree", "latent_heat_avg", "Tm_range", "heat_storage_Wh_kg",
        "rho_H_MJ_m3", v1.alias("rho_H_melting"), "TC_ratio", "Cp_avg", "density_avg",
        "cycles_confidence", "flash_point_known", "is_flammable",
    )
    # A quotient by a millionth of a degree has fewer certain digits.
    return kept.select(
        *[
            (rounded(F.col(c), 1 if c == "latent_per_degree" else 6).alias(c) if kind == "double" else F.col(c))
            for c, kind in kept.dtypes
        ]
    )


def topsis(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.topsis(supplier_features(spark, sf)).select(
        "l_suppkey", rounded(F.col("pcm_suitability_score")).alias("score")
    )


def minmax_score(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.minmax_score(supplier_features(spark, sf)).select(
        "l_suppkey", rounded(F.col("pcm_suitability_score")).alias("score")
    )


def rank_materials(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("product"),
        (F.floor(F.col("p_retailprice")) / 10.0).alias("pcm_suitability_score"),
    )
    return ranking.rank_materials(parts, rank="place").select(
        "p_partkey", F.col("place").cast("long").alias("place")
    )


def holed_items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
    )


def describe(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(profile.describe(holed_items(spark, sf)), 4)


def describe_by(spark: SparkSession, sf: str) -> DataFrame:
    """The same statistics for every ship mark."""
    items = read(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return round_all(profile.describe(items, by=["l_returnflag"]), 4)


def sketch_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of every ship mark from stored sketches of days, each checked to have a rank within one percent."""
    names = ["l_quantity", "l_extendedprice"]
    items = read(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", *names)
    days = written_table(sketches.day_sketches(items, names, keys=["l_returnflag"], ts="l_shipdate"))
    merged = sketches.sketched_quantiles(sketches.merged_sketches(days, ["l_returnflag"]))
    values = items.select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in names])).alias("v"))
    joined = attach(values.select("l_returnflag", "v.*"), written_table(merged), ["l_returnflag", "column_name"], "inner", spread_by=["x"])
    keys, n = ["l_returnflag", "column_name", "count", "min", "max"], F.count(F.lit(1))
    near = [
        ((F.count_if(F.col("x") < F.col(name)) <= n * (q + 0.01)) & (F.count_if(F.col("x") <= F.col(name)) >= n * (q - 0.01))).alias(f"{name}_ok")
        for name, q in profile.QUARTILES.items()
    ]
    return round_all(joined.groupBy(*keys).agg(*near), 4)


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_profile(holed_items(spark, sf))


def missing_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = holed_materials(spark, sf)
    return profile.missing_diff(before, impute.rule_fill(before))


def spatial_mean(spark: SparkSession, sf: str) -> DataFrame:
    cells = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_suppkey").alias("latitude"), F.col("l_linenumber").alias("longitude"),
        F.col("l_quantity").alias("t2m"), F.nullif("l_discount", F.lit(0.0)).alias("tcc"),
        F.col("l_extendedprice").alias("ssrd"),
    )
    return round_all(grid.spatial_mean(cells))


def grid_slice(spark: SparkSession, sf: str) -> DataFrame:
    cells = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("latitude"), F.col("l_extendedprice").alias("longitude"),
    )
    return grid.slice_grid(
        cells, box=(40.0, 1000.0, 5.0, 60000.0), years=[1996, 1998, 1999],
        months=[1, 2, 6, 7, 12], days=list(range(1, 21)), hours=[0, 6, 12],
    )


def assign_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cells, suppliers as sites with a box each."""
    cells = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("latitude"),
        (F.col("l_extendedprice") / 1000.0).alias("longitude"),
    )
    lat, lon = F.pmod("s_suppkey", F.lit(50)), F.col("s_acctbal") / 100.0
    boxes = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("city"), (lat - 0.5).alias("lat_min"), (lat + 1.0).alias("lat_max"),
        lon.alias("lon_min"), (lon + 1.5).alias("lon_max"),
    )
    return grid.assign_sites(cells, boxes)


def union_sites(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select(
        F.col("event_type").alias("city"), F.col("ts").alias("timestamp"),
        F.col("value").alias("GHI"),
    )
    orders = read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("city"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("P_atm"),
    )
    return grid.union_tables([events, orders])


def distinct_days(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_days(read(spark, sf, "events"), ts="ts")


def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return textscan.page_heads(read(spark, sf, "pages"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    body = text.markup_text(F.col("html"))
    return read(spark, sf, "pages").select(
        "page_id", F.length(body).alias("n_chars"), F.md5(body.cast("binary")).alias("digest")
    )


def keyword_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return textscan.keyword_sentences(read(spark, sf, "pages"), keywords=PAGE_KEYWORDS)


def mice_impute(spark: SparkSession, sf: str) -> DataFrame:
    """What is certain of a fill of ten columns: observed values as they were, every hole
    filled with a value among the observed ones."""
    before = written_table(holed_suppliers(spark, sf))
    after = impute.chained_impute(before, MICE_COLUMNS)
    pairs = before.join(after.withColumnsRenamed({c: f"new_{c}" for c in MICE_COLUMNS}), "l_suppkey")
    bounds = before.agg(*[F.min(c).alias(f"lo_{c}") for c in MICE_COLUMNS], *[F.max(c).alias(f"hi_{c}") for c in MICE_COLUMNS])
    out = [F.col("l_suppkey")]
    for c in MICE_COLUMNS:
        new, slack = F.col(f"new_{c}"), F.abs(F.col(f"hi_{c}")) * 1e-9
        inside = (new >= F.col(f"lo_{c}") - slack) & (new <= F.col(f"hi_{c}") + slack)
        out += [rounded(F.when(F.col(c).isNotNull(), new)).alias(c), F.coalesce(inside, F.lit(False)).alias(f"{c}_ok")]
    return pairs.join(F.broadcast(bounds)).select(*out)  # one row of bounds


def mice_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any such fill: observed cells kept, no holes, values in range."""
    before = cut_lineage(holed_suppliers(spark, sf))
    after = impute.chained_impute(before, MICE_COLUMNS)
    pairs = before.join(after.withColumnsRenamed({c: f"new_{c}" for c in MICE_COLUMNS}), "l_suppkey")
    bounds = before.agg(
        F.struct(
            *[
                F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                for c in MICE_COLUMNS
            ]
        )
    ).scalar()
    rows = []
    for c in MICE_COLUMNS:
        old, new = F.col(c), F.col(f"new_{c}")
        lo, hi = F.col(f"_b.{c}.lo"), F.col(f"_b.{c}.hi")
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(old.isNull()).alias("holes"),
                F.count_if(old.isNotNull() & (old != new)).alias("changed"),
                F.count_if(new.isNull()).alias("left_empty"),
                # a mean of leaf means may leave the range by a rounding error only
                F.count_if((new < lo - F.abs(lo) * 1e-9) | (new > hi + F.abs(hi) * 1e-9)).alias("outside"),
            )
        )
    return pairs.withColumn("_b", bounds).agg(F.array(*rows).alias("s")).select(F.inline("s"))


def written_materials(spark: SparkSession, sf: str) -> DataFrame:
    """The materials as a maker prints them: numbers as texts in several forms."""
    k = F.col("material_id")
    df = spread_rows(holed_materials(spark, sf))
    doubles = [c for c, kind in df.dtypes if kind == "double"]

    def printed(c: str) -> Column:
        form = F.pmod(k, F.lit(5))
        before = F.when(form == 1, "~").when(form == 2, ">").when(form == 4, "1-999 (peak: ").when(form.isNotNull(), "")
        after = F.when(form == 3, " (provisional)").when(form == 4, ")").otherwise("")
        cell = F.concat(before, F.format_string("%.6f", F.col(c)), after)
        return F.when(F.col(c).isNotNull(), cell).otherwise(F.lit("Under Trial"))

    return df.withColumns({c: printed(c) for c in doubles})


def catalogue_path(spark: SparkSession, sf: str) -> DataFrame:
    """Raw catalogue under its printed headers to scores, with one round of forests: what follows
    from rules as it is, and of what forests fill that observed cells stay and others are in range."""
    printed = written_table(written_materials(spark, sf).drop("material_id"))
    raw = printed.withColumnsRenamed({name: header for header, name in columns.MATERIAL_HEADERS.items()})
    clean = written_table(materials_clean(raw, rounds=1))
    ruled = impute.rule_fill(written_table(parse_numbers(printed)))
    filled = impute.CHAINED_COLUMNS
    bounds = ruled.agg(*[f(c).alias(f"_{name}_{c}") for c in filled for name, f in (("lo", F.min), ("hi", F.max))])
    before = ruled.select("product", *[F.col(c).alias(f"_was_{c}") for c in filled])
    fine = F.col("pcm_suitability_score").between(-1e-9, 1 + 1e-9)
    for c in filled:
        new, slack = F.col(c), F.abs(F.col(f"_hi_{c}")) * 1e-9
        inside = (new >= F.col(f"_lo_{c}") - slack) & (new <= F.col(f"_hi_{c}") + slack)
        fine = fine & F.coalesce(new == F.col(f"_was_{c}"), F.lit(True)) & F.coalesce(inside, F.lit(False))
    out = attach(clean, before, ["product"], spread_by=["Tm_melting"]).join(F.broadcast(bounds))  # one row of bounds
    kept = ["Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting", "latent_heat_avg", "Tm_range", "max_op_temp", "cycles_confidence"]
    codes = ["pcm_type", "pcm_type_code", "flammability_enc", "is_flammable", "flash_point_known"]
    return round_all(out.select("product", *codes, *kept, fine.alias("fill_ok")))


def fusion_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly climate from the grid, scored materials, and the best material per season.

    The catalogue is filled by rules and fallbacks only: the chained forests are left out.
    """
    hourly = written_table(
        climate.climate_hourly(weather_grid(spark, sf), site_dim(spark), turbidity(spark))
    )
    raw = written_table(parse_numbers(written_table(written_materials(spark, sf))))
    raw = raw.withColumn("flash_point_known", known_flag(F.col("flash_point")))
    filled = impute.fallback_fill(impute.rule_fill(raw))
    suited = drop_missing(filter_range(filled))
    catalogue = written_table(scored_materials(suited))
    return hourly, catalogue, fusion.label_map(hourly, catalogue)


def fused_hourly(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.fused_hourly(*fusion_inputs(spark, sf))
    return round_all(
        out.select(
            "city", "timestamp", "season", "GHI", "RRTDHS", "demand_L_per_hr", "demand_code",
            "rrtdhs_bin", *fuse.LABEL_PAYLOAD, "Tm_melting", "latent_heat_melting", "TC_both",
            "cycles_confidence", "pcm_suitability_score", "is_flammable", "pcm_type_code",
            "pcm_label", "pcm_label_code",
        ),
        4,
    )


def fused_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Grid to hourly climate, best materials, daily model table; without the chained forests."""
    hourly, catalogue, chosen = fusion_inputs(spark, sf)
    return round_all(fusion.daily_from_climate(hourly, catalogue, chosen, site_dim(spark)), 4)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV in two folders whose headers differ, one with a folder a status, read as one table."""
    path = shared_path(spark, "csv")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    odd = F.col("o_orderkey") % 2 == 1
    write_table(orders.where(odd), f"{path}/odd", "csv", ["o_orderstatus"])
    write_table(orders.where(~odd).select(*reversed(orders.columns)), f"{path}/even", "csv")
    layout = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    back = read_csv(spark, [f"{path}/odd", f"{path}/even"], layout, ts_cols=["o_orderdate"])
    return back.select(*orders.columns)


def site_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in one folder per brand, sorted by name; a second writing finds them and leaves them alone."""
    path = shared_path(spark, "sink")
    parts = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    write_table(parts, path, partition_by=["p_brand"], sort_by=["p_name"])
    write_table(parts.limit(0), path, partition_by=["p_brand"], if_exists="skip")
    return spark.read.schema(parts.schema).parquet(path).select(*parts.columns)


def sited_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("o_year"))


def site_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses F and O are there and stay; P was half-written and is written again, with what a later run has."""
    path, folders = shared_path(spark, "resume"), ["o_orderstatus", "o_year"]
    orders = sited_orders(spark, sf)
    status = F.col("o_orderstatus")
    sinks.write_missing(orders.where(status != "P"), path, folders, sort_by=["o_orderkey"])
    half = orders.where((status == "P") & (F.col("o_orderkey") % 2 == 0)).drop("o_orderstatus")
    write_table(half, f"{path}/o_orderstatus=P", partition_by=["o_year"])
    sinks.write_missing(orders.withColumn("o_totalprice", F.col("o_totalprice") * 2), path, folders, sort_by=["o_orderkey"])
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def year_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status and year; a rerun of 1995 replaces that year of the statuses it has rows of."""
    path, folders = shared_path(spark, "replace"), ["o_orderstatus", "o_year"]
    orders = sited_orders(spark, sf)
    sinks.replace_parts(orders, path, folders)
    held = spark.read.schema(orders.schema).parquet(path)
    rerun = held.where((F.col("o_year") == 1995) & (F.col("o_orderstatus") != "O") & (F.col("o_orderkey") % 2 == 0))
    sinks.replace_parts(rerun.withColumn("o_totalprice", -F.col("o_totalprice")), path, folders)
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def grid_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Line items stored as a grid with ``time`` and NaN, read by the grid scan."""
    path = shared_path(spark, "grid")
    cells = read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("site"), F.col("l_shipdate").alias("time"),
        F.col("l_suppkey").alias("latitude"), F.col("l_linenumber").alias("longitude"),
        F.col("l_quantity").alias("t2m"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("tcc"),
    )
    write_table(cells, path)
    return read_grid(spark, path)


def world_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as readings of cells all over the globe."""
    k = F.col("l_orderkey") * 7919 + F.col("l_suppkey") * 104729
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("timestamp"), "l_quantity",
        (F.pmod(k, F.lit(720)) / 4.0 - 90.0).alias("latitude"), (F.pmod(k * 31 + F.col("l_partkey"), F.lit(1440)) / 4.0 - 180.0).alias("longitude"),
    )


def box_slice(spark: SparkSession, sf: str) -> DataFrame:
    """A box of about 5 % of the globe from a grid stored along a curve."""
    path = shared_path(spark, "curve")
    write_grid(world_grid(spark, sf), path, row_group=64 * 1024)
    return grid.slice_grid(spark.read.parquet(path), box=(50.0, -20.0, 10.0, 60.5))


def dedupe_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a column twice and one that is not wanted."""
    events = read(spark, sf, "events")
    doubled = events.select("event_id", F.col("event_type").alias("city"), F.col("value").alias("GHI"), (F.col("value") * 2).alias("GHI"), "props")
    return columns.drop(columns.dedupe_columns(doubled), ["props", "not_there"])


def local_day(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means of a clock 330 minutes east of UTC."""
    clock = cal.local_time(F.col("timestamp"), 330)
    hours = event_hours(spark, sf).withColumn("local_time", clock).withColumn("month", F.month("local_time"))
    by_day = daily.daily_rollup(hours, ts=fusion.clock_of(hours), stats={"GHI": ("mean",)}, firsts=("month",))
    return round_all(by_day)


NAMES = (
    "csv_scan", "site_sink", "site_resume", "year_replace", "box_slice", "grid_scan", "dedupe_drop", "local_day",
    "daily_rollup", "daily_increment", "daily_lags", "daily_roll7", "next_day_target", "daily_features",
    "monthly_means", "monthly_index", "season_index", "season_features", "demand_profile",
    "demand_bins", "humidity", "wind", "unit_convert", "solar_geometry", "clear_sky", "diffuse",
    "sun_times", "climate_hourly", "label_join", "label_classes", "label_encode",
    "material_join", "site_metadata", "label_assign", "numeric_extract", "rule_fill",
    "range_filter", "stage_counts", "stage_observe", "derived_props", "topsis", "minmax_score",
    "rank_materials", "describe", "describe_by", "sketch_quartiles", "null_profile", "missing_diff", "spatial_mean", "grid_slice",
    "assign_sites",
    "union_sites", "distinct_days", "page_title", "page_text", "keyword_sentences",
    "mice_impute", "mice_check", "catalogue_path", "fused_hourly", "fused_daily",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
