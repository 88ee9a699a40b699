"""The two published tables: Gold (cohort, identity, comparables) and enriched Gold (linkage, buildings, diagnostics, context)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propval.functions import geo, scalar
from propval.operators import asof, cohort, comps, contracts, gridjoin, linkage, polygon
from propval.session import written
from propval.sources.readers import latest_by, tagged_union

DIAGNOSTIC_COLUMNS = ("annee_construction_dpe", "nombre_niveau_logement", "nombre_niveau_immeuble", "surface_habitable_immeuble", "surface_habitable_logement", "conso_5_usages_ep_m2", "emission_ges_5_usages_m2", "classe_bilan_dpe", "classe_emission_ges", "type_installation_chauffage", "type_energie_chauffage")
BUILDING_NUMBERS = ("building_level_count", "building_year", "building_dwelling_count", "building_height_m", "building_footprint_m2", "building_parking_lot_count", "building_total_lot_count", "building_dwelling_count_rnc")
RAIL_MODES = {"metro": "METRO", "rer": "RER", "train": "TRAIN", "tram": "TRAMWAY"}
UNMAPPED_DB = 50.0


# Gold -----------------------------------------------------------------------------------------------------


def with_identity(df: DataFrame) -> DataFrame:
    """Metric coordinates, polar features, size features, identifiers and cells."""
    x, y = geo.lambert93(F.col("longitude"), F.col("latitude"))
    out = df.withColumns({"x_l93": x, "y_l93": y})
    dist, sin, cos = geo.polar(F.col("x_l93"), F.col("y_l93"))
    return out.withColumns(
        {
            "distance_center_m": dist,
            "bearing_sin": sin,
            "bearing_cos": cos,
            "log_surface": F.log1p("surface_reelle_bati"),
            "rooms_per_10m2": scalar.rooms_per_10m2(F.col("nombre_pieces_principales"), F.col("surface_reelle_bati")),
            "street_id": scalar.street_id(F.col("code_commune"), F.col("adresse_code_voie")),
            "address_id": scalar.address_id(F.col("code_commune"), F.col("adresse_code_voie"), F.col("adresse_numero"), F.col("adresse_suffixe")),
            "parcel_id": scalar.parcel_id(F.col("id_parcelle")),
            **{f"cell_r{r}": geo.cell(F.col("x_l93"), F.col("y_l93"), r) for r in geo.CELL_METERS},
        }
    )


def as_sales(df: DataFrame) -> DataFrame:
    """The cohort in the names that comparables read."""
    return df.select(F.col("id_mutation").alias("sale_id"), F.col("date_mutation").alias("sale_date"), F.col("x_l93").alias("x"), F.col("y_l93").alias("y"), F.col("surface_reelle_bati").alias("surface"), F.col("nombre_pieces_principales").alias("rooms"), F.col("price_per_m2").alias("ppm2"))


def gold(lines: DataFrame, lag: int = comps.LAG) -> DataFrame:
    """One row a sale, checked; set-identical whatever the order (publish sorts by date and id)."""
    clean = written(with_identity(cohort.clean_sales(lines)), "cohort")
    contracts.unique(clean, "id_mutation")
    sales = as_sales(clean)
    features = comps.all_features(sales, sales, lag).withColumnRenamed("sale_id", "id_mutation")
    out = written(clean.join(features, "id_mutation"), "gold")
    contracts.same_rows(clean, out, "id_mutation")
    return out.orderBy("date_mutation", "id_mutation")


# enrichment -----------------------------------------------------------------------------------------------------


#: What linkage finds is named after the building database that it links to. Names of the table's columns.
LINKAGE_NAMES = {
    "building_id": "bdnb_building_id",
    "match_method": "bdnb_match_method",
    "match_confidence": "bdnb_match_confidence",
    "address_candidate_count": "bdnb_address_candidate_count",
    "parcel_candidate_count": "bdnb_parcel_candidate_count",
    "building_by_address": "bdnb_building_id_address",
    "building_by_parcel": "bdnb_building_id_parcel",
    "address_origin": "bdnb_address_origin",
    "address_reliability": "bdnb_address_reliability",
}


def linked(sales: DataFrame, addresses: DataFrame, rel_address: DataFrame, rel_parcel: DataFrame) -> DataFrame:
    """Address on the canonical key, building by address relation with the parcel as fallback, confidence of both."""
    key = "canonical_address_key"
    ban = addresses.select(
        scalar.address_key(F.col("code_insee"), F.right("id_fantoir", F.lit(4)), F.col("numero"), F.col("rep")).alias(key), F.col("id").alias("ban_address_id"), "id_fantoir", "certification_commune",
        F.col("x").try_cast("double").alias("ban_x"), F.col("y").try_cast("double").alias("ban_y"), "cad_parcelles",
    )
    ban = linkage.one_best(ban, key, [F.col("certification_commune").desc_nulls_last(), F.col("ban_address_id")])
    out = sales.withColumn(key, scalar.address_key(F.col("code_commune"), F.col("adresse_code_voie"), F.col("adresse_numero"), F.col("adresse_suffixe")))
    out = linkage.address_match(out.withColumns({"x": F.col("x_l93"), "y": F.col("y_l93")}), ban, key).drop("x", "y")
    rel = rel_address.select(F.col("cle_interop_adr").alias("ban_address_id"), F.col("batiment_groupe_id").alias("building_by_address"), F.col("origine").alias("address_origin"), F.col("fiabilite").try_cast("double").alias("address_reliability"))
    out = out.join(linkage.one_best(rel, "ban_address_id", [F.col("address_reliability").desc_nulls_last(), F.col("building_by_address")]), "ban_address_id", "left")
    out = linkage.lookup(out, linkage.candidate_counts(rel, "ban_address_id", "address_candidate_count"), "ban_address_id", "address_candidate_count", 0)
    par = rel_parcel.select(F.col("parcelle_id").alias("id_parcelle"), F.col("batiment_groupe_id").alias("building_by_parcel"), F.coalesce(F.col("parcelle_principale").try_cast("double"), F.lit(0.0)).alias("__main"))
    out = out.join(linkage.one_best(par, "id_parcelle", [F.col("__main").desc(), F.col("building_by_parcel")]).drop("__main"), "id_parcelle", "left")
    out = linkage.lookup(out, linkage.candidate_counts(par, "id_parcelle", "parcel_candidate_count"), "id_parcelle", "parcel_candidate_count", 0)
    out = linkage.resolve_buildings(out, "building_by_address", "building_by_parcel", "address_reliability", "address_candidate_count", "parcel_candidate_count")
    return out.withColumnsRenamed(LINKAGE_NAMES)


def with_buildings(df: DataFrame, buildings: DataFrame, ffo: DataFrame, bdtopo: DataFrame, rnc: DataFrame) -> DataFrame:
    df = written(df, "buildings")  # each step starts from a table: plans stay small, lost executors cost one step
    cx, cy = geo.wkt_centroid(F.col("geom_groupe"))
    key = "batiment_groupe_id"
    base = contracts.many_to_one(buildings, key).select(key, F.col("s_geom_groupe").alias("building_footprint_m2"), cx.alias("building_x"), cy.alias("building_y"))
    ffo = ffo.withColumnsRenamed({"nb_niveau": "building_level_count", "annee_construction": "building_year", "nb_log": "building_dwelling_count"})
    topo = bdtopo.withColumnsRenamed({"hauteur_mean": "building_height_m", "l_etat": "building_state"})
    rnc = rnc.withColumnsRenamed({"periode_construction_max": "building_period_rnc", "nb_lot_garpark": "building_parking_lot_count", "nb_lot_tot": "building_total_lot_count", "nb_log": "building_dwelling_count_rnc"})
    every = lambda t: [F.to_json(F.struct(*t.columns))]  # noqa: E731  a total order: equal rows are interchangeable
    star = linkage.stitched(base, [ffo, topo, rnc], key, [every(ffo), every(topo), every(rnc)]).withColumnRenamed(key, "bdnb_building_id")
    return linkage.building_features(df.join(star, "bdnb_building_id", "left"), BUILDING_NUMBERS, "year", "building_year")


def with_diagnostics(df: DataFrame, relation: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The latest diagnostic of the sale's building on or before the sale."""
    df = written(df, "diagnostics")  # each step starts from a table: plans stay small, lost executors cost one step
    dated = contracts.many_to_one(diagnostics, "identifiant_dpe").withColumn("date_etablissement_dpe", scalar.utc_naive(F.col("date_etablissement_dpe"))).where("date_etablissement_dpe IS NOT NULL")
    events = relation.select(F.col("batiment_groupe_id").alias("bdnb_building_id"), "identifiant_dpe").distinct().join(dated, "identifiant_dpe")
    probes = df.withColumn("__sale_ts", F.col("date_mutation").cast("timestamp_ntz"))
    out = asof.latest(probes, events, "bdnb_building_id", "__sale_ts", "date_etablissement_dpe", "identifiant_dpe", list(DIAGNOSTIC_COLUMNS))
    out = asof.diagnostic_features(out, "__sale_ts", "date_etablissement_dpe", "surface_habitable_logement", "surface_reelle_bati")
    numbers = ("surface_habitable_logement", "conso_5_usages_ep_m2", "emission_ges_5_usages_m2", "annee_construction_dpe", "nombre_niveau_logement", "nombre_niveau_immeuble", "surface_habitable_immeuble")
    return out.withColumns({c: F.col(c).try_cast("double") for c in numbers}).drop("__sale_ts")


def _targets(df: DataFrame) -> DataFrame:
    return df.select("id_mutation", F.col("x_l93").alias("x"), F.col("y_l93").alias("y"))


def _near(df: DataFrame, points: DataFrame, name: str) -> DataFrame:
    return df.join(gridjoin.nearest(_targets(df), points, "id_mutation").withColumnRenamed("distance_m", name), "id_mutation")


def _count(df: DataFrame, points: DataFrame, radius: float, name: str, weight: str | None = None) -> DataFrame:
    got = gridjoin.radius_aggregate(_targets(df), points, "id_mutation", radius, weight)
    return df.join(got.select("id_mutation", F.col("weight_sum" if weight else "n_points").alias(name)), "id_mutation")


def with_equipment(df: DataFrame, bpe: DataFrame, buildings: DataFrame) -> DataFrame:
    df = written(df, "equipment")  # each step starts from a table: plans stay small, lost executors cost one step
    cx, cy = geo.wkt_centroid(F.col("geom_groupe"))
    one = linkage.one_best(bpe, "batiment_groupe_id", [F.col("l_type_equipement")])
    points = one.join(buildings.select("batiment_groupe_id", cx.alias("x"), cy.alias("y")), "batiment_groupe_id", "left").withColumn("w", scalar.quoted_tokens(F.col("l_type_equipement")).cast("double"))
    out = _near(df, points, "distance_shop_service_m")
    return _count(_count(out, points, 500.0, "shop_service_count_500m", "w"), points, 1000.0, "shop_service_count_1000m", "w")


def with_transport(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Distance by mode; stations (once for each mode) and lines within 1 km."""
    df = written(df, "transport")  # each step starts from a table: plans stay small, lost executors cost one step
    mode = F.upper(F.trim("mode"))
    for label, name in RAIL_MODES.items():
        df = _near(df, stations.where(mode == name), f"distance_{label}_m")
    once = stations.withColumn("__n", F.coalesce("id_ref_zdc", F.lit("")))
    once = linkage.one_best(once.withColumn("__m", F.coalesce("mode", F.lit(""))), ["__n", "__m"], [F.col("x"), F.col("y")])
    return _count(_count(df, once, 1000.0, "rail_station_mode_count_1000m"), stations, 1000.0, "rail_line_count_1000m")


def with_schools(df: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    df = written(df, "schools")  # each step starts from a table: plans stay small, lost executors cost one step
    every = latest_by(tagged_union(families, "school_family"), ["school_family", "adresse"], F.col("annee_scol"))
    return _count(_near(df, every, "distance_school_m"), every, 1000.0, "school_count_1000m")


def with_green(df: DataFrame, parks: DataFrame) -> DataFrame:
    df = written(df, "green")  # each step starts from a table: plans stay small, lost executors cost one step
    once = linkage.one_best(parks, "nsq_espace_vert", [F.col("x"), F.col("y")]).withColumn("w", F.coalesce(F.col("surface_totale_reelle").try_cast("double"), F.lit(0.0)))
    out = _near(df, once, "distance_green_space_centroid_m")
    return _count(_count(out, once, 500.0, "green_space_count_500m"), once, 500.0, "green_area_500m2", "w")


def with_noise(df: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """families: road, rail_ratp and rail_sncf polygons (poly_id, level, ring). Outside the maps counts as 50 dB, flagged for road."""
    df = written(df, "noise")  # each step starts from a table: plans stay small, lost executors cost one step
    cols = []
    for name, polys in families.items():
        level = polygon.max_level(_targets(df), polygon.edges_of(polys), "id_mutation").select("id_mutation", F.col("level").cast("double").alias(f"noise_{name}_lden_db"))
        df = df.join(level, "id_mutation", "left")
        cols.append(f"noise_{name}_lden_db")
    df = df.withColumn("noise_road_lden_missing", F.col("noise_road_lden_db").isNull().cast("byte"))
    df = df.withColumns({c: F.coalesce(c, F.lit(UNMAPPED_DB)) for c in cols})
    return df.withColumn("noise_transport_lden_max_db", F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]))


def checked(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, if it has before's sales, each once, and knows no diagnostic of the future."""
    contracts.same_rows(before, after, "id_mutation")
    contracts.unique(after, "id_mutation")
    if "date_etablissement_dpe" in after.columns:
        contracts.no_future(after.withColumn("__ts", F.col("date_mutation").cast("timestamp_ntz")), "date_etablissement_dpe", "__ts")
    return after


AUDIT = ("canonical_address_key", "ban_address_id", "ban_match_method", "ban_match_distance_m", "ban_match_confidence", "bdnb_building_id", "bdnb_match_method", "bdnb_match_confidence", "bdnb_address_candidate_count", "bdnb_parcel_candidate_count")


def audit(df: DataFrame, columns: Sequence[str] = AUDIT) -> DataFrame:
    return linkage.audit(df, "id_mutation", columns)


#: What `enriched` reads, one table each; the last six may be left out.
SOURCES = ("addresses", "address_buildings", "parcel_buildings", "buildings", "building_levels", "building_shapes", "building_lots", "building_diagnostics", "diagnostics", "equipment", "stations", "schools", "parks", "noise")
#: Which of the added columns say what was so on the day of the sale, and which what is so today.
RETROSPECTIVE = ("address and building identity", "physical building attributes", "noise map", "stations", "schools, green spaces, shops and services")
POINT_IN_TIME = ("diagnostics of the sale's day or before", "historical comparables")


def enriched(sales: DataFrame, sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(enriched Gold, checked; the audit of its links). schools: with school_family; noise: with family (road, rail_ratp, rail_sncf)."""
    t = sources
    contracts.names(t, SOURCES)
    out = written(linked(sales, t["addresses"], t["address_buildings"], t["parcel_buildings"]), "linked")
    trail = audit(out)
    out = with_buildings(out, t["buildings"], t["building_levels"], t["building_shapes"], t["building_lots"])
    out = with_equipment(with_diagnostics(out, t["building_diagnostics"], t["diagnostics"]), t["equipment"], t["buildings"])
    out = with_transport(out, t["stations"])
    families = [r[0] for r in t["schools"].select("school_family").distinct().orderBy("school_family").collect()]  # a handful of files
    out = with_schools(out, {f: t["schools"].where(F.col("school_family") == f).drop("school_family") for f in families} or {"none": t["schools"].drop("school_family")})
    out = with_green(out, t["parks"])
    out = with_noise(out, {f: t["noise"].where(F.col("family") == f).drop("family") for f in ("road", "rail_ratp", "rail_sncf")})
    return checked(sales, written(out, "enriched")), trail


def quality_report(before: DataFrame, after: DataFrame, trail: DataFrame) -> dict:
    """Rows, columns, digests of both tables, shares matched, what was added with its null rates and temporal classes."""
    added = [c for c in after.columns if c not in before.columns]
    said = contracts.report(after, ["dpe_available_at_sale"])
    matched = linkage.match_rates(trail, "bdnb_match_method", "bdnb_match_confidence").first().asDict()
    return {
        "rows": said["rows"], "columns": said["columns"], "input_digest": contracts.digest(before), "output_digest": contracts.digest(after), "match": matched, "rates": said["rates"],
        "future_records": 0, "added": added, "missing": {c: said["missing"][c] for c in added}, "retrospective": list(RETROSPECTIVE), "point_in_time": list(POINT_IN_TIME),
    }


def subject_row(history: DataFrame, given: dict, lag: int = comps.LAG) -> DataFrame:
    """The Gold row of one property that has not been sold: `given` holds Gold's own columns (longitude, latitude, date_mutation, ...),
    the rest is computed as for a sale, or null."""
    one = history.sparkSession.createDataFrame([{"id_mutation": "subject", **given}], "struct<" + ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in history.schema if f.name in given or f.name == "id_mutation") + ">")
    for f in history.schema:
        if f.name not in one.columns:
            one = one.withColumn(f.name, F.lit(None).cast(f.dataType))
    one = cohort.with_calendar(with_identity(one), "date_mutation", 2021).select(*history.columns)
    sale = as_sales(one).withColumn("sale_id", F.lit("subject"))
    features = comps.all_features(sale, as_sales(history), lag).drop("sale_id")
    kept = [c for c in history.columns if c not in features.columns]
    return one.select(*kept).crossJoin(F.broadcast(features)).select(*history.columns)  # one row each
