"""Valuation models: leakage-free preprocessing, target forms, time-split selection, refit, importance.

Gradient-boosted trees are MLlib's; they stand where the usual boosting libraries would, and their scores are their own."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.operators.comps import WINDOWS
from propval.operators.selection import selected_few
from propval.session import shared_dir

MISSING = "__MISSING__"
#: Configurations that the search tries for each family.
GRID: dict[str, list[dict]] = {
    "ridge": [{"alpha": a} for a in (0.1, 1.0, 10.0, 100.0)],
    "forest": [{"numTrees": 40, "maxDepth": 8, "minInstancesPerNode": 5}, {"numTrees": 40, "maxDepth": 10, "minInstancesPerNode": 5}],
    "boosted": [{"maxIter": 40, "maxDepth": 5, "stepSize": 0.1}, {"maxIter": 20, "maxDepth": 6, "stepSize": 0.1}],
    "boosted_absolute": [{"maxIter": 40, "maxDepth": 5, "stepSize": 0.1}],
}
#: The whole search space: forests of 240 trees (MLlib's greatest depth, shares of the columns, least rows of a leaf), boosting of
#: up to 450 rounds that ends early.
FULL_GRID: dict[str, list[dict]] = {
    "ridge": GRID["ridge"],
    "forest": [{"numTrees": 240, "maxDepth": 30, "featureSubsetStrategy": share, "minInstancesPerNode": leaf} for share, leaf in (("0.7", 2), ("1.0", 2), ("0.7", 5))],
    "boosted": [{"maxIter": 450, "maxDepth": depth, "stepSize": 0.05, "minInstancesPerNode": leaf} for depth, leaf in ((4, 25), (5, 25), (6, 40))],
    "boosted_absolute": [{"maxIter": 450, "maxDepth": depth, "stepSize": 0.05, "minInstancesPerNode": 25} for depth in (5, 6)],
}
#: Training rows that a task is worth.
ROWS_OF_TASK = 40_000
#: Share of the training rows, by a hash, that tells boosting when to stop; the least gain that counts.
STOP_SHARE, STOP_GAIN = 0.1, 1e-3

# Names of the tables' columns.
NUMERIC = ["surface_reelle_bati", "nombre_pieces_principales", "latitude", "longitude", "adresse_numero", "nombre_lots", "month", "day_of_year", "year", "months_since_2021"]
SIZE, PLACE = ["log_surface", "rooms_per_10m2", "surface_terrain"], ["x_l93", "y_l93", "distance_center_m", "bearing_sin", "bearing_cos"]
COMPARABLE = [f"local_{t}d_{r}m_{k}" for r, t in WINDOWS for k in ("count", "median_ppm2")] + [
    "local_365d_500m_mad_ppm2", "weighted_comp_ppm2", "similar_weighted_comp_ppm2", "similar_comparable_count", "effective_comparable_count", "nearest_prior_sale_m", "median_comparable_age_days", "momentum_500m", "momentum_1000m",
]
DIAGNOSTIC = ["dpe_available_at_sale", "dpe_age_days", "dpe_surface_difference_ratio", "dpe_match_confidence", "annee_construction_dpe", "nombre_niveau_logement", "nombre_niveau_immeuble", "surface_habitable_immeuble", "surface_habitable_logement", "conso_5_usages_ep_m2", "emission_ges_5_usages_m2"]
DIAGNOSTIC_CLASSES = ["classe_bilan_dpe", "classe_emission_ges", "type_installation_chauffage", "type_energie_chauffage"]
BUILDING = ["ban_match_distance_m", "ban_match_confidence", "bdnb_match_confidence", "bdnb_address_candidate_count", "bdnb_parcel_candidate_count", "building_level_count", "building_year", "building_dwelling_count", "building_height_m", "building_footprint_m2", "building_parking_lot_count", "building_total_lot_count", "building_dwelling_count_rnc", "building_age_at_sale", "building_year_missing"]
BUILDING_CLASSES = ["usage_niveau_1_txt", "mat_mur_txt", "mat_toit_txt", "building_state", "building_period_rnc"]
CONTEXT = [
    "distance_metro_m", "distance_rer_m", "distance_train_m", "distance_tram_m", "rail_station_mode_count_1000m", "rail_line_count_1000m", "distance_school_m", "school_count_1000m", "distance_green_space_centroid_m", "green_space_count_500m", "green_area_500m2",
    "distance_shop_service_m", "shop_service_count_500m", "shop_service_count_1000m", "noise_road_lden_db", "noise_rail_ratp_lden_db", "noise_rail_sncf_lden_db", "noise_transport_lden_max_db",
]
IDENTITY_CLASSES = ["ban_address_id", "bdnb_building_id", "bdnb_match_method"]
AREA, CELLS = ["code_postal"], ["cell_r8", "cell_r9"]
GOLD_NUMERIC = NUMERIC + SIZE + PLACE + COMPARABLE
#: Ablations: (numbers, categories) of each named set, four over Gold and six over enriched Gold.
FEATURE_SETS: dict[str, tuple[list[str], list[str]]] = {
    "base": (NUMERIC, AREA),
    "spatial": (NUMERIC + SIZE + PLACE, AREA + CELLS),
    "comparables": (NUMERIC + SIZE + COMPARABLE, AREA),
    "full": (GOLD_NUMERIC, AREA + CELLS),
    "phase2": (GOLD_NUMERIC, AREA + CELLS),
    "dpe_safe": (GOLD_NUMERIC + DIAGNOSTIC, AREA + CELLS + DIAGNOSTIC_CLASSES),
    "building": (GOLD_NUMERIC + BUILDING, AREA + CELLS + BUILDING_CLASSES),
    "context": (GOLD_NUMERIC + CONTEXT, AREA + CELLS),
    "full_no_identity": (GOLD_NUMERIC + DIAGNOSTIC + BUILDING + CONTEXT, AREA + CELLS + DIAGNOSTIC_CLASSES + BUILDING_CLASSES),
    "full_identity": (GOLD_NUMERIC + DIAGNOSTIC + BUILDING + CONTEXT, AREA + CELLS + DIAGNOSTIC_CLASSES + BUILDING_CLASSES + IDENTITY_CLASSES),
}


def all_features() -> list[str]:
    """Every column of the feature sets, once."""
    return list(dict.fromkeys(c for numeric, categorical in FEATURE_SETS.values() for c in (*numeric, *categorical)))


def named_specs(df: DataFrame, names: Sequence[str], target: str = "total", **columns: str) -> dict[str, Spec]:
    """Specs of the named feature sets; a set whose columns df lacks is an error."""
    from propval.operators import contracts

    out = {}
    for name in names:
        numeric, categorical = FEATURE_SETS[name]
        contracts.columns(df, [*numeric, *categorical])
        out[name] = Spec(numeric, categorical, target, **columns)
    return out


@dataclass
class Spec:
    """What goes into a model."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    target: str = "total"  # total, ppm2 or residual
    price: str = "price"
    surface: str = "surface"
    anchor: str = "anchor"
    #: What a missing category becomes: a level of its own, or its training rows' `most_frequent` one.
    missing: str = "own_level"


@dataclass
class Fitted:
    spec: Spec
    medians: dict[str, float]
    model: PipelineModel
    seconds: float = 0.0
    meta: dict = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def target_column(spec: Spec) -> F.Column:
    """log1p of the price or price per m2, or the log ratio of price per m2 to the anchor."""
    price, per = F.col(spec.price).cast("double"), F.try_divide(F.col(spec.price).cast("double"), F.col(spec.surface))
    return {"total": F.log1p(price), "ppm2": F.log1p(per), "residual": F.ln(F.try_divide(per, F.col(spec.anchor)))}[spec.target]


def inverse_column(spec: Spec, raw: str) -> F.Column:
    """The price that a raw prediction stands for, at least 0; null where a residual has no anchor."""
    x = F.col(raw)
    value = {"total": F.expm1(x), "ppm2": F.expm1(x) * F.col(spec.surface), "residual": F.exp(x) * F.col(spec.anchor) * F.col(spec.surface)}[spec.target]
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The median of each column, 0 where it has no value; all columns in the same passes."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    found = selected_few(long, "i", "v", [0.5])
    return {c: found[i][0] if i in found else 0.0 for i, c in enumerate(columns)}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Each category's most frequent level, the first by name of equally frequent ones; a column without levels has none. One pass over all
    columns, whose levels are counted and reduced by key."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns])).alias("x")).select("x.*").where("level IS NOT NULL")
    counted = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    return {r["column"]: r["best"]["level"] for r in counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "level")).alias("best")).collect()}


def prepared(df: DataFrame, spec: Spec, medians: dict[str, float], modes: dict[str, str] | None = None) -> DataFrame:
    """Numbers imputed by training medians with missing flags set before; missing categories get their mode, or a level of their own where
    there is none."""
    out = df
    for c in spec.numeric:
        out = out.withColumn(f"{c}__missing", F.col(c).isNull().cast("double"))
    out = out.withColumns({f"{c}__in": F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in spec.numeric})
    return out.withColumns({f"{c}__cat": F.coalesce(F.col(c).cast("string"), F.lit((modes or {}).get(c, MISSING))) for c in spec.categorical})


@dataclass
class Ready:
    """Training rows as every configuration of a feature set reads them, held until `release`."""

    rows: DataFrame
    medians: dict[str, float]
    modes: dict[str, str]

    def release(self) -> None:
        self.rows.unpersist()


def numbers_of(spec: Spec) -> list[str]:
    return [f"{c}__in" for c in spec.numeric] + [f"{c}__missing" for c in spec.numeric]


def ready(train: DataFrame, spec: Spec, early_stop: bool = False) -> Ready:
    """The rows whose target exists, imputed from these rows alone."""
    train = train.withColumn("__y", target_column(spec)).where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    medians = exact_medians(train, spec.numeric)
    modes = most_frequent(train, spec.categorical) if spec.missing == "most_frequent" else {}
    numbers = numbers_of(spec)
    held = F.pmod(F.xxhash64("__y", *numbers), F.lit(1000)) < int(1000 * STOP_SHARE)
    rows = prepared(train, spec, medians, modes).select("__y", *numbers, *[f"{c}__cat" for c in spec.categorical], *([held.alias("__stop")] if early_stop else []))
    # trees pass over the rows once a level: few rows in many tasks are all overhead
    tasks = max(1, -(-rows.count() // ROWS_OF_TASK))
    if tasks < rows.rdd.getNumPartitions():
        rows = rows.repartition(tasks)
    return Ready(rows.persist(), medians, modes)


def fit(family: str, config: dict, train: DataFrame, spec: Spec, early_stop: bool = False, made: Ready | None = None) -> Fitted:
    """Fits on the rows whose target exists. Levels and medians come from the training rows alone; new levels share a bucket.

    With early_stop, boosting ends once a hashed share of the rows is predicted no better. `made`, if given, is what `ready` made of the same rows (its time is not counted)."""
    start = time.perf_counter()
    own = made or ready(train, spec, early_stop)
    rows, numbers = own.rows, numbers_of(spec)
    stages: list = []
    cats = list(spec.categorical)
    if cats:
        stages.append(StringIndexer(inputCols=[f"{c}__cat" for c in cats], outputCols=[f"{c}__ix" for c in cats], handleInvalid="keep", stringOrderType="frequencyDesc"))
    names = [f"{c}__ix" for c in cats]
    if family == "ridge" and cats:
        stages.append(OneHotEncoder(inputCols=names, outputCols=[f"{c}__hot" for c in cats], dropLast=False, handleInvalid="keep"))
        names = [f"{c}__hot" for c in cats]
    stages.append(VectorAssembler(inputCols=numbers, outputCol="__numbers", handleInvalid="keep"))
    if family == "ridge":
        stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True))
    stages.append(VectorAssembler(inputCols=["__scaled" if family == "ridge" else "__numbers", *names], outputCol="__features", handleInvalid="keep"))
    common = {"featuresCol": "__features", "labelCol": "__y", "predictionCol": "__raw"}
    if family == "ridge":
        # MLlib divides the penalty by the label's deviation (the population's in its normal equations); this gives alpha as it stands
        n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop("__y")).first()
        stages.append(LinearRegression(elasticNetParam=0.0, regParam=config["alpha"] / max(1, n) * (spread or 1.0), standardization=False, **common))
    elif family == "forest":
        stages.append(RandomForestRegressor(seed=42, maxBins=64, **config, **common))
    elif family in ("boosted", "boosted_absolute"):
        stop = {"validationIndicatorCol": "__stop", "validationTol": STOP_GAIN} if early_stop else {}
        loss = "absolute" if family == "boosted_absolute" else "squared"
        stages.append(GBTRegressor(seed=42, maxBins=64, lossType=loss, checkpointInterval=10, **config, **common, **stop))
    else:
        raise ValueError(family)
    try:
        model = Pipeline(stages=stages).fit(rows)
    finally:
        if made is None:
            own.release()
    return Fitted(spec, own.medians, model, time.perf_counter() - start, {"family": family, "config": config, "retrospective_static_context": True}, own.modes)


def described(fitted: Fitted) -> dict:
    """What, beside the pipeline itself, a model needs to be loaded again."""
    return {"spec": asdict(fitted.spec), "medians": fitted.medians, "seconds": fitted.seconds, "modes": fitted.modes, **fitted.meta}


def load(spark: SparkSession, path: str) -> Fitted:
    """A model as `publish.publish_model` leaves it, with `described` as its meta."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Fitted(Spec(**meta["spec"]), meta["medians"], PipelineModel.load(f"{path}/model"), meta["seconds"], {k: v for k, v in meta.items() if k not in ("spec", "medians", "seconds", "modes")}, meta.get("modes", {}))


def predict(fitted: Fitted, df: DataFrame, name: str = "prediction") -> DataFrame:
    out = fitted.model.transform(prepared(df, fitted.spec, fitted.medians, fitted.modes))
    return out.select(*df.columns, inverse_column(fitted.spec, "__raw").alias(name))


def mae(df: DataFrame, actual: str, predicted: str) -> float:
    return float(df.agg(F.avg(F.abs(F.col(predicted) - F.col(actual)))).first()[0])


def timed(fitted: Fitted, df: DataFrame) -> dict:
    """Seconds of the fit, milliseconds to predict a thousand rows of df (scored in full), megabytes of the saved model."""
    start = time.perf_counter()
    n = predict(fitted, df).agg(F.count(F.lit(1)), F.sum("prediction")).first()[0]
    took = time.perf_counter() - start
    return {"fit_seconds": round(fitted.seconds, 3), "predict_ms_per_1000": round(1e6 * took / max(1, n), 3), "model_mb": round(saved_bytes(fitted.model, df.sparkSession) / 2**20, 3)}


def saved_bytes(model: PipelineModel, spark: SparkSession) -> int:
    """Bytes of the model as it is published."""
    path = f"{shared_dir(spark)}/propval-model-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        model.write().save(path)
        return int(fs.getContentSummary(where).getLength())
    finally:
        fs.delete(where, True)


def select_and_refit(families: Sequence[str], specs: dict[str, Spec], development: DataFrame, validation: DataFrame, final_train: DataFrame, grid: dict[str, list[dict]] | None = None, early_stop: bool = False, chosen: dict[str, Fitted] | None = None) -> tuple[dict[str, Fitted], list[dict]]:
    """For each feature set and family the configuration of least validation MAE (the first of equals), refitted on final_train; and the trial log.

    chosen, if given, gets the winners as fitted on development: their validation predictions are free of the validation year."""
    log, out = [], {}
    for set_name, spec in specs.items():
        made, winners = ready(development, spec, early_stop), {}
        for family in families:
            trials, best = [], None
            for config in (grid or GRID)[family]:
                fitted = fit(family, config, development, spec, early_stop, made)
                trials.append({"features": set_name, "family": family, "config": config, "mae": mae(predict(fitted, validation), spec.price, "prediction"), "seconds": fitted.seconds})
                if trials[-1]["mae"] == min(t["mae"] for t in trials) and sum(t["mae"] == trials[-1]["mae"] for t in trials) == 1:
                    best = fitted
            log += trials
            if chosen is not None:
                chosen[f"{family}_{set_name}"] = best
            winners[family] = min(trials, key=lambda t: t["mae"])["config"]
        made.release()
        made = ready(final_train, spec, early_stop)
        for family, config in winners.items():
            out[f"{family}_{set_name}"] = fit(family, config, final_train, spec, early_stop, made)
        made.release()
    return out, log


def export_predictions(test: DataFrame, fitted: dict[str, Fitted], key: str, price: str) -> DataFrame:
    """key, price and prediction_<model> (rounded to cents) of every model, in one wide table."""
    out = test
    for name, f in fitted.items():
        out = predict(f, out, f"prediction_{name}")
    return out.select(key, price, *[F.bround(f"prediction_{n}", 2).alias(f"prediction_{n}") for n in fitted])


def median_baseline(reference: DataFrame, target: DataFrame, area: str, ppm2: str, surface: str) -> DataFrame:
    """target with baseline: its area's median price per m2 (the overall median where the area is new) times its surface."""
    by = reference.where(F.col(area).isNotNull()).groupBy(area).agg(F.median(ppm2).alias("__m"))
    every = reference.agg(F.median(ppm2).alias("__g"))  # one row
    return target.join(by, area, "left").crossJoin(F.broadcast(every)).withColumn("baseline", F.coalesce("__m", "__g") * F.col(surface)).drop("__m", "__g")


def dealt(df: DataFrame, key: str, column: str, repeat: int) -> DataFrame:
    """df with the column's values dealt among its rows, by the order of hashes of id and repeat. For bounded samples: two global orders."""
    rank = lambda side: F.row_number().over(W.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(f"{side}{repeat}"))), key))
    right = df.select(F.col(column).alias("__v"), rank("b").alias("__n"))
    return df.withColumn("__n", rank("a")).join(right, "__n").withColumn(column, F.col("__v")).drop("__n", "__v")


def permutation_importance(fitted: Fitted, df: DataFrame, key: str, features: Sequence[str], repeats: int = 3, rows: int = 5000) -> DataFrame:
    """feature, importance: rise of MAE when a column's values are dealt among at most `rows` rows by a hash of id and repeat.

    One frame holds the sample as it is and with each column dealt, for every repeat, and is scored once. Whose values a row gets
    depends on the repeat alone, so two orders a repeat and one join deal all columns."""
    from propval.operators.stats import hashed_sample

    price = fitted.spec.price
    sample = hashed_sample(df, key, rows).select(key, *dict.fromkeys([price, fitted.spec.surface, *([fitted.spec.anchor] if fitted.spec.target == "residual" else []), *fitted.spec.numeric, *fitted.spec.categorical, *features]))
    each = sample.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rank = lambda side: F.row_number().over(W.partitionBy("__repeat").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.concat(F.lit(side), F.col("__repeat").cast("string")))), key))
    given = each.select("__repeat", rank("b").alias("__n"), F.struct(*features).alias("__given"))
    held = each.withColumn("__n", rank("a")).join(given, ["__repeat", "__n"])
    long = held.withColumn("__feature", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features])))
    long = long.withColumns({f: F.when(F.col("__feature") == f, F.col(f"__given.{f}")).otherwise(F.col(f)) for f in features}).drop("__given", "__n")
    errors = predict(fitted, long, "__prediction").groupBy("__feature", "__repeat").agg(F.avg(F.abs(F.col("__prediction") - F.col(price))).alias("mae"))
    base = F.max(F.when(F.col("__feature").isNull(), F.col("mae"))).over(W.partitionBy("__repeat"))  # a row for each feature
    return errors.withColumn("rise", F.col("mae") - base).where("__feature IS NOT NULL").groupBy(F.col("__feature").alias("feature")).agg(F.avg("rise").alias("importance"))


def gain_importance(fitted: Fitted) -> list[tuple[str, float]]:
    """Features of a tree model with their share of the gain; missing flags count for their column."""
    values = fitted.model.stages[-1].featureImportances.toArray()
    names = [*fitted.spec.numeric, *fitted.spec.numeric, *fitted.spec.categorical]
    total: dict[str, float] = {}
    for n, v in zip(names, values, strict=True):
        total[n] = total.get(n, 0.0) + float(v)
    s = sum(total.values()) or 1.0
    return sorted(((n, v / s) for n, v in total.items()), key=lambda x: (-x[1], x[0]))
