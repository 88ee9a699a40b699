"""Command line: python -m propval.cli COMMAND --help. Spark starts only once the arguments are valid."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import date

from propval.operators.ml import FEATURE_SETS
from propval.operators.valuation import Property, blended, validated


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="propval", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="transaction files to Gold")
    b.add_argument("--data", nargs="+", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--quality-report")
    b.add_argument("--availability-lag-days", type=int, default=90)
    m = sub.add_parser("benchmark", help="select on the validation year, refit, score the test year")
    m.add_argument("--features", required=True)
    m.add_argument("--output-dir", required=True)
    m.add_argument("--train-end-year", type=int, default=2023)
    m.add_argument("--validation-year", type=int, default=2024)
    m.add_argument("--test-year", type=int, default=2025)
    m.add_argument("--families", nargs="+", default=["ridge", "boosted"])
    m.add_argument("--bootstrap-repetitions", type=int, default=500)
    m.add_argument("--sets", nargs="+", default=["base", "comparables"], choices=sorted(FEATURE_SETS))
    m.add_argument("--target", choices=("total", "ppm2", "residual"), default="total")
    m.add_argument("--search", choices=("short", "full"), default="short", help="configurations to try; the full search also stops boosting early")
    m.add_argument("--minimum-rows", type=int, default=1000, help="of the development, validation and test years each")
    e = sub.add_parser("enrich", help="Gold and the source tables (a Parquet folder each) to enriched Gold")
    e.add_argument("--gold", required=True)
    e.add_argument("--sources", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--audit", required=True)
    e.add_argument("--quality-report")
    v = sub.add_parser("value", help="comparables of one property, a model's estimate, and the blend with the local median")
    v.add_argument("--gold", required=True)
    v.add_argument("--model", help="a folder that benchmark published; else --base-estimate")
    v.add_argument("--addresses", help="the address table; the property is then put where its address is")
    v.add_argument("--commune", default="")
    v.add_argument("--street-code", default="")
    v.add_argument("--number", type=int)
    v.add_argument("--suffix", default="")
    v.add_argument("--report")
    for name, kind in (("longitude", float), ("latitude", float), ("surface", float)):
        v.add_argument(f"--{name}", type=kind, required=True)
    v.add_argument("--rooms", type=int)
    v.add_argument("--date", type=date.fromisoformat, required=True)
    v.add_argument("--postal-code", default="")
    v.add_argument("--base-estimate", type=float)
    v.add_argument("--weight", type=float, default=0.75)
    v.add_argument("--asking-price", type=float)
    v.add_argument("--supported-years", type=int, nargs=2, metavar=("FIRST", "LAST"), help="years for which the model was evaluated; other dates are an error")
    v.add_argument("--calibration", help="a table with code_postal, valeur_fonciere and a prediction of past sales; the estimate's distribution is then given")
    v.add_argument("--calibration-prediction", default="prediction", help="the name of that prediction")
    return p


#: Longitudes and latitudes of the city, and rooms, of which a studio may have none. Fixed values.
LONGITUDES, LATITUDES, ROOMS = (2.20, 2.48), (48.80, 48.92), (0, 15)


def build(a: argparse.Namespace) -> dict:
    from propval.operators import contracts
    from propval.plans.gold import gold
    from propval.session import build_session, drop_written
    from propval.sources import publish, readers

    spark = build_session("build")
    table = gold(readers.transactions(spark, a.data), a.availability_lag_days)
    publish.publish_table(table, a.output)
    said = contracts.report(spark.read.parquet(a.output))
    if a.quality_report:
        publish.write_json(a.quality_report, said, default=str)
    drop_written(spark)
    return said


#: Comparable prices per m2 that may correct a model. Fixed values.
ANCHORS = ("weighted_comp_ppm2", "similar_weighted_comp_ppm2", "local_365d_500m_median_ppm2", "local_365d_1000m_median_ppm2")


def benchmark(a: argparse.Namespace) -> dict:
    from pyspark.sql import functions as F

    from propval.operators import cohort, ml, stats
    from propval.session import build_session, drop_written, written
    from propval.sources import publish

    spark = build_session("benchmark")
    g = spark.read.parquet(a.features).withColumn("anchor", F.col("local_365d_500m_median_ppm2"))
    s = cohort.year_split(g, "year", a.train_end_year, a.validation_year, a.test_year, a.minimum_rows)
    names = {"price": "valeur_fonciere", "surface": "surface_reelle_bati"}
    specs = ml.named_specs(g, a.sets, a.target, **names)
    chosen: dict = {}
    fitted, log = ml.select_and_refit(a.families, specs, s["development"], s["validation"], s["final_train"], ml.FULL_GRID if a.search == "full" else None, a.search == "full", chosen)
    out = ml.export_predictions(ml.median_baseline(s["final_train"], s["test"], "code_postal", "price_per_m2", "surface_reelle_bati"), fitted, "id_mutation", "valeur_fonciere")
    # the blend and the correction are chosen on the validation year, by models that have not seen it
    worth = lambda df: df.select("id_mutation", *[(F.col(c) * F.col("surface_reelle_bati")).alias(c) for c in ANCHORS])
    known = ml.export_predictions(s["validation"], chosen, "id_mutation", "valeur_fonciere").join(worth(s["validation"]), "id_mutation")
    both, how = stats.combined(written(known, "validation"), out.join(worth(s["test"]), "id_mutation"), "valeur_fonciere", [f"prediction_{n}" for n in fitted], ANCHORS)
    out = written(both.drop(*ANCHORS).withColumnsRenamed({"blend": "prediction_blend", "corrected": "prediction_corrected"}), "predictions")
    publish.publish_table(out, f"{a.output_dir}/predictions")
    for name, f in fitted.items():
        publish.publish_model(f.model, f"{a.output_dir}/models/{name}", ml.described(f), spark)
    scored = [*fitted, "blend", "corrected"]
    errors = out.select("id_mutation", *[F.abs(F.col(f"prediction_{n}") - F.col("valeur_fonciere")).alias(n) for n in scored])
    intervals = [r.asDict() for r in stats.bootstrap_intervals(errors, "id_mutation", scored, a.bootstrap_repetitions, next(iter(fitted))).collect()]
    metrics = {n: stats.metrics(out, "valeur_fonciere", f"prediction_{n}").first().asDict() for n in scored}
    said = {"trials": log, "combined": how, "metrics": metrics, "intervals": intervals, "costs": {n: ml.timed(f, s["test"]) for n, f in fitted.items()}}
    publish.write_json(f"{a.output_dir}/report.json", said, default=str)
    drop_written(spark)
    return said


def value(a: argparse.Namespace) -> dict:
    import math

    from pyspark.sql import functions as F

    from propval.functions import geo
    from propval.operators import ml
    from propval.operators.valuation import comparables, located, template
    from propval.plans import gold as plan
    from propval.session import build_session, drop_written
    from propval.sources import publish

    spark = build_session("value")
    x, y = (spark.range(1).select(c).first()[0] for c in geo.lambert93(F.lit(a.longitude), F.lit(a.latitude)))
    prop = validated(Property(x, y, a.surface, a.rooms, a.date, a.postal_code, a.commune, a.street_code, a.number, a.suffix, a.asking_price), rooms=ROOMS)
    history, found = spark.read.parquet(a.gold), {"method": "coordinates"}
    if a.addresses and a.number is not None:
        prop, found = located(spark.read.parquet(a.addresses), prop)
    row = comparables(plan.as_sales(history), prop).first().asDict()
    row["address"] = found
    median = row["local_365d_500m_median_ppm2"]
    anchor = None if median is None or math.isnan(median) else median
    base = a.base_estimate
    if a.model:
        fitted = ml.load(spark, a.model)
        given = {"date_mutation": a.date, "longitude": a.longitude, "latitude": a.latitude, "surface_reelle_bati": a.surface, "nombre_pieces_principales": float(a.rooms) if a.rooms else None, "code_postal": a.postal_code, "code_commune": a.commune, "adresse_code_voie": a.street_code, "adresse_numero": float(a.number) if a.number is not None else None, "adresse_suffixe": a.suffix}
        subject = plan.subject_row(history, {k: v for k, v in given.items() if k in history.columns})
        if "bdnb_building_id" in history.columns and found.get("bdnb_building_id"):
            # what the building's latest sale knew, its diagnostic only if it is not later than the valuation
            same = template(history, "bdnb_building_id", found["bdnb_building_id"], "date_mutation", a.date, ["id_mutation"], [c for c in history.columns if c.startswith(("building_", "bdnb_", "usage_", "mat_"))], list(plan.DIAGNOSTIC_COLUMNS), "date_etablissement_dpe").first()
            for c, x in (same.asDict() if same else {}).items():
                if c in subject.columns:
                    subject = subject.withColumn(c, F.lit(x).cast(subject.schema[c].dataType))
        base = ml.predict(fitted, subject.withColumn(fitted.spec.anchor, F.col("local_365d_500m_median_ppm2"))).first()["prediction"]
    if base is not None:
        row |= {"base_estimate": base, "estimate": blended(base, anchor, a.surface, a.weight)}
    if a.calibration and base is not None:
        row["distribution"] = distribution(spark, a, row["estimate"])
    if a.report:
        publish.write_json(a.report, row, default=str)
    drop_written(spark)
    return row


def distribution(spark, a: argparse.Namespace, estimate: float) -> dict:
    """Quantiles of the value and the chance that it is near the estimate, or no less than the asking price, from the calibration sales'
    ratios of price to prediction in the property's own pool."""
    from pyspark.sql import functions as F

    from propval.operators import stats

    past = spark.read.parquet(a.calibration).select(F.col("code_postal").alias("area"), F.col(a.calibration_prediction).cast("double").alias("predicted"), F.col("valeur_fonciere").cast("double").alias("price"))
    past = past.withColumn("ratio", F.try_divide("price", "predicted"))
    own = spark.createDataFrame([(1, a.postal_code or None, float(estimate), a.asking_price)], "id int, area string, estimate double, ask double")
    return stats.predictive(past, own, "id", "area", "predicted", "estimate", "ratio", "ask").drop("id").first().asDict()


def enrich(a: argparse.Namespace) -> dict:
    from propval.plans import gold as plan
    from propval.session import build_session, drop_written
    from propval.sources import publish

    spark = build_session("enrich")
    before = spark.read.parquet(a.gold)
    after, trail = plan.enriched(before, {name: spark.read.parquet(f"{a.sources.rstrip('/')}/{name}") for name in plan.SOURCES})
    publish.publish_table(after, a.output)
    publish.publish_table(trail, a.audit)
    said = plan.quality_report(before, spark.read.parquet(a.output), spark.read.parquet(a.audit))
    if a.quality_report:
        publish.write_json(a.quality_report, said, default=str)
    drop_written(spark)
    return said


def main(argv: Sequence[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "build" and a.availability_lag_days < 1:
        p.error("--availability-lag-days must be at least 1")
    if a.command == "value":
        try:
            years = tuple(a.supported_years) if a.supported_years else None
            validated(Property(a.longitude, a.latitude, a.surface, a.rooms, a.date, a.postal_code, a.commune, a.street_code.upper(), a.number, a.suffix, a.asking_price), rooms=ROOMS, years=years, box=(*LONGITUDES, *LATITUDES))
        except ValueError as e:
            p.error(str(e))
    print(json.dumps({"build": build, "enrich": enrich, "benchmark": benchmark, "value": value}[a.command](a), indent=2, default=str))


if __name__ == "__main__":
    main()
