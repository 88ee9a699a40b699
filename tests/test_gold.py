"""Gold and enriched Gold end to end on hand-built sources, and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from propval import cli
from propval.operators import contracts, ml
from propval.plans import gold
from propval.sources import publish, readers


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dvf")
    head = ",".join([*readers.TEXT_COLUMNS, *readers.NUMBER_COLUMNS])
    lines = [head]
    for i in range(40):
        day = f"202{1 + i // 20}-{1 + i % 12:02d}-15"
        lines.append(f"m{i:02d},{day},Vente,bis,RUE,0012,75011,75111,P{i % 3},2,{300000 + i * 1000},{i % 4 + 1},{40 + i % 5},{2 + i % 2},1,,{2.37 + (i % 7) * 0.0005},{48.85 + (i % 5) * 0.0005}")
    (d / "a.csv").write_text("\n".join(lines) + "\n")
    return str(d / "a.csv")


def test_gold(spark, table):
    g = gold.gold(readers.transactions(spark, [table]))
    rows = g.collect()
    assert len(rows) == 40 and [r.date_mutation for r in rows] == sorted(r.date_mutation for r in rows)
    r = next(r for r in rows if r.local_730d_1000m_count > 0)
    assert r.weighted_comp_ppm2 > 0 and r.address_id.startswith("75111_0012_") and r.address_id.endswith("_bis") and r.cell_r9.startswith("c9_")
    assert all(r.local_730d_1000m_count == 0 for r in rows if r.date_mutation.year == 2021 and r.date_mutation.month < 4)


def test_enriched(spark, table):
    g = gold.gold(readers.transactions(spark, [table])).persist()
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = lambda *names: ", ".join(f"{n} string" for n in names)
    addresses = df([("A1", "75111_0012", "1", "bis", "75111", "654000", "6861000", "1", ""), ("A0", "75111_0012", "1", "bis", "75111", "0", "0", "0", "")], s("id", "id_fantoir", "numero", "rep", "code_insee", "x", "y", "certification_commune", "cad_parcelles"))
    rel_a = df([("B1", "A1", "o", "20"), ("B2", "A1", "o", "3")], s("batiment_groupe_id", "cle_interop_adr", "origine", "fiabilite"))
    rel_p = df([("B3", "P0", "1"), ("B4", "P1", None), ("B5", "P1", "1")], s("batiment_groupe_id", "parcelle_id", "parcelle_principale"))
    out = gold.linked(g, addresses, rel_a, rel_p)
    got = {r.id_mutation: r for r in out.collect()}
    assert got["m00"].bdnb_building_id == "B1" and got["m00"].bdnb_match_confidence == 0.8 and got["m00"].bdnb_address_candidate_count == 2 and got["m00"].ban_address_id == "A1"
    assert got["m01"].bdnb_building_id == "B5" and got["m01"].bdnb_match_confidence == 0.5 and got["m03"].bdnb_building_id == "B3" and got["m03"].bdnb_match_confidence == 0.7
    assert got["m02"].bdnb_match_method == "unmatched" and got["m02"].bdnb_match_confidence == 0.0
    square = "POLYGON ((0 0, 4 0, 4 2, 0 0))"
    blds = df([("B1", square, "100"), ("B3", None, "x")], s("batiment_groupe_id", "geom_groupe", "s_geom_groupe"))
    ffo = df([("B1", "5", "1900", "h", "m", "t", "9"), ("B1", "5", "1900", "h", "m", "t", "9")], s("batiment_groupe_id", "nb_niveau", "annee_construction", "usage_niveau_1_txt", "mat_mur_txt", "mat_toit_txt", "nb_log"))
    topo = df([("B1", "n", "u", "e", "12.5")], s("batiment_groupe_id", "l_nature", "l_usage_1", "l_etat", "hauteur_mean"))
    rnc = df([("B3", "p", "1", "2", "3")], s("batiment_groupe_id", "periode_construction_max", "nb_lot_garpark", "nb_lot_tot", "nb_log"))
    out = gold.with_buildings(out, blds, ffo, topo, rnc)
    r = {x.id_mutation: x for x in out.collect()}
    assert r["m00"].building_age_at_sale == r["m00"].year - 1900 and r["m00"].building_x == 2.0 and r["m03"].building_year_missing == 1 and r["m03"].building_footprint_m2 is None
    rel_d = df([("B1", "D1"), ("B1", "D1"), ("B1", "D2")], s("batiment_groupe_id", "identifiant_dpe"))
    rest = ("1990", "1", "5", "900", "40", "100", "10", "D", "C", "i", "g")
    dpe = df([("D1", "2021-01-01T00:00:00Z", *rest), ("D2", "2022-06-01T10:00:00+02:00", *rest)], s("identifiant_dpe", "date_etablissement_dpe", *gold.DIAGNOSTIC_COLUMNS))
    out = gold.with_diagnostics(out, rel_d, dpe)
    r = {x.id_mutation: x for x in out.collect()}
    assert r["m00"].identifiant_dpe == "D1" and r["m00"].dpe_available_at_sale == 1 and r["m01"].dpe_available_at_sale == 0 and r["m01"].dpe_match_confidence == 0.0
    x0, y0 = r["m00"].x_l93, r["m00"].y_l93
    pts = df([("METRO", "z1", x0 + 30.0, y0), ("METRO", "z1", x0 + 30.0, y0), ("TRAMWAY", "z2", x0, y0 + 5000.0), ("RER", None, None, y0)], "mode string, id_ref_zdc string, x double, y double")
    out = gold.with_transport(out, pts)
    schools = df([("r1", "2020", x0, y0), ("r1", None, x0 + 400.0, y0)], "adresse string, annee_scol string, x double, y double")
    out = gold.with_schools(out, {"elementary": schools, "colleges": schools.limit(0)})
    out = gold.with_green(out, df([("g", x0, y0 + 100.0, "250.5"), ("h", x0, y0 - 50.0, None)], "nsq_espace_vert string, x double, y double, surface_totale_reelle string"))
    out = gold.with_equipment(out, df([("B1", '["a", "b"]')], s("batiment_groupe_id", "l_type_equipement")), df([("B1", f"POINT ({x0} {y0})")], s("batiment_groupe_id", "geom_groupe")))
    ring = [(x0 - 500, y0 - 500), (x0 + 500, y0 - 500), (x0 + 500, y0 + 500), (x0 - 500, y0 + 500)]
    polys = df([("p", 65, ring)], "poly_id string, level int, ring array<struct<x:double,y:double>>")
    out = gold.checked(g, gold.with_noise(out, {"road": polys.limit(0), "rail_ratp": polys, "rail_sncf": polys.limit(0)}))
    m = next(x for x in out.collect() if x.id_mutation == "m00")
    assert m.distance_metro_m == pytest.approx(30.0) and m.distance_tram_m == pytest.approx(5000.0) and m.distance_rer_m is None and (m.rail_station_mode_count_1000m, m.rail_line_count_1000m) == (1, 2)
    assert m.distance_school_m == pytest.approx(400.0) and m.school_count_1000m == 1 and (m.green_space_count_500m, m.green_area_500m2) == (2, 250.5)
    assert m.shop_service_count_500m == 2.0 and m.noise_transport_lden_max_db == 65.0 and m.noise_road_lden_missing == 1
    assert gold.audit(out).count() == 40
    # the same build as one function
    every = {"addresses": addresses, "address_buildings": rel_a, "parcel_buildings": rel_p, "buildings": df([("B1", f"POINT ({x0} {y0})", "100"), ("B3", None, "x")], s("batiment_groupe_id", "geom_groupe", "s_geom_groupe")), "building_levels": ffo, "building_shapes": topo, "building_lots": rnc,
             "building_diagnostics": rel_d, "diagnostics": dpe, "equipment": df([("B1", '["a", "b"]')], s("batiment_groupe_id", "l_type_equipement")), "stations": pts, "schools": schools.withColumn("school_family", F.lit("elementary")),
             "parks": df([("g", x0, y0 + 100.0, "250.5"), ("h", x0, y0 - 50.0, None)], "nsq_espace_vert string, x double, y double, surface_totale_reelle string"), "noise": polys.withColumn("family", F.lit("rail_ratp"))}
    table_, trail = gold.enriched(g, every)
    e = next(x for x in table_.collect() if x.id_mutation == "m00")
    for c in ("bdnb_building_id", "identifiant_dpe", "distance_metro_m", "rail_line_count_1000m", "school_count_1000m", "green_area_500m2", "shop_service_count_500m", "noise_transport_lden_max_db"):
        assert e[c] == m[c], c
    said = gold.quality_report(g, table_, trail)
    assert said["rows"] == 40 and said["input_digest"] != said["output_digest"] and said["missing"]["bdnb_building_id"] > 0 and "distance_metro_m" in said["added"]
    assert contracts.digest(table_.orderBy(F.rand())) == said["output_digest"]
    with pytest.raises(contracts.ContractError):
        gold.enriched(g, {"addresses": addresses})
    with pytest.raises(contracts.ContractError):
        gold.checked(g, out.union(out))
    with pytest.raises(contracts.ContractError):
        gold.checked(g, out.withColumn("date_etablissement_dpe", F.lit("2099-01-01").cast("timestamp_ntz")))
    g.unpersist()


def test_command_line(spark, table, tmp_path, monkeypatch, capsys):
    import propval.session

    monkeypatch.setattr(propval.session, "build_session", lambda *a, **k: spark)
    cli.main(["build", "--data", table, "--output", str(tmp_path / "gold"), "--quality-report", str(tmp_path / "q.json")])
    assert json.loads((tmp_path / "q.json").read_text())["rows"] == 40
    capsys.readouterr()
    cli.main(["value", "--gold", str(tmp_path / "gold"), "--longitude", "2.3705", "--latitude", "48.8505", "--surface", "42", "--rooms", "2", "--date", "2023-01-02", "--base-estimate", "400000"])
    said = json.loads(capsys.readouterr().out)
    assert said["local_730d_1000m_count"] > 0 and said["estimate"] > 0
    addresses = spark.createDataFrame([("75111_0012_00001_b", 654000.0, 6861000.0), ("75111_0012_00003", None, None)], "canonical_address_key string, x double, y double")
    addresses.write.parquet(str(tmp_path / "addresses"))
    fitted = ml.fit("ridge", {"alpha": 1.0}, spark.read.parquet(str(tmp_path / "gold")), ml.named_specs(spark.read.parquet(str(tmp_path / "gold")), ["comparables"], price="valeur_fonciere", surface="surface_reelle_bati")["comparables"])
    publish.publish_model(fitted.model, str(tmp_path / "model"), ml.described(fitted), spark)
    one = ["value", "--gold", str(tmp_path / "gold"), "--longitude", "2.3705", "--latitude", "48.8505", "--surface", "42", "--rooms", "2", "--date", "2023-01-02", "--postal-code", "75011", "--model", str(tmp_path / "model"), "--report", str(tmp_path / "v.json"), "--addresses", str(tmp_path / "addresses"), "--commune", "75111", "--street-code", "0012"]
    cli.main([*one, "--number", "3"])
    said = json.loads(capsys.readouterr().out)
    assert said["address"]["method"] == "exact_key_without_coordinates" and said["base_estimate"] > 0 and said["estimate"] > 0 and json.loads((tmp_path / "v.json").read_text())["base_estimate"] == said["base_estimate"]
    cli.main([*one, "--number", "9"])
    assert json.loads(capsys.readouterr().out)["address"]["method"] == "coordinates"
    with pytest.raises(contracts.ContractError):
        cli.main([*one, "--number", "1", "--suffix", "bis"])  # its address is elsewhere
    past = [("75011", 390000.0 + 100 * i, (390000.0 + 100 * i) * (0.8 + 0.4 * (i % 101) / 100)) for i in range(303)]
    spark.createDataFrame(past, "code_postal string, prediction double, valeur_fonciere double").write.parquet(str(tmp_path / "past"))
    cli.main([*one, "--calibration", str(tmp_path / "past"), "--asking-price", "300000"])
    said = json.loads(capsys.readouterr().out)
    shape, ratios = said["distribution"], sorted(v / p for _, p, v in past if 0.5 * said["estimate"] <= p <= 2 * said["estimate"])
    assert shape["tier"] == (0 if len(ratios) >= 120 else 1) and shape["value_q05"] < shape["value_q50"] < shape["value_q95"] and 0 <= shape["p_at_least_ask"] <= 1
    if shape["tier"] == 0:
        assert shape["p_at_least_ask"] == pytest.approx(sum(r >= 300000 / said["estimate"] for r in ratios) / len(ratios))
    for bad in (["--latitude", "49.5"], ["--longitude", "2.6"], ["--rooms", "16"], ["--commune", "75112"], ["--supported-years", "2024", "2025"], ["--asking-price", "0"], ["--number", "0"]):
        with pytest.raises(SystemExit):
            cli.main([*one, *bad])
    assert ml.timed(fitted, spark.read.parquet(str(tmp_path / "gold")))["model_mb"] > 0
    for bad in (["build", "--data", "x", "--output", "y", "--availability-lag-days", "0"], ["value", "--gold", "g", "--longitude", "2", "--latitude", "48", "--surface", "5", "--date", "2025-01-01"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_benchmark_command(spark, tmp_path, monkeypatch, capsys):
    import propval.session

    monkeypatch.setattr(propval.session, "build_session", lambda *a, **k: spark)
    head = ",".join([*readers.TEXT_COLUMNS, *readers.NUMBER_COLUMNS])
    lines = [head] + [
        f"m{i:03d},202{1 + i // 30}-{1 + i % 12:02d}-{1 + i % 28:02d},Vente,bis,RUE,0012,75011,75111,P{i % 3},2,{(40 + i % 25) * (9000 + i * 10)},{i % 4 + 1},{40 + i % 25},{2 + i % 2},1,,{2.37 + (i % 7) * 0.0005},{48.85 + (i % 5) * 0.0005}"
        for i in range(90)
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    gold.gold(readers.transactions(spark, [str(tmp_path / "a.csv")])).write.parquet(str(tmp_path / "gold"))
    cli.main(["benchmark", "--features", str(tmp_path / "gold"), "--output-dir", str(tmp_path / "out"), "--train-end-year", "2021", "--validation-year", "2022", "--test-year", "2023", "--families", "ridge", "--sets", "base", "comparables", "--bootstrap-repetitions", "20", "--minimum-rows", "20"])
    said = json.loads(capsys.readouterr().out)
    models = ["ridge_base", "ridge_comparables"]
    assert sum(said["combined"]["blend"][f"prediction_{m}"] for m in models) == pytest.approx(1.0)
    least = {m: min(t["mae"] for t in said["trials"] if t["features"] == m.removeprefix("ridge_")) for m in models}
    assert said["combined"]["blend"]["validation_mae"] <= min(least.values()) + 0.01
    fix = said["combined"]["correction"]
    assert fix["base"] == f"prediction_{min(models, key=least.get)}" and fix["validation_mae"] <= min(least.values()) + 0.01
    rows = spark.read.parquet(str(tmp_path / "out/predictions")).join(spark.read.parquet(str(tmp_path / "gold")).select("id_mutation", F.col(fix["anchor"]).alias("per"), "surface_reelle_bati"), "id_mutation").collect()
    assert len(rows) == 30
    for r in rows:
        assert r.prediction_blend == pytest.approx(sum(said["combined"]["blend"][f"prediction_{m}"] * r[f"prediction_{m}"] for m in models))
        assert r.prediction_corrected == pytest.approx(r[fix["base"]] if r.per is None else fix["weight"] * r[fix["base"]] + (1 - fix["weight"]) * r.per * r.surface_reelle_bati)
    assert {"blend", "corrected", *models} == set(said["metrics"]) == {i["model"] for i in said["intervals"]}
