"""Readers, publishing and acquisition."""

from __future__ import annotations

import gzip
import io
import json
import urllib.error
import zipfile

import pytest

from propval.operators.contracts import ContractError
from propval.sources import acquire, publish, readers


def test_transactions_and_overlap(spark, tmp_path):
    head = ",".join([*readers.TEXT_COLUMNS, *readers.NUMBER_COLUMNS])
    row = lambda i: ",".join([i, "2021-01-01", "Vente", "", "X", "0012", "75001", "75101", "P", "2", "1e5", "", "40", "2", "1", "oops", "2.3", "48.8"])
    a, b = tmp_path / "2021.csv", tmp_path / "2022.csv.gz"
    a.write_text(f"{head}\n{row('m1')}\n")
    b.write_bytes(gzip.compress(f"{head}\n{row('m2')}\n".encode()))
    got = sorted(readers.transactions(spark, [str(a), str(b)]).collect(), key=lambda r: r.id_mutation)
    assert [r.source_file for r in got] == ["2021.csv", "2022.csv.gz"] and got[0].adresse_code_voie == "0012" and got[0].surface_terrain is None and got[0].valeur_fonciere == 1e5
    b.write_bytes(gzip.compress(f"{head}\n{row('m1')}\n".encode()))
    with pytest.raises(ContractError):
        readers.transactions(spark, [str(a), str(b)])
    with pytest.raises(FileNotFoundError):
        readers.transactions(spark, [str(tmp_path / "none.csv")])


def test_zip_member_and_points(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("csv/buildings.csv", "id,geo_point_2d\n1,\"48.878673, 2.302806\"\n")
    df = readers.zipped_csv(spark, str(z), "buildings", ["id"], str(tmp_path / "bronze"))
    assert [r.id for r in df.collect()] == ["1"] and not list((tmp_path / "bronze").glob("*.part"))
    p = readers.context_points(spark, str(tmp_path / "bronze" / "buildings.csv"), sep=",").first()
    assert round(p.x, 1) == 648866.6
    with pytest.raises(FileNotFoundError):
        readers.unzipped(str(z), "none.csv", str(tmp_path))


def test_noise_polygons(spark, tmp_path):
    ring = lambda pos: f"<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{pos}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>"
    zone = lambda legend, *rings: f"<wfs:member><ms:zone>{legend}<ms:msGeometry><gml:MultiSurface>{''.join(rings)}</gml:MultiSurface></ms:msGeometry></ms:zone></wfs:member>"
    text = zone("<ms:legende>Lden 65-70 dB</ms:legende>", ring("0 0 1 0 1 1"), ring("0 0 1 1")) + zone("", ring("0 0 1 0 1 1"))
    f = tmp_path / "n.gml"
    f.write_text(f'<wfs:FeatureCollection xmlns:wfs="w" xmlns:ms="m" xmlns:gml="g">{text}</wfs:FeatureCollection>')
    got = readers.noise_polygons(spark, str(f)).collect()
    assert [(r.level, [(p.x, p.y) for p in r.ring]) for r in got] == [(65, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]


def test_atomic_writers(spark, tmp_path):
    f = tmp_path / "x" / "r.json"
    publish.write_json(f, {"é": 1})
    assert json.loads(f.read_text(encoding="utf-8")) == {"é": 1} and "é" in f.read_text(encoding="utf-8")
    with pytest.raises(TypeError):
        publish.write_json(f, {"a": object()})

    with pytest.raises(RuntimeError), publish.staged(f) as part:
        part.write_text("half")
        raise RuntimeError
    assert json.loads(f.read_text(encoding="utf-8")) == {"é": 1} and [p.name for p in f.parent.iterdir()] == [f.name]
    publish.write_csv(tmp_path / "t.csv", [{"a": 1, "b": "x"}], ["a", "b"])
    assert (tmp_path / "t.csv").read_text().splitlines() == ["a,b", "1,x"]


def test_files_of_any_file_system(spark, tmp_path):
    source, target = tmp_path / "a", publish.Place(tmp_path / "b")
    source.write_text("one")
    target.spark = spark  # as if it were not this machine's
    target.take(source)
    source.write_text("two")
    target.take(source)
    with target.local() as f:
        assert f.read_text() == "two" and f != tmp_path / "b"
    assert target.exists() and not [p for p in tmp_path.iterdir() if ".part" in p.name and not p.name.endswith(".crc")]


def test_publish_table_replaces_and_keeps_on_failure(spark, tmp_path):
    path = str(tmp_path / "gold")
    publish.publish_table(spark.range(3), path)
    publish.publish_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and readers.schema_columns(spark, path) == ["id"]
    with pytest.raises(Exception):
        publish.publish_table(spark.range(5).selectExpr("raise_error('no') AS id"), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["gold"]


class Web:
    def __init__(self, pages):
        self.pages, self.calls = pages, []

    def __call__(self, url):
        self.calls.append(url)
        page = self.pages[url]
        page = page.pop(0) if isinstance(page, list) else page
        if isinstance(page, int):
            raise urllib.error.HTTPError(url, page, "", {}, None)
        return io.BytesIO(page)


def test_download(tmp_path):
    f, web = tmp_path / "a", Web({"u": [503, b"data", b"", b"other"]})
    assert acquire.download("u", f, opener=web, sleep=lambda s: None) is False and f.read_bytes() == b"data"
    assert acquire.download("u", f, opener=web) is True
    for _ in range(2):
        with pytest.raises(RuntimeError):
            acquire.download("u", f, force=True, expected="0" * 64, opener=web)
    assert f.read_bytes() == b"data" and [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(urllib.error.HTTPError):
        acquire.download("v", tmp_path / "b", opener=Web({"v": 404}))
    rec = acquire.manifest_record("s", "p", "l", "u", f, tmp_path, rows=3)
    assert rec["path"] == "a" and rec["bytes"] == 4 and rec["sha256"] == publish.sha256(f) and rec["rows"] == 3


def test_paginated(tmp_path):
    page = lambda total, rows, nxt=None: json.dumps({"total": total, "results": rows, "next": nxt}).encode()
    web = Web({"k1": page(2, [{"_score": 1, "identifiant_ban": "a"}], "k1b"), "k1b": page(2, [{"identifiant_ban": "b"}]), "k2": page(1, [{"identifiant_ban": "a"}]), "k3": page(2, [{}])})
    f = tmp_path / "d.jsonl.gz"
    assert acquire.paginated(str, ["k1", "k2"], f, wanted={"a"}, opener=web) == {"rows": 2, "api_total": 3, "cache_hit": False}
    assert [json.loads(x) for x in gzip.open(f, "rt")] == [{"identifiant_ban": "a"}] * 2
    assert acquire.paginated(str, ["k1"], f)["cache_hit"] is True
    with pytest.raises(RuntimeError):
        acquire.paginated(str, ["k3"], f, force=True, opener=web)


def test_predictions_and_reports(spark, tmp_path):
    publish.write_csv(tmp_path / "p.csv", [{"id": "a", "day": "2024-05-01", "value": "1.5", "more": "x"}, {"id": "b", "day": "no", "value": "?", "more": ""}], ["id", "day", "value", "more"])
    got = readers.predictions(spark, str(tmp_path / "p.csv"), {"id": "string", "day": "date", "value": "double"}).orderBy("id").collect()
    assert [(r.id, str(r.day), r.value) for r in got] == [("a", "2024-05-01", 1.5), ("b", "None", None)]
    publish.write_json(tmp_path / "r.json", {"n": 1})
    assert readers.json_report(str(tmp_path / "r.json")) == {"n": 1}
