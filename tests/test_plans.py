import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from terrier import schema as S
from terrier.functions import columns as C
from terrier.plans import cli, process
from terrier.plans.maps import with_display
from terrier.sources import deeds

HEADER = [c.strip().split()[0] for c in S.DEED_LINE.replace("\n", " ").split(",")]


def line(mutation, disposition, value, parcel, kind, surface, use="sols", special=None, rooms=3,
         day="2024-03-01", nature="Vente", commune="75101", lon="2.3376", lat="48.8606", dept="75"):
    cells = {"id_mutation": mutation, "numero_disposition": disposition, "valeur_fonciere": value,
             "id_parcelle": parcel, "type_local": kind, "surface_reelle_bati": surface,
             "nature_culture": use, "nature_culture_speciale": special,
             "nombre_pieces_principales": rooms, "date_mutation": day, "nature_mutation": nature,
             "code_commune": commune, "nom_commune": f"C{commune}", "code_departement": dept,
             "longitude": lon, "latitude": lat, "adresse_nom_voie": 'RUE "A", B'}
    return cells


def write_csv(path: Path, lines):
    import csv
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, HEADER)
        w.writeheader()
        w.writerows(lines)


def deed_case():
    """A sale of a flat; a farm sold with a field and three land uses of its yard; a flat of unknown use."""
    out = [line("K7", 1, 96400, "q8", "Appartement", 41),
           line("K7", 4, 228900, "q5", None, None, use="prés")]
    for use in ("sols", "vergers", "landes"):
        out += [line("K7", 4, 228900, "q6", "Dépendance", 18, use, rooms=0),
                line("K7", 4, 228900, "q6", "Maison", 94, use, rooms=4),
                line("K7", 4, 228900, "q6", "Appartement", 46, use, rooms=2)]
    return out + [line("L2", 1, 131700, "q9", "Appartement", 37, "NA", rooms="null")]


@pytest.fixture(scope="module")
def deed_lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("deeds") / "deeds.csv"
    write_csv(path, deed_case())
    return deeds.scan_deeds(spark, str(path))


def test_scan_maps_null_tokens_and_keeps_bad_rows(spark, tmp_path):
    write_csv(tmp_path / "d.csv", [line("A", "x", "bad", "007", "NA", "12.5", use="null")])
    r = deeds.scan_deeds(spark, str(tmp_path / "d.csv")).first()
    assert (r.numero_disposition, r.valeur_fonciere, r.type_local, r.nature_culture) == (None,) * 4
    assert (r.id_parcelle, r.surface_reelle_bati, r.adresse_nom_voie) == ("007", 12.5, 'RUE "A", B')
    assert r.date_mutation.isoformat() == "2024-03-01" and r.seq.file.endswith("/d.csv")
    write_csv(tmp_path / "e.csv", [line("A", 1, 1, "p", "Maison", 1, day="01/02/2024")])
    assert deeds.scan_deeds(spark, str(tmp_path / "e.csv"), strict_dates=False).first() \
        .date_mutation is None
    with pytest.raises(Exception, match="(?i)parse"):
        deeds.scan_deeds(spark, str(tmp_path / "e.csv")).collect()


@pytest.mark.parametrize("light_rows", [1_000_000, 5, 0])
def test_deed_reduction(spark, deed_lines, light_rows):
    filled = C.fill_unknown(deed_lines, S.LAND_USE)
    kept = process.clean_lines(filled, "light")
    assert kept.count() == 4
    items = process.deed_items(deed_lines, light_rows)
    out = process.sales_of(items)
    got = {(r.id_mutation, r.numero_disposition): r for r in out.collect()}
    assert len(got) == 3 and out.count() == 3
    farm = got["K7", 4]
    assert (farm.surface_batie_totale, farm.valeur_fonciere) == (140.0, 228900.0)
    assert farm.has_dependency is True and got["K7", 1].has_dependency is False
    assert farm.type_local == "Maison" and farm.nombre_pieces_principales == 6
    assert farm.id_parcelle_unique == "q6" and got["L2", 1].nombre_pieces_principales == 0
    assert set(out.columns) == {*S.DISPOSITION, *S.FIRSTS, "id_parcelle_unique", *S.SUMS}
    listed = process.lists_of(items)
    assert set(listed.columns) == {*S.DISPOSITION, "position", *S.LISTS}
    places = sorted(tuple(r) for r in listed.where("numero_disposition = 4").select(
        "position", "surface_reelle_bati", "id_parcelle").collect())
    assert places == [(0, 94.0, "q6"), (1, 46.0, "q6")]
    assert listed.where("numero_disposition = 4").agg(F.sum("prix_de_vente")).first()[0] == pytest.approx(228900.0)
    assert listed.where("id_mutation = 'L2'").first().nature_culture == "unknown"


def test_ordinary_deeds_shuffle_once(spark, deed_lines):
    plan = process.reduce_deeds(deed_lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "lot1_numero" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("light_rows", [1_000_000, 2])
def test_lines_are_not_written_and_no_sale_depends_on_other_natures(spark, monkeypatch, tmp_path, light_rows):
    sale = [line("A", 1, 210000, "p1", "Maison", 80, "sols"), line("A", 1, 210000, "p1", "Dépendance", None, "sols"),
            line("A", 1, 210000, "p1", None, None, "sols"), line("A", 1, 210000, "p1", "Maison", 70, "prés"),
            line("B", 1, 120000, "p2", "Appartement", 30, "sols"), line("B", 1, 120000, "p2", "Local", 30, "sols")]
    other = [line(m, 1, 99000, p, kind, 10, "landes", nature=nature) for m, p in (("A", "p1"), ("B", "p2"))
             for nature in ("Echange", None) for kind in ("Dépendance", "Maison", None)]
    write_csv(tmp_path / "d.csv", other + sale)
    written, lines = [], deeds.scan_deeds(spark, str(tmp_path / "d.csv"))
    if light_rows > 2:
        monkeypatch.setattr(process, "staged", lambda df: written.append(df.columns) or df)
    items = process.read_items(lines, light_rows)
    got = {(r.id_mutation, r.position): (r.surface_reelle_bati, r.has_dependency, r.surface_batie_totale, r.prix_de_vente)
           for r in items.collect()}
    assert got == {("A", 0): (80.0, True, 80.0, 210000.0), ("B", 0): (30.0, False, 30.0, 120000.0)}
    assert light_rows == 2 or (len(written) == 1 and "position" in written[0])


def layer_file(path: Path, feats):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = ",\n".join(json.dumps({"type": "Feature", "properties": p, "geometry": {
        "type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}})
        for p, (x0, y0, x1, y1) in feats)
    path.write_text('{"type": "FeatureCollection", "features": [\n' + lines + "\n]}\n")


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    base = tmp_path_factory.mktemp("landed")
    lines = deed_case()
    for i in range(60):
        year = 2023 + i % 3
        lines.append(line(f"M{i}", 1, 200000 + 1000 * (i % 20), f"75101000{i % 7}",
                          "Maison" if i % 3 else "Appartement", 60 + i % 5, rooms=3 + i % 3,
                          day=f"{year}-05-01", lon=f"{2.33 + i / 5000:.4f}"))
        lines.append(line(f"N{i}", 1, 150000 + 900 * (i % 11), f"690010000{i % 5}", "Maison",
                          80 + i % 9, rooms=4 + i % 2, day=f"{year}-06-01", commune="69001",
                          lon="4.83", lat="45.76", dept="69"))
    lines.append(line("Z", 1, 99_000_000, "zz", "Maison", 90))       # far outside the bounds
    write_csv(base / "deeds" / "deeds.csv", lines)
    (base / "departments.csv").write_text("DEP,REG,OTHER\n75,11,a\n69,84,b\n01,84,c\n")
    (base / "regions.csv").write_text("REG,LIBELLE\n11,Île-de-France\n84,Auvergne-Rhône-Alpes\n")
    (base / "zone_names.csv").write_text("CODE_IRIS,LIB_IRIS\n751010101,Palais\n")
    layers = base / "layers"
    layer_file(layers / "region.geojson", [({"code_insee": "11", "nom_officiel": "IDF"}, (2, 48, 3, 49)),
                                           ({"code_insee": "84", "nom_officiel": "ARA"}, (2, 47, 3, 48))])
    layer_file(layers / "departement.geojson", [
        ({"code_insee": d, "code_insee_de_la_region": r, "nom_officiel": d}, (2, 48, 3, 49))
        for d, r in (("75", "11"), ("69", "84"), ("01", "84"))])
    layer_file(layers / "commune.geojson", [
        ({"code_insee": c, "code_insee_du_departement": c[:2], "nom_officiel": c}, (2, 48, 3, 49))
        for c in ("75056", "69001", "01001")])
    layer_file(layers / "arrondissement_municipal.geojson", [
        ({"code_insee": "75101", "nom_officiel": "Paris 1"}, (2.3, 48.8, 2.4, 48.9))])
    layer_file(layers / "iris.geojson", [
        ({"code_iris": "751010101", "nom_iris": None, "code_insee": "75101", "nom_commune": "P"},
         (2.32, 48.85, 2.335, 48.87)),
        ({"code_iris": "751010102", "nom_iris": "Z2", "code_insee": "75101", "nom_commune": "P"},
         (2.335, 48.85, 2.36, 48.87))])
    for dept, commune, ids in (("75", "75101", [f"75101000{i}" for i in range(9)]),
                               ("69", "69001", ["none"])):
        folder = base / "cadastre" / dept / commune
        folder.mkdir(parents=True)
        feats = [{"type": "Feature", "properties": {"id": i}, "geometry": {
            "type": "Polygon", "coordinates": [[[2, 48], [2.001, 48], [2.001, 48.001], [2, 48]]]}}
            for i in ids]
        with gzip.open(folder / f"cadastre-{commune}-parcelles.json.gz", "wt") as f:
            json.dump({"type": "FeatureCollection", "features": feats}, f)
    return base


def collections(folder):
    return [json.loads(p.read_text()) for p in sorted(Path(folder).glob("part-*"))]


def test_all_steps(spark, landed, tmp_path):
    out = str(tmp_path)
    args = cli.parser().parse_args(["--input", str(landed), "--output", out, "--all"])
    assert cli.run(spark, args) == list(cli.STEPS)

    sales = spark.read.parquet(f"{out}/processed").cache()
    assert sales.where("id_mutation = 'Z'").count() == 0
    assert sales.select("cle_principale").distinct().count() == sales.count()
    lists = spark.read.parquet(f"{out}/processed_lists")
    assert lists.select("id_mutation", "numero_disposition").distinct().count() == sales.count()
    assert lists.where("id_mutation = 'Z'").count() == 0
    assert rows(sales.groupBy("code_region", "nom_region").count().drop("count")) == [
        ("11", "Île-de-France"), ("84", "Auvergne-Rhône-Alpes")]
    zones = dict(rows(sales.groupBy("code_iris").count()))
    assert set(zones) == {"751010101", "751010102", None}
    assert sales.where("code_commune = '69001' and code_iris is not null").count() == 0
    year = sales.where("annee_mutation = 2025").select(F.max(F.abs(F.col("prix_m2_ajuste") - F.col("prix_m2"))))
    assert year.first()[0] < 1e-9

    for level in S.LEVELS:
        for span in S.SPANS:
            stats = deeds.load_aggregate(spark, f"{out}/aggregates", level, span)
            picked = deeds.scan_processed(spark, f"{out}/processed", S.SPANS[span])
            if level == "iris":
                picked = picked.where("code_iris is not null")
            assert stats.agg(F.sum("nb_transactions")).first()[0] == picked.count(), (level, span)
    summary = spark.read.parquet(f"{out}/reports/summary").first()
    want = sales.agg(F.count(F.lit(1)), F.min("date_mutation"), F.max("prix_m2_ajuste"), F.median("prix_m2")).first()
    assert (summary.n_rows, summary.date_min, summary.prix_m2_ajuste_max, summary.prix_m2_median) == tuple(want)
    assert summary.prix_m2_mean == pytest.approx(sales.agg(F.avg("prix_m2")).first()[0])
    assert (summary.missing_regions, summary.missing_zones) == (0, zones[None])
    assert spark.read.parquet(f"{out}/reports/communes_by_price").count() <= 10
    assert spark.read.parquet(f"{out}/reports/departments_by_sales").count() == 2

    cities = json.loads(collections_text(f"{out}/aggregates/top_cities"))
    assert {c["name"] for c in cities} == {"C69001", "Paris"}
    assert next(c for c in cities if c["name"] == "C69001")["prix_m2_appart_median"] is None

    (country,) = collections(f"{out}/map/country")
    (feature,) = country["features"]
    assert feature["properties"]["country"] == "France"
    assert feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"][0]) >= 5
    (departments,) = collections(f"{out}/map/departments")
    assert {f["properties"]["code_departement"] for f in departments["features"]} == {"75", "69"}
    communes = [f["properties"] for c in collections(f"{out}/map/communes") for f in c["features"]]
    assert {p["code_commune"]: p["nb_transactions"] > 0 for p in communes} == {
        "75101": True, "69001": True, "01001": False}
    iris = {f["properties"]["code_iris"]: f["properties"]["nom_iris"]
            for c in collections(f"{out}/map/iris") for f in c["features"]}
    assert iris == {"751010101": "Palais", "751010102": "Z2"}
    parcels = [f for c in collections(f"{out}/map/parcels/commune=75101") for f in c["features"]]
    assert {p["properties"]["id_parcelle_unique"] for p in parcels} == {f"75101000{i}" for i in range(7)}
    tiles = spark.read.parquet(f"{out}/tiles/communes")
    assert {r.z for r in tiles.select("z").distinct().collect()} == set(range(9, 15))


def collections_text(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_display(spark):
    df = spark.createDataFrame([(None, None), (4, 1500.0), (5, 4750.0), (9, 99999.0)],
                               "nb_transactions int, prix_m2_median double")
    assert [(r.display, r.shade) for r in with_display(df).collect()] == [
        ("none", None), ("few", 0.0), ("scaled", 0.5), ("scaled", 1.0)]
    assert [r.display for r in with_display(df, parcels=True).collect()] == [
        "none", "scaled", "scaled", "scaled"]
