from pyspark.sql import functions as F

from tidecover.operators.grid import crop
from tidecover.sources.files import append_missing, read_events, scan_grid, write_grids


def test_event_files_of_two_encodings(spark, tmp_path):
    for year, name, encoding, text in (
        (2019, "Calas anchoveta Primera temporada.csv", "utf-8-sig", "fecha_cala,nave, latitud ,longitud,declarado_tm,nave\n05/04/2019,Ñandú,-8.5,-79.1,10.5,x\nbad,B,n/a,-79,3,y\n"),
        (2020, "calas ANCHOVETA segunda temporada.csv", "latin-1", "fecha_cala,nave,latitud,longitud,declarado_tm,porcentaje_juvenil\n5/11/2020,Peñón,-9,-80,7,12.5\n"),
        (2020, "other.csv", "utf-8", "a,b\n1,2\n"),
    ):
        (tmp_path / str(year)).mkdir(exist_ok=True)
        (tmp_path / str(year) / name).write_bytes(text.encode(encoding))
    rows = {r.nave: r for r in read_events(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"Ñandú", "B", "Peñón"}
    assert str(rows["Ñandú"].fecha_cala) == "2019-04-05" and rows["Ñandú"].season == "1ra 2019" and rows["Ñandú"].porcentaje_juvenil is None
    assert rows["B"].fecha_cala is None and rows["B"].latitud is None
    assert rows["Peñón"].season == "2da 2020" and rows["Peñón"].porcentaje_juvenil == 12.5 and rows["Peñón"].year == 2020


def test_only_missing_partitions_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/grid"
    first = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("year"))
    append_missing(first, path, ["year"])
    append_missing(first.union(spark.range(5).select("id", F.lit(7).alias("year"))), path, ["year"])
    assert {(r.year, r["count"]) for r in spark.read.parquet(path).groupBy("year").count().collect()} == {(0, 5), (1, 5), (7, 5)}


def rows_scanned(df):
    def scans(plan):
        kids = plan.children()
        found = [scans(kids.apply(i)) for i in range(kids.size())]
        own = [plan.metrics().get("numOutputRows").get().value()] if plan.nodeName().startswith("Scan") else []
        return own + [n for f in found for n in f]

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_a_crop_passes_over_other_tiles(spark, tmp_path):
    i = F.col("id")
    cells = spark.range(320_000).select(F.date_add(F.lit("2020-01-01").cast("date"), (i % 80).cast("int")).alias("time"), (F.floor(i / 80) % 64 / 4).alias("lat"), (F.floor(i / 5120) / 4).alias("lon"), (i % 97).cast("double").alias("value"))
    write_grids({"sst": cells.repartition(7)}, f"file://{tmp_path}/grid")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = crop(scan_grid(spark, f"file://{tmp_path}/grid", "sst", (2020, 2020)), 4.0, 5.75, 4.0, 5.75)
        assert len(df.collect()) == crop(cells, 4.0, 5.75, 4.0, 5.75).count() == 64 * 80
        assert rows_scanned(df) < 320_000 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
