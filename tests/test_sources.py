"""Reading and writing tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterflow.operators.resample import make_jobs
from meterflow.operators.splits import disjoint_split
from meterflow.schema import HOUSEHOLD, TRIALS
from meterflow.sources import readers, results, splits


@pytest.fixture
def meter(tmp_path):
    folder = tmp_path / "meter"
    folder.mkdir()
    header = "timestamp,P,Q,V,I\n"
    (folder / "b.csv").write_text(header + "2016-01-01 00:01:00,3,3,3,3\nnever,1,1,1,1\n")
    (folder / "a.csv").write_text(header + "2016-01-01 00:00:00,1,1,1,1\n2016-01-01 00:00:30,2,2,2,\n")
    (folder / "notes.txt").write_text("not a table")
    return folder


def test_folder_of_csv_files(spark, meter):
    rows = readers.read_household(spark, str(meter)).orderBy("timestamp").collect()
    assert [(r.timestamp, r.P) for r in rows] == [
        (datetime(2016, 1, 1, 0, 0), 1.0), (datetime(2016, 1, 1, 0, 0, 30), 2.0),
        (datetime(2016, 1, 1, 0, 1), 3.0)]
    assert readers.read_resampled(spark, str(meter)).columns == ["timestamp", "P", "Q", "V"]


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv_folder(spark, str(tmp_path / "none"), HOUSEHOLD)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_csv_folder(spark, str(tmp_path / "empty"), HOUSEHOLD)


def test_star(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,5\n1,2,2016-01-01 00:00:00,6\n")
    (tmp_path / "building_metadata.csv").write_text(
        "site_id,building_id,primary_use,square_feet,year_built,floor_count\n0,1,Office,10,,\n")
    (tmp_path / "weather_train.csv").write_text(
        "site_id,timestamp,air_temperature,cloud_coverage,dew_temperature,precip_depth_1_hr,"
        "sea_level_pressure,wind_direction,wind_speed\n0,2016-01-01 00:00:00,1,,,,,,\n")
    tables = readers.read_star(spark, str(tmp_path))
    assert tables["readings"].first().meter_reading == 5.0 and tables["readings"].count() == 1
    assert tables["buildings"].first().year_built is None
    assert tables["weather"].first().air_temperature == 1.0


def test_exports_have_paths_of_their_own(spark, meter, tmp_path):
    df = readers.read_household(spark, str(meter)).withColumn("event_id", F.col("P").cast("long"))
    paths = results.export_resampled(
        df, make_jobs(["1s", "1T"], include_max=True), ["P"], str(tmp_path / "out"), raw=True, first=2)
    assert len(set(paths)) == 6
    counts = [spark.read.csv(p, header=True).count() for p in paths]
    assert counts == [3, 2, 3, 3, 2, 2]


def test_split_files(spark, tmp_path):
    ids = spark.range(25).selectExpr("id AS building_id", "elt(id % 3 + 1, 'train', 'val', 'test') AS split")
    path = str(tmp_path / "splits")
    splits.write_splits(ids, path)
    assert sorted(map(tuple, splits.read_splits(spark, path).collect())) == sorted(map(tuple, ids.collect()))
    single = tmp_path / "one.json"
    single.write_text('{"train": [1, 2],\n "val": [3],\n "test": []}')
    assert sorted(map(tuple, splits.read_splits(spark, str(single)).collect())) == [
        (1, "train"), (2, "train"), (3, "val")]
    fresh = str(tmp_path / "fresh")
    assert splits.saved_or_new(spark, fresh, lambda: ids).count() == 25
    assert splits.saved_or_new(spark, fresh, lambda: pytest.fail("built twice")).count() == 25


def test_persisted_split_is_used_for_its_own_inputs_only(spark, tmp_path):
    folder, told = str(tmp_path / "kept"), []
    counts = spark.range(30).selectExpr("id AS building_id", "id % 7 + 1 AS n").repartition(3)

    def split(table, **parameters):
        return sorted(map(tuple, splits.persisted_split(table, folder, log=told.append, **parameters).collect()))

    direct = sorted(map(tuple, disjoint_split(counts).select("building_id", "split").collect()))
    assert split(counts) == direct and split(counts.repartition(7).sort("n")) == direct
    assert told == ["built", "loaded"]
    changed = counts.withColumn("n", F.when(F.col("building_id") == 3, 50).otherwise(F.col("n")).cast("long"))
    assert split(changed) == sorted(map(tuple, disjoint_split(changed).select("building_id", "split").collect()))
    assert len(split(counts, limits={"train": 2})) < len(direct)
    assert told[2:] == ["built", "built"]
    # a folder without the mark of a finished write is no split
    place = next(p for p in (tmp_path / "kept").iterdir() if p.name == f"split-{splits.fingerprint(counts, 'building_id', {})}")
    (place / "_SUCCESS").unlink()
    next(place.glob("part-*")).write_text('{"train": [999]}')
    assert split(counts) == direct and told[4:] == ["built"]
    assert split(counts) == direct and told[5:] == ["loaded"]
    assert not [p for p in (tmp_path / "kept").iterdir() if p.name.startswith(".split")]


def test_results_store(spark, tmp_path):
    store = results.ResultsStore(spark, str(tmp_path / "results"))
    first = spark.createDataFrame([(1.0,)], "RMSE double")
    second = spark.createDataFrame([(2.0, 3.0)], "RMSE double, R2 double")
    points = spark.createDataFrame([(1, 5.0, -1.0), (2, 6.0, 6.5)], "row_id long, y_true double, y_pred double")
    store.save_run(first, points, "A", "a", info={"seq": 7, "layers": 1})
    store.save_run(second, points.where("row_id = 2"), "B", "b", info={"seq": 9})
    store.save_metrics(second, "A")
    assert sorted((r.RMSE, r.R2) for r in store.read("metrics").collect() if r.R2) == [(2.0, 3.0)] * 2
    assert store.read("metrics").count() == 3
    assert sorted((r.row_id, r.y_pred) for r in store.predictions(["A"]).collect()) == [(1, 0.0), (2, 6.5)]
    assert store.predictions().count() == 3
    assert dict(map(tuple, store.info().collect())) == {"seq": "9", "layers": "1"}
    store.append_fixed(first, "log")
    with pytest.raises(ValueError):
        store.append_fixed(second, "log")


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 9), ("b", 2, 9)], "key string, value int, kept int")
    new = spark.createDataFrame([("b", None), ("c", 4)], "key string, value int")
    found = sorted(map(tuple, results.upserted(old, new, ["key"]).collect()))
    assert found == [("a", 9, 1), ("b", 9, None), ("c", None, 4)]


def test_labelled_files_with_different_columns(spark, tmp_path):
    for name, text in (("run_Mod_A.csv", "RMSE,R2\n1,2\n"), ("run_A.csv", "RMSE\n3\n"), ("x.csv", "")):
        (tmp_path / name).write_text(text)
    out = results.read_labelled(spark, str(tmp_path), [("A", "plain"), ("Mod_A", "modified")])
    assert sorted((r.Model, r.RMSE, r.R2) for r in out.collect()) == [
        ("modified", "1", "2"), ("plain", "3", None)]


def test_trial_logs(spark, tmp_path):
    names = [f.name for f in TRIALS if f.name != "algorithm"]
    line = ",".join("2020-01-01 00:00:00" if n == "timestamp" else "7" for n in names)
    (tmp_path / "search_iterations_Mod_A.csv").write_text(",".join(names) + "\n" + line + "\n")
    (tmp_path / "search_iterations_A.csv").write_text(",".join(names) + "\n" + line + "\n" + line + "\n")
    (tmp_path / "search_iterations_B.csv").write_text("")
    (tmp_path / "metrics.csv").write_text("RMSE\n1\n")
    out = results.read_trials(spark, str(tmp_path), [("A", "plain"), ("Mod_A", "modified")])
    assert sorted((r.algorithm, r.eval_num) for r in out.collect()) == [
        ("modified", 7), ("plain", 7), ("plain", 7)]
