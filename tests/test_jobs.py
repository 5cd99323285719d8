"""The image-side job on hand-made sources, and the recipe of generated features."""

from pyspark.sql import functions as F

from strandline.operators import features
from strandline.operators.track import TrackRules
from strandline.plans.jobs import ImageSpec, analyse_sources
from strandline.sequence import Sequence

FOUND = "source_name string, frame long, width double, blobs array<struct<x:double,y:double>>"
RULES = TrackRules(radius=10.0, max_missed=1, min_hits=2, min_displacement=3.0, min_vertical=1.0, initial_variance=0.25)


def images(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_image_job(spark, tmp_path):
    paths = [f"/in/Backlit/s1/frame_{k}.png" for k in (1, 2, 3, 7, 8)] + [f"/in/x/s2/frame_{k}.png" for k in (1, 2)]
    shown = [("s1", k, 1.0, [(5.0, 4.0 * i), (None, 1.0)]) for i, k in enumerate((1, 2, 3, 7))]
    rows = [*shown, shown[0], ("s1", 99, 1.0, [(0.0, 0.0)]), ("s2", 1, None, None), ("s2", 2, None, [])]
    run = analyse_sources(images(spark, *paths, paths[0]), spark.createDataFrame(rows, FOUND), ImageSpec(("width",), "blobs", tracks=RULES), f"{tmp_path}/a")
    # images 3 and 7 follow each other: the track goes on; frame 99 has no image, 8 no detection
    tracked = [tuple(r) for r in run.tables["tracks"].orderBy("frame").select("source_name", "frame", "x", "y", "track_id").collect()]
    assert tracked == [("s1", 2, 5, 4, 0), ("s1", 3, 5, 8, 0), ("s1", 7, 5, 12, 0)]
    (path,) = run.tables["trajectories"].collect()
    assert (path["n_points"], path["total_displacement"], path["vertical_displacement"]) == (3, 8.0, 8.0)
    assert sorted(r["speed"] for r in run.tables["speeds"].collect()) == [1.0, 4.0]
    flags = {(r["source_name"], r["frame"]): (r["anomaly"], r["anomaly_reasons"]) for r in run.tables["anomalies"].collect()}
    assert len(flags) == 7 and flags["s1", 8] == (1, ["missing:width"]) and flags["s1", 7] == (0, [])
    assert flags["s2", 1] == flags["s2", 2] == (0, [])  # a value that a whole source lacks is no anomaly there
    found = {r["source_name"]: (r["mode"], r["flagged"], r["total"], r["recheck"], r["points"], r["tracks"]) for r in run.tables["sources"].collect()}
    assert found == {"s1": ("backlit", 1, 5, True, 3, 1), "s2": ("laserlit", 0, 2, False, 0, 0)}


def test_image_job_keeps_a_range(spark, tmp_path):
    paths = [f"/in/s/frame_{k}.png" for k in range(6)]
    found = spark.createDataFrame([("s", k, 1.0, []) for k in range(6)], FOUND)
    run = analyse_sources(images(spark, *paths), found, ImageSpec(("width",), "blobs", start=2, end=4), f"{tmp_path}/b")
    assert sorted(r["frame"] for r in run.tables["anomalies"].collect()) == [2, 3, 4]


def test_image_job_without_images(spark, tmp_path):
    run = analyse_sources(images(spark), spark.createDataFrame([], FOUND), ImageSpec(("width",), "blobs"), f"{tmp_path}/c")
    assert {n: t.count() for n, t in run.tables.items()} == dict.fromkeys(run.tables, 0) and "sources" in run.tables


def test_recipe_reach_is_enough_for_chained_windows(spark):
    """Windows over windows: rows in segments give what whole sequences give."""
    rows = [(1, i, float((i * 7) % 11), float((i * 3) % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, u double, v double")
    recipe = lambda: features.Recipe().rolls(["u"], [4], ("mean",)).then().rolls(["u_roll_4_mean"], [5], ("max",)).steps(["v"], "{c}_step").then().lags(["v_step"], [0, 3])
    made = recipe()
    assert made.names == ["u_roll_4_mean", "u_roll_4_mean_roll_5_max", "v_step", "v_step_lag_0", "v_step_lag_3"] and made.reach == [4, 5, 3]
    whole = Sequence(("g",), ("i",), axis="i")
    split = Sequence(("g",), ("i",), "floor(i / 7)", axis="i", segment_rows=4)
    shown = lambda seq: recipe().over(df, seq).select("i", *[F.round(c, 9).alias(c) for c in made.names]).orderBy("i").collect()
    assert shown(whole) == shown(split)
