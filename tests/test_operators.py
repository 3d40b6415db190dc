"""Hand-made answers, numpy cross-checks, properties, and one test for each decided quirk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import evaluate as E
from voxelframe.operators import intensity as I
from voxelframe.operators import kernels as K
from voxelframe.operators import masks as M
from voxelframe.operators import names as N
from voxelframe.operators import pairing as P
from voxelframe.operators import sampling as A
from voxelframe.operators import slices as L
from voxelframe.operators import spatial as S
from voxelframe.operators import splits as W
from voxelframe.operators import stats as T
from voxelframe.operators import validate as V
from voxelframe.sources import files as X


def voxel_frame(spark, arr, series="s1", name="hu"):
    z, y, x = np.indices(arr.shape)
    return spark.createDataFrame([(series, int(a), int(b), int(c), int(v)) for a, b, c, v in zip(z.ravel(), y.ravel(), x.ravel(), arr.ravel())], f"series_id string, z int, y int, x int, {name} int")


def test_series_and_global_stats_match_numpy(spark):
    r = np.random.default_rng(0)
    arr = r.integers(-4000, 4000, (8, 16, 16))
    other = r.integers(-100, 100, (4, 4, 4))
    v = voxel_frame(spark, arr).unionByName(voxel_frame(spark, other, "s2"))
    stats = T.series_stats(v, ["series_id"], "hu")
    row = stats.where("series_id = 's1'").first()
    assert np.isclose(row["std"], arr.std()) and np.isclose(row["p95"], np.percentile(arr, 95)) and np.isclose(row["median"], np.median(arr))
    assert row["sum_sq"] == float((arr.astype(float) ** 2).sum())  # no int16 overflow
    both = np.concatenate([arr.ravel(), other.ravel()])
    g = T.global_stats(stats).first()
    assert np.isclose(g["mean"], both.mean()) and np.isclose(g["std"], both.std()) and g["min"] == both.min()


def test_splits_are_disjoint_complete_and_stable(spark):
    ids = spark.range(101).withColumnRenamed("id", "k")
    for df in (W.ratio_split(ids, "k"), W.ratio_split(ids, "k", shuffle_seed=3), W.kfold(ids, "k", 7)):
        assert sorted(r["k"] for r in df.collect()) == list(range(101))
    again = W.ratio_split(ids.repartition(13), "k", shuffle_seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, W.ratio_split(ids, "k", shuffle_seed=3).collect()))
    edges = np.linspace(0, 101, 8, dtype=np.uint32)
    folds = {r["k"]: r["fold"] for r in W.kfold(ids, "k", 7).collect()}
    assert all(folds[k] == int(np.searchsorted(edges, k, "right")) for k in range(101))
    with pytest.raises(ValueError):
        W.holdout_split(ids, "k", 1000)


def test_merge_and_split_masks(spark):
    arr = np.random.default_rng(1).integers(0, 5, (4, 4, 4))
    v = voxel_frame(spark, arr, name="label")
    parts = M.split_class_masks(v, [1, 2, 3, 4])
    assert parts.count() == 4 * 64
    sparse = parts.where("value = 1").withColumn("class_name", F.concat(F.lit("c"), F.col("channel") + 1)).withColumn("k", F.col("class_name"))
    cmap = spark.createDataFrame([(f"c{i}", i) for i in range(1, 5)], "class_name string, class_id int")
    back = M.fill_background(M.merge_class_masks(sparse, cmap, "k"), v.select("series_id", "z", "y", "x"))
    assert back.join(v.withColumnRenamed("label", "want"), ["series_id", "z", "y", "x"]).where("label <> want").count() == 0


def test_label_difference_codes_add_up(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 3, (3, 4, 4)), r.integers(0, 3, (3, 4, 4))
    s = {(x["class"], x["code"]): x["n"] for x in S.difference_summary(S.label_difference(voxel_frame(spark, a, name="label"), voxel_frame(spark, b, name="label"))).collect()}
    for c in (1, 2):
        assert s.get((c, 1), 0) + s.get((c, 2), 0) == (a == c).sum() and s.get((c, 1), 0) + s.get((c, 3), 0) == (b == c).sum()


def test_patch_grid_covers_every_voxel(spark):
    shapes = spark.createDataFrame([("s", 9, 7, 5), ("t", 3, 8, 8)], "series_id string, depth int, height int, width int")
    grid = S.patch_grid(shapes, [4, 4, 4], [3, 2, 4]).collect()
    for s, d, h, w in (("s", 9, 7, 5), ("t", 3, 8, 8)):
        seen = np.zeros((d, h, w), bool)
        for g in (g for g in grid if g["series_id"] == s):
            seen[g["z1"] : g["z2"], g["y1"] : g["y2"], g["x1"] : g["x2"]] = True
        assert seen.all()


def test_flip_twice_and_ranges_from_the_top(spark):
    v = voxel_frame(spark, np.arange(24).reshape(4, 3, 2))
    shapes = spark.createDataFrame([("s1", 4, 3, 2)], "series_id string, depth int, height int, width int")
    twice = S.flip(S.flip(v, shapes, "z"), shapes, "z")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, v.collect()))
    ranges = spark.createDataFrame([("s1", 0, 1)], "series_id string, start int, end int")
    assert {r["z"] for r in S.slice_range_filter(v, ranges, "series_id", "z", dense=True).collect()} == {3}
    # a sparse mask: foreground at z = 2, 3 of ten slices, six to seven from the top
    mask = spark.createDataFrame([("s1", 2, 0, 0, 1), ("s1", 3, 0, 0, 1), ("s1", 8, 0, 0, 1)], "series_id string, z int, y int, x int, label int")
    shapes, ranges = spark.createDataFrame([("s1", 10)], "series_id string, depth int"), spark.createDataFrame([("s1", 6, 8)], "series_id string, start int, end int")
    assert {r["z"] for r in S.slice_range_filter(mask, ranges, "series_id", "z", shapes=shapes).collect()} == {2, 3}
    with pytest.raises(ValueError):
        S.slice_range_filter(mask, ranges, "series_id", "z")


def test_names(spark):
    df = spark.createDataFrame([("ct_00--setA--case1--x_0012.png",), ("ct_00--setA--case1--x_0012--0003_0000.png",), ("ct_00--setA--case1.png",), ("zz--setA--case1--x_1.png",), ("ct_00--a--b--x_g.png",), (None,)], "name string")
    got = [(r["type"], r["slice_idx"], r["class_instance"], r["error"]) for r in N.parse_slice_name(df, "name", ["ct_00"]).collect()]
    assert got == [("image", 12, None, None), ("mask", 12, 3, None), (None, None, None, "part count"), (None, None, None, "modality"), (None, None, None, "slice"), (None, None, None, "part count")]
    paths = spark.createDataFrame([("/image/volume-1/volume-7.nii.gz",)], "p string")
    row = N.label_path_from_image(N.series_id_from_path(paths, "p", "volume"), "p", "volume").first()
    assert (row["series_id"], row["label_path"]) == ("7", "/image/volume-1/labels-7.nii.gz")  # the folder stays
    assert N.series_id_from_path(spark.createDataFrame([("/d/gamma.mha",)], "p string"), "p", "stem").first()["series_id"] == "gamma"


def test_pair_status_and_chain(spark):
    img = spark.createDataFrame([(1, "A"), (1, "PV"), (2, "A"), (3, None)], "patient int, phase string")
    lab = spark.createDataFrame([(1, "A"), (2, "A"), (4, "N")], "patient int, phase string")
    got = {(r["patient"], r["phase"]): r["status"] for r in P.pair_status(img, lab).collect()}
    assert got == {(1, "A"): "normal", (1, "PV"): "normal", (2, "A"): "CTEnhanceScanPhaseLost", (3, "N"): "img_only", (4, "N"): "label_only"}


def test_sampling_around_annotated_slices(spark):
    ph = spark.createDataFrame([("p", "A", 10, 9, "normal"), ("q", "A", 10, 4, "img_only")], "patient string, phase string, n_img int, label_index int, status string")
    rows = A.positive_negative_slices(ph, 3, 2, 1, 0).collect()
    assert sorted(r["idx"] for r in rows if r["is_positive"]) == [8, 9]  # past the end is dropped
    assert all(r["idx"] < 8 for r in rows if not r["is_positive"]) and len(rows) == 4
    with pytest.raises(ValueError):
        A.positive_negative_slices(ph, 2, 2, 1, 0)


def test_nearest(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 2.5)], "k string, idx int, y double")
    t = spark.createDataFrame([("a", 1.49), ("a", 1.5), ("a", 9.0)], "k string, t double")
    assert {(r["t"], r["slice_idx"]) for r in S.nearest_within(t, s, ["k"], "t", "y", "idx", 0.5).collect()} == {(1.49, 0)}
    assert {(r["t"], r["slice_idx"]) for r in S.nearest_slice(t, s, ["k"], "t", "y", "idx").collect()} == {(1.49, 0), (1.5, 0), (9.0, 2)}


def test_dicom_order_and_foreground(spark):
    sl = spark.createDataFrame([("s", "u1", "b", 3.0), ("s", "u1", "a", 1.0), ("s", "u2", "c", 0.5), ("t", "u3", "d", None)], "series string, sop string, path string, d double")
    assert [(r["sop"], r["distance"]) for r in L.order_dicom_slices(sl.where("series = 's'"), "series", "sop", F.col("d")).orderBy("position").collect()] == [("u2", 0.5), ("u1", 1.0)]
    assert {r["rejected"] for r in L.order_slices_by_position(sl, "series", "path", "d").where("series = 't'").collect()} == {True}
    one = spark.createDataFrame([("s", z, int(z == 3)) for z in range(6)], "series string, z int, label int")
    r = L.foreground_span(one, "series", "z", "label", 2).first()
    assert (r["first"], r["last"], r["start_min"], r["start_max"]) == (3, 3, 2, 3)


def test_kernels(spark):
    v = np.random.default_rng(3).normal(size=(4, 4, 4))
    vol = spark.createDataFrame([("s", [4, 4, 4], [1.0, 1.0, 1.0], v.ravel().tolist(), [int(x > 0) for x in v.ravel()])], "series_id string, shape array<int>, spacing array<double>, voxels array<double>, labels array<int>")
    r = K.resample_image_linear(vol, [1.0, 1.0, 1.0]).first()
    assert r["shape"] == [3, 3, 3] and np.allclose(np.reshape(r["voxels"], (3, 3, 3)), v[:3, :3, :3])
    grid = spark.createDataFrame([("g", 5, 5, [0.0] * 12 + [1.0] + [0.0] * 12)], "k string, height int, width int, grid array<double>")
    out = np.reshape(K.gaussian_blur(grid, "k", 3, 1.0, 2.0).first()["grid"], (5, 5))
    assert np.isclose(out.sum(), 2.0) and out.argmax() == 12
    crops = K.random_crops(vol, [2, 2, 2], 1.0, 1.0, 0.0, seed=1)
    assert crops.count() == 8 and sorted(map(str, crops.collect())) == sorted(map(str, K.random_crops(vol.repartition(3), [2, 2, 2], 1.0, 1.0, 0.0, seed=1).collect()))
    assert K.two_means(np.array([0.0, 1.0, 10.0, 11.0]), np.ones(4)) == 1.0 and K.two_means(np.array([5.0]), np.ones(1)) is None
    hu = spark.createDataFrame([("s", i, x, 1) for i, x in enumerate([-150, -140, 40, 50])] + [("s", 9, -200, 2)], "series_id string, i int, hu int, label int")
    assert {(x["i"], x["label"]) for x in K.muscle_fat_split(hu).collect()} == {(0, 5), (1, 5), (2, 1), (3, 1), (9, 2)}


def test_large_means_do_not_cancel(spark):
    df = spark.createDataFrame([(k, c, 1e9 * k + x) for k in (1, 2) for c, x in ((1, 0.0), (1, 1.0), (2, 2.0), (2, 3.0))], "series_id int, label int, v double")
    stats = T.series_stats(df, ["series_id"], "v")
    want = np.std([0, 1, 2, 3])
    assert all(np.isclose(r["std"], want, rtol=1e-6) for r in stats.collect())
    assert np.isclose(T.global_stats(stats.where("series_id = 2")).first()["std"], want, rtol=1e-6)
    both = T.global_stats(stats).first()
    assert np.isclose(both["std"], np.std([1e9 * k + x for k in (1, 2) for x in range(4)]))
    assert {round(r["std"], 4) for r in T.class_stats(df, "series_id", "label", "v").where("class <> 'whole'").collect()} == {0.5}


def test_global_ranks(spark):
    from voxelframe.functions.ranks import ranked, ranked_within

    df = spark.range(5000).select(F.when(F.col("id") != 17, F.col("id") * 7 % 5003).alias("k"), (F.col("id") % 3).alias("rank"))
    got = ranked(df.repartition(7), "k").select("row.k", "rank", "n").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, 5001)) and set(got["n"]) == {5000} and np.isnan(got["k"].iat[0]) and got["k"].iloc[1:].is_monotonic_increasing
    within = ranked_within(df, ["rank"], "k").select("row.*", F.col("rank").alias("place"), "n").toPandas()
    for g, part in within.sort_values("place").groupby("rank"):
        assert part["place"].tolist() == list(range(1, len(part) + 1)) and set(part["n"]) == {len(part)}
    assert ranked(df.limit(0), "k").count() == 0


def test_random_crops_keep_their_rules(spark):
    """The rules of a crop, checked on every crop against the volume itself."""
    r = np.random.default_rng(6)
    v, lab = r.normal(size=(6, 6, 6)), (r.random((6, 6, 6)) * 3).astype(int)
    v[:3], lab[3:, 3:] = 0.0, 1
    vol = spark.createDataFrame([("s", [6, 6, 6], v.ravel().tolist(), lab.ravel().tolist())], "series_id string, shape array<int>, voxels array<double>, labels array<int>")
    crops = lambda **o: K.random_crops(vol, [2, 2, 2], 1.0, o.pop("cat_max", 1.0), o.pop("std_min", 0.0), seed=5, **o).collect()
    every = crops()
    assert len(every) == 27
    cat = lambda c: max(np.bincount(c["label"])) / 8
    assert sum(cat(c) > 0.5 for c in crops(cat_max=0.5)) < sum(cat(c) > 0.5 for c in every)
    assert all(np.std(c["img"]) >= 0.3 for c in crops(std_min=0.3, tries=500)) and any(np.std(c["img"]) < 0.3 for c in every)
    assert all(2 in c["label"] for c in crops(ensure=[2])) and not any(2 in c["label"] for c in crops(ensure=[2], invert=True))
    assert len(crops(ensure=[2])) + len(crops(ensure=[2], invert=True)) == 27


def test_metrics_and_empty_tables(spark):
    counts = spark.createDataFrame([(1, 3.0, 0.0), (2, 6.0, 9.0), (3, 13.0, 10.0), (4, 13.1, 10.0)], "patch int, pred double, gt double")
    r = E.count_metrics(counts).first()
    assert r["product_met"] == 0.75
    empty = spark.createDataFrame([], "series_id string, z int, y int, x int, hu int, label int")
    assert T.series_stats(empty, ["series_id"], "hu").count() == 0 and S.split_to_slices(empty).count() == 0 and M.one_hot(empty, "label", 2).count() == 0
    assert I.window_minmax(voxel_frame(spark, np.full((1, 2, 2), 7)), "hu", ["series_id"], 0, 100).select("hu").distinct().first()["hu"] == 0.0
    scores = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.5), ("t", 1, -1.0)], "k string, class int, score double")
    assert {(r["k"], r["label"]) for r in E.argmax_class(scores, ["k"], 0).collect()} == {("s", 1), ("t", 0)}


def test_files(spark, tmp_path):
    (tmp_path / "d" / "s1").mkdir(parents=True)
    (tmp_path / "d" / "s1" / "a.MHA").write_bytes(b"12")
    (tmp_path / "d" / "b.txt").write_bytes(b"1")
    assert [(r["name"], r["parent"], r["length"]) for r in X.list_files(spark, str(tmp_path / "d"), [".mha"]).collect()] == [("a.MHA", "s1", 2)]
    df = spark.createDataFrame([("train", "s1", 1), ("test", "s2", 2)], "split string, series_id string, v int")
    X.write_split_layout(df, str(tmp_path / "layout"))
    assert sorted(map(tuple, X.read_split_layout(spark, str(tmp_path / "layout")).select("split", "series_id", "v").collect())) == sorted(map(tuple, df.collect()))
    X.write_patches(df, str(tmp_path / "patches"), 4)
    assert spark.read.parquet(str(tmp_path / "patches")).count() == 2
    X.write_report(df, str(tmp_path / "report"), "csv", ["split"])
    assert X.read_metadata_csv(spark, str(tmp_path / "report" / "split=train"), "series_id string, v int", ["v"]).first()["v"] == 1
    rows, head = X.run_log(df.withColumn("error", F.when(F.col("v") == 2, "bad")), {"root": "r"})
    assert (head.first()["n_ok"], head.first()["n_error"]) == (1, 1)
    done = spark.createDataFrame([("s1", False)], "series_id string, has_label boolean")
    tasks = spark.createDataFrame([("s1", "l"), ("s2", None)], "series_id string, label string")
    assert X.pending_tasks(tasks, done, ["series_id"], "label").count() == 2


def test_validation(spark):
    v = spark.createDataFrame([("a", [20, 20, 20]), ("b", [20, 3, 20])], "k string, shape array<int>")
    assert {(r["k"], r["kept"], r["reason"]) for r in V.min_volume_size(v, "shape", [16, 16, 16], 1).collect()} == {("a", True, None), ("b", False, "short axes 1")}
    runs = spark.createDataFrame([(1, 1, "m", "ct", "a", "f"), (1, 1, "m", "ct", "b", "g"), (2, 1, "m", "ct", "a", "h")], "exp int, round int, model string, modality string, dataset string, file string")
    assert {(r["exp"], r["violation"]) for r in V.round_consistency(runs).collect()} == {(1, "several data sets"), (2, None)}


def test_nearest_slice_without_index_or_place(spark):
    t = spark.createDataFrame([("a", 5.0), ("a", None), ("b", 1.0)], "k string, t double")
    s = spark.createDataFrame([("a", 5.0, None), ("a", 9.0, 3), ("a", None, 4), ("b", 1.0, None)], "k string, y double, idx long")
    assert sorted(map(tuple, S.nearest_slice(t, s, ["k"], "t", "y", "idx").collect()), key=str) == [("a", 5.0, 3), ("a", None, None), ("b", 1.0, None)]


def test_sizes_of_geometry_and_image_agree(spark):
    v = spark.createDataFrame([("a", [1, 2, 3], [1.0, 1.0, 1.0], [float(i) for i in range(6)])], "series_id string, shape array<int>, spacing array<double>, voxels array<double>")
    size = S.resample_geometry(v, new_spacing=[2.0, 2.0, 2.0]).first()["new_size"]
    assert size == [1, 1, 1] == K.resample_image_linear(v, [2.0, 2.0, 2.0]).first()["shape"]
    g = spark.createDataFrame([("a", 1, 2, 3, *size)], "series_id string, old_d int, old_h int, old_w int, new_d int, new_h int, new_w int")
    assert S.resample_labels_nn(spark.createDataFrame([("a", 0, 0, 0, 7)], "series_id string, z int, y int, x int, label int"), g).count() == 1


def test_ingestion_with_a_new_checkpoint_loses_nothing(spark, tmp_path):
    from voxelframe.streaming import incremental as I

    source, out, done = str(tmp_path / "in"), str(tmp_path / "out"), spark.createDataFrame([("gone",)], "sop string")
    schema = "sop string, ts timestamp"

    def arrive(*ids):
        spark.createDataFrame([(i,) for i in ids], "sop string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        I.streaming_ingest_slices(stream, lambda: done, "sop", "ts", "1 day", out, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r["sop"] for r in spark.read.parquet(out).collect())

    arrive("a", "b", "gone")
    arrive("b", "c")
    assert run("one") == ["a", "b", "c"]
    arrive("d", "a")
    assert run("one") == ["a", "b", "c", "d"]
    arrive("e", "b")
    assert run("two") == ["a", "b", "c", "d", "e"]  # all of the input again, under another query
    arrive("f", "e")
    assert run("one") == ["a", "b", "c", "d", "e", "f"]
    assert len({f.split("run=")[1].split("/")[0] for f in I.written_before(spark, out)}) == 2


def test_distribution_with_and_without_a_table_of_slices(spark):
    from voxelframe.operators.stats import hierarchical_distribution

    px = spark.createDataFrame([(d, c, z, v * (z + 1.0)) for d in "ab" for c in range(6) for z in range(5) for v in range(4)], "d string, c int, z int, v double")
    rows = [sorted(map(tuple, hierarchical_distribution(px, "d", "c", "z", None, "v", 4, 3, 1, index=i).collect())) for i in (None, px.select("d", "c", "z"))]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_rows_of_one_key_spread_over_ranges(spark):
    from voxelframe.functions.ranks import ranked

    df = spark.range(4000).select("id", F.lit("same").alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    for part in (df.drop("m"), df):
        r = ranked(part, "k")
        assert sorted(x["rank"] for x in r.select("rank").collect()) == list(range(1, 4001))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        files = ranked(df.drop("m"), "k").inputFiles()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(files) > 1
