"""Golden arrays, injected interference, and native steps against the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsky.functions import boxes, grammar, stokes
from quietsky.operators import flags, kernels, packing, selection, stats
from quietsky.operators import threshold as th
from quietsky.plans import application, strategy
from quietsky.sources import fixtures, tables

GROUP = {"field_id": 0, "data_desc_id": 0, "scan_number": 0, "bl": 0, "corr": 0}


def long(spark, amp, flag):
    rows = [(*GROUP.values(), t, c, None if np.isnan(amp[t, c]) else float(amp[t, c]), bool(flag[t, c])) for t in range(amp.shape[0]) for c in range(amp.shape[1])]
    kinds = ", ".join(f"{k} int" for k in GROUP)
    return spark.createDataFrame(rows, f"{kinds}, time_idx int, chan int, amp double, flag boolean")


def plane(df, column, shape, default=np.nan):
    out = np.full(shape, default, dtype=object)
    for r in df.select("time_idx", "chan", column).collect():
        out[r[0], r[1]] = r[2]
    return out


def noisy(shape=(40, 60), seed=1):
    rng = np.random.default_rng(seed)
    amp = 5 + np.sin(np.arange(shape[1]) / 9) + rng.normal(0, 0.1, shape)
    amp[12 % shape[0], :] += 2
    amp[shape[0] // 2 :, 20:23] += 3
    amp[:, 7] += 4
    flag = rng.random(shape) < 0.05
    return amp, flag


def test_averages():
    amp = np.arange(30.0).reshape(5, 6)
    flag = np.zeros((5, 6), bool)
    flag[3], flag[:, 4], flag[2, 0], flag[2, 5] = True, True, True, True
    mean, none = kernels.averaged(amp, flag, 4)
    assert mean.shape == (5, 2) and mean[0].tolist() == [1.5, 5.0] and mean[2].tolist() == [14.0, 0.0]
    assert none[2].tolist() == [False, True] and none[3].all()


def test_average_native_equals_kernel(spark):
    amp, flag = noisy()
    amp[3, 4] = np.nan
    mean, none = kernels.averaged(amp, flag, 7)
    got = th.average_freq(long(spark, amp, flag), 7)
    assert np.allclose(plane(got, "amp", mean.shape).astype(float), mean)
    assert (plane(got, "flag", mean.shape).astype(bool) == none).all()


def test_box_golden_and_edges():
    x = np.array([50.0, 10, 60, -70, 30, 20, -15])
    assert np.allclose(kernels.box(x, 2, 1, 0), [24, 10, 16, 10, 5, -7, 7])
    y = np.arange(1.0, 8)
    assert np.allclose(kernels.box(y, 2, 4, 0)[:3], [1.635, 2.195, 2.72], atol=1e-3)
    k = boxes.kernel(2)
    assert len(k) == 17 and abs(sum(k) - 1) < 1e-12
    assert [boxes.radius(s) for s in (12.5, 10, 6.5, 64, 2)] == [10, 8, 5, 55, 1]


def test_interpolation():
    nan = np.nan
    x = np.array([[nan, nan, 1.0, nan, 3.0, nan], [nan] * 6])
    assert kernels.interpolated(x).tolist() == [[1, 1, 1, 2, 3, 3], [0] * 6]


@pytest.mark.parametrize("iterations", [1, 2])
def test_background_native_equals_kernel(spark, iterations):
    amp, flag = noisy((15, 30))
    flag[4:9, 10:22] = True
    want = kernels.background(amp, flag, iterations, (1.5, 2.0), 2.0, np.array([0, 10, 30]))
    got = th.background(long(spark, amp, flag), iterations, (1.5, 2.0), 2.0, [0, 10, 30])
    assert np.allclose(plane(got, "background", amp.shape).astype(float), want)


@pytest.mark.parametrize("axis", ["time", "freq"])
def test_sum_threshold_native_equals_kernel(spark, axis):
    amp, flag = noisy()
    amp -= 5 + np.sin(np.arange(amp.shape[1]) / 9)
    n = amp.shape[0 if axis == "time" else 1]
    ends = [0, n // 3, n]
    want = kernels.sum_threshold(amp, flag, 0 if axis == "time" else 1, [1, 2, 4, 8], 4.5, 1.3, np.array(ends))
    got = th.sum_threshold(long(spark, amp, flag), axis, [1, 2, 4, 8], 4.5, 1.3, ends)
    assert want.any() and (plane(got, "hit", amp.shape).astype(bool) == want).all()


def test_sum_threshold_statistics():
    rng = np.random.RandomState(1)
    x = rng.normal(0, 3, (100, 90))
    want = np.zeros(x.shape, bool)
    for t, c, v in ((10, 10, 100), (50, 60, -100)):
        x[t, c], want[t, c] = v, True
    x[:, 40] += 200
    want[:, 40] = True
    got = kernels.sum_threshold(x, np.zeros(x.shape, bool), 1, [1, 2, 4, 8], 4.5, 1.3)
    assert (got != want).mean() < 0.01
    assert not kernels.sum_threshold(np.zeros((4, 5)), np.ones((4, 5), bool), 0, [1, 2], 4.5, 1.3).any()
    assert not kernels.sum_threshold(x, np.zeros(x.shape, bool), 1, [], 4.5, 1.3).any()


def test_smear_is_uneven_for_even_extends_and_clears_for_zero(spark):
    f = np.zeros((7, 1), bool)
    f[3] = True
    assert np.flatnonzero(kernels.smeared(f, 2, 0)).tolist() == [3, 4]
    assert np.flatnonzero(kernels.smeared(f, 3, 0)).tolist() == [2, 3, 4]
    assert not kernels.smeared(f, 0, 0).any()
    got = th.smeared(long(spark, f.astype(float), f), "time", 2)
    assert np.flatnonzero(plane(got, "flag", f.shape).astype(bool)).tolist() == [3, 4]


def test_counts_of_whole_rows_and_channels_are_taken_before_filling():
    amp = np.full((10, 10), 5.0)
    o = {**kernels.SUM_THRESHOLD, "freq_chunks": 1, "freq_extend": 1, "time_extend": 1}
    amp[0, :9] = np.nan
    out = kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), **{k: o[k] for k in ("freq_chunks", "freq_extend", "time_extend")})
    assert out[0, :9].all() and not out[1:].any()


def injected():
    """A plane of 180 times by 420 channels with bad times, channels, a block, a channel that is a little too high, and missing samples."""
    rng = np.random.default_rng(17)
    shape = (180, 420)
    amp = np.abs(1.7 + 0.4 * np.sin(np.arange(shape[1]) / 120) + rng.normal(0, 0.08, shape))
    rfi = np.zeros(shape, bool)
    for sel, v in ((np.s_[30:31, :], 0.9), (np.s_[61:65, :], 0.6), (np.s_[:, 57:58], 0.9), (np.s_[:, 250:253], 0.8), (np.s_[120:150, 300:330], 0.7)):
        amp[sel] += v
        rfi[sel] = True
    amp[5, 400] = np.nan
    rfi[5, 400] = True
    return amp, rfi


@pytest.mark.parametrize("average", [1, 2])
def test_injected_interference_is_found(average):
    amp, rfi = injected()
    out = kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), average_freq=average, num_major_iterations=1)
    assert not (rfi & ~out).any()
    assert (out & ~kernels.smeared(kernels.smeared(rfi, 3, 0), 3, 1)).mean() < 0.03


def test_mostly_bad_times_and_channels_are_filled():
    amp, _ = injected()
    amp[90, :390] += 2.0  # over the part of a time that fills it
    amp[:140, 120] += 2.0
    out = kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), num_major_iterations=1)
    assert out[90].all() and out[:, 120].all()


def test_flagged_missing_channels_leave_the_rest_alone():
    amp, rfi = injected()
    flags = np.zeros(amp.shape, bool)
    amp[:, 200:210], flags[:, 200:210] = np.nan, True
    out = kernels.sum_threshold_flags(amp, flags, num_major_iterations=1)
    assert out[:, 200:210].all() and not (rfi & ~out).any()
    rest = np.delete(out & ~kernels.smeared(kernels.smeared(rfi, 3, 0), 3, 1), np.s_[195:215], axis=1)
    assert rest.mean() < 0.03


def test_a_slightly_biased_channel_is_found_over_time():
    amp, _ = injected()
    amp[:, 350] += 0.35  # few single samples stand out
    out = kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), num_major_iterations=1)
    assert out[:, 350].mean() > 0.9


def test_all_flagged_gives_no_new_flags():
    assert not kernels.sum_threshold_flags(np.zeros((100, 80)), np.ones((100, 80), bool)).any()


def test_only_the_last_iterations_flags_come_back():
    amp, _ = injected()
    first = kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), num_major_iterations=1)
    again = kernels.sum_threshold_flags(amp, first, num_major_iterations=1)
    assert (kernels.sum_threshold_flags(amp, np.zeros(amp.shape, bool), num_major_iterations=2) == again).all()


def test_fit_and_clip_native_equals_kernel(spark):
    rng = np.random.default_rng(3)
    vis = 3 + np.cos(np.arange(16) / 5)[None, :] + rng.normal(0, 0.1, (12, 16)) + 1j * rng.normal(0, 0.1, (12, 16))
    vis[4, 7] += 5
    vis[2, 3] = np.nan
    flag = rng.random(vis.shape) < 0.1
    flag[2, 3] = True
    for keep in (True, False):
        want = kernels.uvcontsub_flags(vis, flag, major_cycles=1, or_original_from_cycle=0 if keep else 1, taylor_degrees=4, sigma=5)
        df = long(spark, vis.real, flag).withColumn("re", F.coalesce("amp", F.lit(float("nan"))))
        im = long(spark, vis.imag, flag).select("time_idx", "chan", F.coalesce("amp", F.lit(float("nan"))).alias("im"))
        got = plane(th.fit_and_clip(df.join(im, ["time_idx", "chan"]), 16, 4, 5.0, keep), "flag", vis.shape).astype(bool)
        assert (got == want).all() and got[4, 7] and got[2, 3] == keep
    assert kernels.uvcontsub_flags(vis, np.ones(vis.shape, bool)).all()


@pytest.mark.parametrize("kinds", [[9, 10, 11, 12], [5, 6, 7, 8], [12, 11, 10, 9], [8, 7, 6, 5]])
def test_stokes(spark, kinds):
    v = np.array([1 + 1j, 2 + 2j, 3 + 3j, 4 + 4j])
    by = dict(zip(kinds, v, strict=True))
    if 9 in by:
        i, q, u, w = (by[9] + by[12]) / 2, (by[9] - by[12]) / 2, (by[10] + by[11]) / 2, -0.5j * (by[10] - by[11])
    else:
        i, q, u, w = (by[5] + by[8]) / 2, (by[6] + by[7]) / 2, -0.5j * (by[6] - by[7]), (by[5] - by[8]) / 2
    df = spark.createDataFrame([([(float(z.real), float(z.imag)) for z in v],)], "vis array<struct<re:double,im:double>>")
    pol = np.sqrt(abs(q) ** 2 + abs(u) ** 2 + abs(w) ** 2)
    got = df.select(stokes.polarised(F.col("vis"), kinds), stokes.unpolarised(F.col("vis"), kinds), stokes.total_power(F.col("vis"), kinds)).first()
    assert np.allclose(got, [pol, abs(i) - pol, np.sqrt(pol**2 + abs(i) ** 2)])
    with pytest.raises(ValueError):
        stokes.unpolarised(F.col("vis"), [kinds[0]])


def test_pack_keeps_what_rows_hold(spark):
    rows = packing.indexed(fixtures.rows(spark, "/root/testdata/sf0.001").where("row_id % 9 <> 4"))
    back = packing.unpacked(rows, packing.packed(rows, 8, 4)).select("row_id", F.col("flag").alias("new"))
    last = rows.groupBy(*packing.GROUP, "bl", "time_idx").agg(F.max("row_id").alias("row_id")).select("row_id")
    both = rows.join(back, "row_id").join(last, "row_id")
    assert both.count() > 0 and both.where("flag <> new").count() == 0


def test_grammar():
    assert grammar.number_list("1,4~6,5") == [1, 4, 5, 6] and grammar.number_list("*") is None and grammar.number_list("5~3") == []
    assert grammar.length_range("1e2~550m") == (100.0, 550.0) and grammar.length_range("")[1] == np.inf
    assert grammar.dilation("1.5MHz", 1e6) == 2 and grammar.dilation("3", 1.0) == 3 and grammar.dilation("0", 1.0) == 0
    for bad in (lambda: grammar.number_list("a"), lambda: grammar.length_range("1-2"), lambda: grammar.dilation("3mhz", 1.0), lambda: grammar.length_range(3)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        grammar.merged_chunks([(1,), (1, 2)], [1, 1])


def test_masks_and_fields(spark, tmp_path):
    raw = np.array([(i == 4, 1e6 * i) for i in range(10)], dtype=[("mask", bool), ("chans", float)])
    np.save(tmp_path / "a.npy", raw)
    got = tables.load_mask(spark, str(tmp_path / "a.npy"), dilate="1MHz").where("masked").select("chan_idx").collect()
    assert sorted(r[0] for r in got) == [2, 3, 4, 5, 6]
    np.save(tmp_path / "b.npy", np.arange(3))
    with pytest.raises(ValueError):
        tables.load_mask(spark, str(tmp_path / "b.npy"))
    assert [p[-5:] for p in tables.find_masks(folders=(str(tmp_path),))] == ["a.npy", "b.npy"]
    fields = spark.createDataFrame([(0, "x"), (1, "y")], "field_id int, name string")
    df = spark.createDataFrame([(0,), (1,)], "field_id int")
    assert selection.by_field(df, fields, ["y,0"]).count() == 2
    with pytest.raises(ValueError):
        selection.by_field(df, fields, ["z"])
    with pytest.raises(ValueError):
        selection.by_field(df, fields, ["7"])


def test_strategies_are_checked():
    for bad in ([{"name": "x"}], [{"name": "x", "task": "y"}], [{"name": "x", "task": "sum_threshold"}], [{"name": "x", "task": "apply_static_mask", "kwargs": {"accumulation_mode": "and"}}]):
        with pytest.raises(ValueError):
            strategy.checked(bad)
    assert len(strategy.checked(strategy.DEFAULT)) == 12


def test_a_range_of_baselines_needs_positions_and_has_no_order(spark):
    df = fixtures.spectra(spark, "/root/testdata/sf0.001").where("bl < 4 and time_idx < 3")
    mask = [{"name": "m", "task": "apply_static_mask", "kwargs": {"uvrange": "150~0"}}]
    channels, masks, antennas = fixtures.channels(spark), fixtures.masks(spark), fixtures.antennas(spark)
    for f in (lambda: strategy.apply_strategies(df, mask, channels, masks), lambda: flags.apply_static_mask(df, channels, masks, uvrange="0~150")):
        with pytest.raises(ValueError):
            f()
    line = df.select("antenna1", "antenna2").distinct()
    assert selection.baselines_in_range(line, antennas, "550~0").count() == selection.baselines_in_range(line, antennas, "0~550").count() > 0
    key = ["bl", "time_idx", "chan"]
    one = strategy.apply_strategies(df, mask, channels, masks, antennas).select(*key, F.col("flag").alias("a"))
    two = flags.apply_static_mask(df, channels, masks, antennas, "or", "0~150").select(*key, F.col("flag").alias("b"))
    both = one.join(two, key)
    assert both.count() == df.count() and both.where("a <> b").count() == 0


def test_data_is_shuffled_once(spark):
    known = strategy.instrument(fixtures.channels(spark), None, None)
    plan = strategy.flag_baselines(fixtures.spectra_rows(spark, "/root/testdata/sf0.001"), [{"name": "n", "task": "flag_nans_zeros"}], known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_tables_are_read_flagged_and_written(spark, tmp_path):
    root = tmp_path / "tables"
    fixtures.described_rows(spark, "/root/testdata/sf0.001").drop("row_id").write.partitionBy(*packing.GROUP).parquet(str(root / "main"))
    for name, df in fixtures.side_tables(spark).items():
        df.write.parquet(str(root / name))
    np.save(tmp_path / "m.npy", np.array([(i in (2, 3), fixtures.FIRST_FREQ + i * fixtures.FREQ_STEP) for i in range(8)], dtype=[("mask", bool), ("chans", float)]))
    (tmp_path / "s.yaml").write_text("strategies:\n- {name: a, task: flag_nans_zeros}\n- {name: b, task: apply_static_mask, kwargs: {uvrange: ''}}\n- {name: c, task: combine_with_input_flags}\n")
    application.main([str(root), str(tmp_path / "out"), "--mode", "standard", "--scans", "0~3", "--fields", "3C286", "--strategies", str(tmp_path / "s.yaml"), "--mask", str(tmp_path / "m.npy")])
    main = tables.read_visibilities(spark, str(root / "main"))
    got = spark.read.parquet(str(tmp_path / "out"))
    asked = main.where("scan_number <= 3 and field_id = 0")
    assert got.count() == asked.count() > 0 and got.join(asked, "row_id", "left_anti").count() == 0
    for r in got.collect():
        first = 2 if r["data_desc_id"] == 0 else 1  # the second window begins one channel higher
        assert all(r["flag"][first]) and all(r["flag"][first + 1]) and len(r["flag"]) == (8 if r["data_desc_id"] == 0 else 4)
    with pytest.raises(ValueError):
        application.run(spark, str(root), str(tmp_path / "none"), application.Options(scans="77"))
    (tmp_path / "bad.yaml").write_text("steps: []\n")
    with pytest.raises(ValueError):
        application.strategies_of(application.Options(strategy_file=str(tmp_path / "bad.yaml")))
    assert not (tmp_path / "none").exists()


def test_one_pass_of_steps_equals_the_native_steps(spark):
    df = fixtures.spectra(spark, "/root/testdata/sf0.001").where("bl < 3")
    args = (fixtures.channels(spark), fixtures.masks(spark), fixtures.antennas(spark))
    steps = [{"name": "n", "task": "flag_nans_zeros"}, {"name": "m", "task": "apply_static_mask", "kwargs": {"accumulation_mode": "override", "uvrange": "0~150"}}, {"name": "a", "task": "flag_autos"}, {"name": "c", "task": "combine_with_input_flags"}]
    one = strategy.apply_strategies(df, steps, *args)
    two = flags.flag_autos(flags.apply_static_mask(flags.flag_nans_and_zeros(df), *args, "override", "0~150"))
    key = ["bl", "time_idx", "chan"]
    both = one.select(*key, F.col("flag").alias("a")).join(flags.combine_with_input(two.join(df.select(*key, F.col("flag").alias("flag_orig")), key)).select(*key, F.col("flag").alias("b")), key)
    assert both.count() == df.count() and both.where("a <> b").count() == 0


def test_report_and_empty_share(spark):
    s = spark.createDataFrame([("antenna", "A", 1, 4), ("antenna", "B", 0, 0)], "dim string, key string, flagged long, size long")
    lines = stats.report(s, s)
    assert lines[0] == "antenna A: 25.000%, original 25.000%" and lines[1].endswith("None")


def test_flags_are_written_by_group(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1, 5.0, True), (0, 0, 2, 6.0, False)], "field_id int, data_desc_id int, scan_number int, time double, flag boolean")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    tables.write_flags(df, str(tmp_path / "f"))
    tables.write_flags(df.where("scan_number = 2").withColumn("flag", ~F.col("flag")), str(tmp_path / "f"))
    got = {r["scan_number"]: r["flag"] for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert got == {1: True, 2: True}


def test_scans_stream(spark, tmp_path):
    from quietsky.streaming import scans

    rows = fixtures.rows(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    steps = [{"name": "n", "task": "flag_nans_zeros"}]
    channels = fixtures.channels(spark).where("chan < 8")
    q = scans.flag_scans(stream, lambda b: strategy.flag(b, channels, [9, 10, 11, 12], strategies=steps), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_a_scan_in_two_batches_keeps_all_its_rows(spark, tmp_path):
    from quietsky.streaming import scans

    rows = fixtures.rows(spark, "/root/testdata/sf0.001").where("scan_number = 0").coalesce(1)
    for i in range(2):
        rows.where(f"row_id % 2 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    steps = [{"name": "n", "task": "flag_nans_zeros"}]
    channels = fixtures.channels(spark).where("chan < 8")
    q = scans.flag_scans(stream, lambda b: strategy.flag(b, channels, [9, 10, 11, 12], strategies=steps), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = ["row_id", F.to_json(F.struct("flag")).alias("f")]
    whole = strategy.flag(rows, channels, [9, 10, 11, 12], strategies=steps)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == rows.count() and got.select(*key).exceptAll(whole.select(*key)).count() == 0


def test_scans_that_are_over_are_let_go(spark, tmp_path):
    """Three scans, a thousand apart, in turn; then rows that come too late for the first."""
    from quietsky.streaming import scans

    n = F.col("row_id") % 3
    rows = fixtures.rows(spark, "/root/testdata/sf0.001").withColumns({"scan_number": n.cast("int"), "field_id": F.lit(0), "time": F.col("time") + 1000.0 * n}).cache()
    steps = [{"name": "n", "task": "flag_nans_zeros"}]
    channels = fixtures.channels(spark).where("chan < 8")
    flagger = lambda b: strategy.flag(b, channels, [9, 10, 11, 12], strategies=steps)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    late = F.col("row_id") % 30 == 0
    for part in (rows.where((n == 0) & ~late), rows.where(n == 1), rows.where(n == 2), rows.where((n == 0) & late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = scans.flag_scans(stream, flagger, out, cp, lateness=500.0)  # a new start each time: what is over is known from the folder
        q.processAllAvailable()
        q.stop()
    kept = spark.read.parquet(f"{cp}-rows")
    assert {r[0] for r in kept.select("scan_number").distinct().collect()} == {2}  # the first went with the third's batch, the second with the last
    missed = scans.late_rows(spark, cp)
    assert missed.count() == rows.where(late).count() > 0
    assert len(list((tmp_path / "cp-seen").glob("_batch=*"))) == 2
    key = ["row_id", F.to_json(F.struct("flag")).alias("f")]
    got, whole = spark.read.parquet(out).select(*key), flagger(rows.where(~late)).select(*key)
    assert got.count() == whole.count() and got.exceptAll(whole).count() == 0


def test_a_repeated_batch_decides_alike(spark, tmp_path):
    from quietsky.sources.tables import folders
    from quietsky.streaming import scans

    assert folders(spark, str(tmp_path / "none")) == [] and scans.late_rows(spark, str(tmp_path / "none")) is None
    seen = str(tmp_path / "seen")
    for number, last in ((0, 5.0), (3, 900.0)):
        spark.createDataFrame([(0, 0, 0, last, False, number == 3)], "field_id int, data_desc_id int, scan_number int, last double, gone boolean, over boolean").write.parquet(f"{seen}/_batch={number}")
    assert scans._seen(spark, seen, 0) is None
    assert scans._seen(spark, seen, 3).first()["last"] == 5.0 and scans._seen(spark, seen, 4).first()["over"]
