"""Main tables in buckets of baselines, counts made by the flagging tasks, and a whole run by the default steps."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsky.operators import packing
from quietsky.plans import application, strategy
from quietsky.sources import fixtures, tables

DATA = "/root/testdata/sf0.001"
STEPS = [{"name": "n", "task": "flag_nans_zeros"}, {"name": "a", "task": "flag_autos"}]


@pytest.fixture
def stored(spark, tmp_path):
    """A table's name; it is dropped at the end."""
    tables.store_visibilities(fixtures.described_rows(spark, DATA), "stored_rows", str(tmp_path / "main"), 6)
    yield "stored_rows"
    spark.sql("drop table stored_rows")


def flat(df):
    return df.select("row_id", F.to_json(F.struct("flag")).alias("f"))


def side(spark, place):
    for name, df in fixtures.side_tables(spark).items():
        df.write.parquet(f"{place}/{name}")
    return str(place)


def test_buckets_are_flagged_where_they_lie(spark, stored):
    main, tables_ = tables.read_stored(spark, stored), fixtures.side_tables(spark)
    got = application.flag_tables(main, tables_, application.Options(stored=stored), None, STEPS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and re.search(r"\bdata#", x)]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]
    above = plan[: plan.index(scans[0])].splitlines()
    depth = lambda x: re.search(r"[A-Z*]", x).start()
    path, at = [], depth(scans[0])
    for x in reversed(above):
        if re.search(r"[A-Z*]", x) and depth(x) < at:
            path, at = [*path, x], depth(x)
    assert any("FlatMapCoGroupsInArrow" in x for x in path) and not any("Exchange" in x for x in path)
    want = application.flag_tables(fixtures.described_rows(spark, DATA), tables_, application.Options(), None, STEPS)
    assert got.count() == want.count() > 0 and flat(got).exceptAll(flat(want)).count() == 0 == flat(want).exceptAll(flat(got)).count()


def test_rows_out_of_buckets_give_the_same(spark):
    rows, tables_ = fixtures.described_rows(spark, DATA), fixtures.side_tables(spark)
    one, two = (application.flag_tables(rows, tables_, application.Options(stored=s), None, STEPS) for s in ("any", None))
    assert one.count() == rows.count() and flat(one).exceptAll(flat(two)).count() == 0


def test_a_stored_table_keeps_repeats_and_names(spark, stored, tmp_path):
    assert tables.read_stored(spark, stored).count() == fixtures.described_rows(spark, DATA).count()
    with pytest.raises(Exception, match="stored_rows"):
        tables.store_visibilities(fixtures.described_rows(spark, DATA), stored, str(tmp_path / "other"), 2)
    none = fixtures.described_rows(spark, DATA).limit(0)
    tables.store_visibilities(none, "stored_none", str(tmp_path / "none"), 3)
    try:
        out = application.flag_tables(tables.read_stored(spark, "stored_none"), fixtures.side_tables(spark), application.Options(stored="stored_none"), None, STEPS, counted=True)
        assert out.count() == 0
        with pytest.raises(ValueError):
            application.flag_and_commit(spark, side(spark, tmp_path), str(tmp_path / "flags"), application.Options(stored="stored_none"), STEPS)
        assert not (tmp_path / "flags").exists()
    finally:
        spark.sql("drop table stored_none")


@pytest.mark.parametrize("mode", ["standard", "total_power"])
@pytest.mark.parametrize("ignore", [False, True])
def test_counts_are_those_of_packed_windows(spark, mode, ignore):
    """The counts of the tasks against a sum over packing's own cells, with what no row fills."""
    rows = fixtures.rows(spark, DATA)
    channels = fixtures.channels(spark).where("chan < 8")
    one = [{"name": "n", "task": "flag_nans_zeros"}]
    flagged = strategy.flag(rows, channels, [9, 10, 11, 12], strategies=one, mode=mode, ignore_flags=ignore, counted=True)
    assert flagged.where("counts is not null").count() == rows.select(*tables.BASELINE).distinct().count()
    got = flagged.where("counts is not null").select(*tables.BASELINE, F.posexplode("counts").alias("chan", "c")).select(*tables.BASELINE, "chan", "c.*")
    if ignore:
        rows = rows.withColumn("flag", F.transform("flag", lambda c: F.transform(c, lambda k: F.lit(False))))
    ready = packing.indexed(strategy.quantity(rows, mode, [9, 10, 11, 12]))
    cells = packing.packed(ready, 8, 4 if mode == "standard" else 1)
    missing = F.isnan("re") | F.isnan("im") | ((F.col("re") == 0) & (F.col("im") == 0))
    sums = [F.count_if("flag").alias("before"), F.count_if(F.col("flag") | missing).alias("after"), F.count("*").alias("size")]
    want = cells.groupBy(*tables.BASELINE, "chan").agg(*sums)
    same = [*tables.BASELINE, "chan", "before", "after", "size"]
    assert got.count() == want.count() > 0 and got.select(*same).exceptAll(want.select(*same)).count() == 0


def test_a_whole_run_by_the_default_steps(spark, tmp_path):
    """Twelve steps over two fields: planted interference is found, the rest is not flagged away, and the report says as much."""
    place = side(spark, tmp_path / "in")
    strong = F.col("row_id") % 125 < 5
    loud = F.transform("data", lambda c, i: F.transform(c, lambda k: F.when(strong & (i == 3), F.struct((k["re"] + 500).alias("re"), k["im"].alias("im"))).otherwise(k)))
    clean = F.transform("flag", lambda c: F.transform(c, lambda k: F.lit(False)))
    rows = fixtures.described_rows(spark, DATA).where("scan_number < 2 and antenna1 <> antenna2").withColumns({"data": loud, "flag": clean})
    rows.write.partitionBy(*tables.GROUP).parquet(f"{place}/main")
    lines = application.run(spark, place, str(tmp_path / "out"), application.Options(mode="standard"))
    assert lines[0] == f"{len(strategy.DEFAULT)} steps"
    assert {x.split()[0] for x in lines[1:]} == {"antenna", "baseline", "field", "scan", "ddid_bin", "edges"}
    assert "edges of ddid 0: 856.0" in lines[-2] and lines[-1].startswith("edges of ddid 1") and lines[-1].endswith("MHz")
    flags = tables.read_flags(spark, str(tmp_path / "out"))
    assert "counts" not in flags.columns and flags.count() == rows.count()
    hit = rows.where(strong).select("row_id").join(flags, "row_id").collect()
    assert hit and np.mean([all(r["flag"][3]) for r in hit]) > 0.9
    rest = [x for r in flags.join(rows.where(strong).select("row_id"), "row_id", "left_anti").collect() for c in r["flag"] for x in c]
    assert np.mean(rest) < 0.5
