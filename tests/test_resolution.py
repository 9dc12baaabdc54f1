"""Choice of dates, flags, anomalies and pairing, with both sides of each threshold."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from datewright import config as C
from datewright.operators import anomaly, pairing, resolve
from datewright.schema import CANDIDATES

NOW = datetime(2026, 8, 6, 12)


def files(spark, found, written=None):
    rows = [(1, [(p, None, t) for p, t in found], written)]
    return spark.createDataFrame(rows, f"ordinal bigint, candidates {CANDIDATES}, filesystem timestamp_ntz")


def chosen(spark, found, written=None, **options):
    return resolve.resolve(files(spark, found, written), NOW, C.DetectOptions(**options)).select("provider", "taken", "flags", "confidence").head()


def test_strategies(spark):
    old, new = datetime(2003, 1, 1), datetime(2019, 7, 4, 10)
    found = [("exif", old), ("filesystem", new)]
    assert chosen(spark, found, new).provider == "filesystem"  # a factory date loses
    assert chosen(spark, found, new, strategy="oldest").provider == "exif"
    assert chosen(spark, found, new, strategy="priority", providers=("filesystem", "exif")).provider == "filesystem"
    assert chosen(spark, [], new) is None


def test_weights(spark):
    a, b = datetime(2019, 7, 4, 10), datetime(2015, 7, 4, 10)
    found = [("filename", a), ("exif", b)]
    assert chosen(spark, found).provider == "exif"
    assert chosen(spark, found, weights={"filename": 90}).provider == "filename"
    assert C.DetectOptions(weights={"exif": 5000, "xmp": -20}).weight("exif") == 100 and C.DetectOptions(weights={"xmp": -20}).weight("xmp") == 0
    with pytest.raises(ValueError):
        C.DetectOptions(strategy="best")


def test_consensus_outweighs(spark):
    a, b = datetime(2019, 7, 4, 10), datetime(2015, 7, 4, 10)
    assert chosen(spark, [("filename", a), ("exif", b), ("filesystem", a + timedelta(hours=23))]).provider == "filename"
    assert chosen(spark, [("filename", a), ("exif", b), ("filesystem", a + timedelta(hours=24))]).provider == "exif"


def names(row):
    return [f.flag for f in row.flags]


def test_date_flags(spark):
    t = datetime(2019, 7, 4, 10)
    assert names(chosen(spark, [("exif", datetime(2003, 1, 1, 0, 1))])) == ["camera_epoch"]
    assert names(chosen(spark, [("exif", datetime(2003, 1, 1, 0, 1, 1))])) == []
    assert names(chosen(spark, [("exif", NOW + timedelta(seconds=1))])) == ["future_date"]
    assert names(chosen(spark, [("exif", t)], t - timedelta(hours=48))) == []
    assert names(chosen(spark, [("exif", t)], t - timedelta(hours=48, seconds=1))) == ["taken_after_file_write"]


def test_spread_and_zone(spark):
    t = datetime(2019, 7, 4, 10)
    assert names(chosen(spark, [("exif", t), ("xmp", t + timedelta(days=181) - timedelta(seconds=1))])) == []
    row = chosen(spark, [("exif", t), ("xmp", t + timedelta(days=181))])
    assert names(row) == ["provider_spread"] and row.flags[0].days == 181 and row.confidence == "medium"
    row = chosen(spark, [("exif", t), ("xmp", t + timedelta(hours=2))])
    assert row.flags[0].flag == "timezone_shift" and row.flags[0].hours == 2 and row.confidence == "high"
    assert names(chosen(spark, [("exif", t), ("xmp", t + timedelta(hours=1, minutes=30))])) == []
    assert names(chosen(spark, [("exif", t), ("filesystem", t + timedelta(hours=2))])) == []
    assert names(chosen(spark, [("exif", t), ("xmp", t + timedelta(hours=24))])) == []


def test_system_only_without_content(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 2), None), (datetime(2020, 1, 2), datetime(2020, 1, 3))], "s timestamp_ntz, e timestamp_ntz")
    none = F.lit(None).cast("string")
    rows = df.select(resolve.candidates({"system": (F.col("s"), none), "exif": (F.col("e"), none)}).alias("c")).collect()
    assert [[x.provider for x in r.c] for r in rows] == [["system"], ["exif"]]


def folder(spark, rows):
    """rows: name, taken, provider, written."""
    return spark.createDataFrame([(f"/f/{n}", t, p, w, i) for i, (n, t, p, w) in enumerate(rows)], "source string, taken timestamp_ntz, provider string, filesystem timestamp_ntz, ordinal bigint")


def crossed(spark, rows):
    found = anomaly.cross_file_flags(folder(spark, rows)).orderBy("ordinal").collect()
    return [[f.flag for f in r.cross_flags] for r in found]


def test_identical(spark):
    t, w = datetime(2015, 1, 1), datetime(2015, 1, 2)
    assert crossed(spark, [(f"x{i}", t, "exif", w) for i in range(5)])[0] == ["identical_timestamp_cluster"]
    assert crossed(spark, [(f"x{i}", t, "exif", w) for i in range(4)])[0] == []


def test_reset_run(spark):
    written = datetime(2019, 7, 4)
    run = [(f"IMG_{100 + i:04d}.jpg", datetime(2003, 1, 1, 9, 3 * i), "exif", written) for i in range(6)]
    assert all("clock_reset_run" in f for f in crossed(spark, run))
    party = [(n, t, p, datetime(2003, 1, 5)) for n, t, p, _ in run]
    assert not any("clock_reset_run" in f for f in crossed(spark, party))
    far = lambda minute: [*run[:2], ("z.jpg", datetime(2003, 2, 1, 9, minute), "exif", written)]
    assert "clock_reset_run" in crossed(spark, far(2))[2]  # 30 whole days
    assert "clock_reset_run" not in crossed(spark, far(3))[2]  # 31


def test_far_from_neighbours(spark):
    near = [(f"n{i}", datetime(2019, 6, 1 + i), "exif", datetime(2019, 7, 1)) for i in range(5)]
    assert "far_from_neighbours" in crossed(spark, [*near, ("odd", datetime(2004, 6, 1), "exif", datetime(2019, 7, 1))])[5]
    assert "far_from_neighbours" not in crossed(spark, [*near, ("odd", datetime(2004, 6, 1), "exif", datetime(2004, 7, 1))])[5]
    assert "far_from_neighbours" not in crossed(spark, [*near[:3], ("odd", datetime(2004, 6, 1), "exif", datetime(2019, 7, 1))])[3]


def test_sequence(spark):
    rows = [(f"DSC_{200 + i:04d}.jpg", datetime(2019, 7, 1 + i), "exif", None) for i in range(7)]
    rows[6] = (rows[6][0], datetime(2019, 6, 1), "exif", None)
    assert [("sequence_outlier" in f) for f in crossed(spark, rows)] == [False] * 6 + [True]
    assert not any("sequence_outlier" in f for f in crossed(spark, [(n, t, "filename", w) for n, t, _, w in rows]))


def test_order_of_rows_does_not_matter(spark, sf):
    from datewright.plans import adapters as A

    df = A.files_orders(spark, sf)
    pick = lambda d: sorted(map(str, anomaly.cross_file_flags(d).select("ordinal", "cross_flags").collect()))
    assert pick(df) == pick(df.orderBy(F.rand(1)))


def test_pairing(spark):
    t = [datetime(2019, 7, i) for i in range(1, 8)]
    rows = [("/a/IMG_1.HEIC", t[0], "exif"), ("/a/IMG_1.MOV", t[1], "media"), ("/a/B.jpg", t[2], "filesystem"), ("/a/B.jpg.xmp", t[3], "xmp"), ("/a/B.AAE", t[4], "filename"), ("/a/C.xmp", t[5], "xmp"), ("/a/C.dat", t[6], "exif"), ("/a/B(1).jpg", t[6], "exif"), ("/b/B.jpg", t[6], "exif")]
    df = spark.createDataFrame([(s, x, p, None, i) for i, (s, x, p) in enumerate(rows)], "source string, taken timestamp_ntz, provider string, provider_info string, ordinal bigint")
    got = {r.source: r for r in pairing.pair(df).collect()}
    assert got["/a/IMG_1.MOV"].taken == t[0] and got["/a/IMG_1.MOV"].provider_info == "beside IMG_1.HEIC"
    assert got["/a/B.jpg.xmp"].taken == got["/a/B.AAE"].taken == t[2] and got["/a/B.AAE"].provider == "filesystem"
    assert not any(got[p].changed for p in ("/a/C.xmp", "/a/C.dat", "/a/B(1).jpg", "/b/B.jpg", "/a/B.jpg"))
