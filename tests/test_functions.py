"""Scalar expressions and patterns on small tables, with the thresholds on both sides."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from datewright.functions import pattern as P
from datewright.functions import scalars as S
from datewright.functions.dateparse import parse_date, parse_manual, parse_xmp_date, takeout_taken


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2023-05-06T12:34:56", datetime(2023, 5, 6, 12, 34, 56)),
        ("2019:11:02 08:15:30", datetime(2019, 11, 2, 8, 15, 30)),
        ("IMG_20230506_123456.jpg", datetime(2023, 5, 6, 12, 34, 56)),
        ("20230506123456.jpg", datetime(2023, 5, 6, 12, 34, 56)),
        ("Rechnung 06.05.2023.pdf", datetime(2023, 5, 6)),
        ("scan 2023-05-06.pdf", datetime(2023, 5, 6)),
        ("20230506.jpg", datetime(2023, 5, 6)),
        ("20230230 and 20230506 ", datetime(2023, 5, 6)),
        ("20200101 then 2021-02-03 04:05:06", datetime(2021, 2, 3, 4, 5, 6)),
        ("", None),
        ("20230230.jpg", None),
        ("991220230506.bin", None),
        ("18500101.jpg", None),
        ("19500101.jpg", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    assert one(spark, text, parse_date) == expected


def test_sidecar_dates(spark):
    assert one(spark, "2020-01-02T03:04:05+02:00", parse_xmp_date) == datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, "2020-01-02T03:04:05.5Z", parse_xmp_date).replace(microsecond=0) == datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, "2020-01-02", parse_xmp_date) == datetime(2020, 1, 2)
    assert one(spark, "soon", parse_xmp_date) is None
    assert one(spark, '{"photoTakenTime": {"timestamp": "1577934245"}}', takeout_taken) == datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, '{"creationTime": {"timestamp": 1577934245}}', takeout_taken) == datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, "{}", takeout_taken) is None
    assert one(spark, " 2020-01-02 03:04 ", parse_manual) == datetime(2020, 1, 2, 3, 4)
    assert one(spark, "2020-01-02", parse_manual) == datetime(2020, 1, 2)


def test_paths(spark):
    for path, counter, stem, ext in (("/a/DSC_0123.JPG", 123, "DSC_0123", "jpg"), ("/a/a12.jpg", None, "a12", "jpg"), ("/a/.hidden", None, ".hidden", "hidden"), ("/a.b/name", None, "name", ""), ("/a/x18446744073709551616.jpg", None, "x18446744073709551616", "jpg"), ("/a/x18446744073709551615.jpg", 18446744073709551615, "x18446744073709551615", "jpg")):
        got = one(spark, path, S.counter)
        assert (None if got is None else int(got), one(spark, path, S.stem), one(spark, path, S.extension)) == (counter, stem, ext)
    assert one(spark, "/a/b/c.jpg", S.parent) == "/a/b"
    assert one(spark, "/a/IMG.jpg.xmp", S.group_stem) == "img" and one(spark, "/a/IMG.xmp", S.group_stem) == "img" and one(spark, "/a/IMG", S.group_stem) is None
    assert one(spark, "/a/x.tar.gz", lambda c: S.duplicate_variant(c, F.lit(2))) == "/a/x.tar_dup_2.gz"
    assert one(spark, "/a/x", lambda c: S.duplicate_variant(c, F.lit(1))) == "/a/x_dup_1"


@pytest.mark.parametrize(("subject", "expected"), [("  A Walk, in the Park! ", "a-walk-in-the-park"), ("../../etc", "etc"), ("Ünïcode 7", "ünïcode-7"), ("--..--", "unsorted"), ("", "unsorted"), ("x" * 60, "x" * 48)])
def test_folder_segment(spark, subject, expected):
    assert one(spark, subject, S.folder_segment) == expected


def test_destination(spark):
    df = spark.createDataFrame([("/src/p.jpg", datetime(2023, 1, 8, 7, 5, 9), "Big Day")], "source string, taken timestamp_ntz, subject string")
    get = lambda pattern, subject=None: df.select(P.destination(F.col("source"), F.col("taken"), "/out", pattern, subject).alias("d")).head()["d"]
    assert get("%Y/%m") == "/out/2023/01/p.jpg"
    assert get("%Y//%Y-%m-%d/") == "/out/2023/2023-01-08/p.jpg"
    assert get(r"%Y\%-m %e %j %H%M%S %y %I%p %b %B %a %A %u%w %V %G %% %F %U %W") == "/out/2023/1  8 008 070509 23 07AM Jan January Sun Sunday 70 01 2023 % 2023-01-08 02 01/p.jpg".replace(" 01 2023 ", f" {datetime(2023, 1, 8):%V} 2023 ").replace("02 01/", f"{datetime(2023, 1, 8):%U} {datetime(2023, 1, 8):%W}/")
    assert get("%Y/{subject}") == "/out/2023/unsorted/p.jpg"
    assert get("%Y/{subject}", F.col("subject")) == "/out/2023/big-day/p.jpg"
    for bad in ("", "  ", "%Q", "%", "%z"):
        with pytest.raises(ValueError):
            get(bad)


def test_week_numbers(spark):
    days = [(datetime(2020 + i // 366, 1, 1).replace(month=1 + i % 12, day=1 + i % 28),) for i in range(0, 1400, 7)]
    df = spark.createDataFrame(days, "t timestamp_ntz")
    for r in df.select("t", P.compile_pattern("%U %W %V %G %u %w %j", F.col("t")).alias("w")).collect():
        assert r["w"] == f"{r['t']:%U %W %V %G %u %w %j}"


def test_relative_folder(spark):
    for path, expected in (("/out/2023/01/p.jpg", "2023/01"), ("/out/p.jpg", ""), ("/outside/p.jpg", "/outside")):
        assert one(spark, path, lambda c: P.relative_folder(c, "/out")) == expected


def test_turns(spark):
    assert [one(spark, o, S.for_orientation, "int") for o in (1, 3, 6, 8, 9)] == ["none", "rot180", "rot90", "rot270", "none"]
    for t in S.TRANSFORMS:
        assert one(spark, t, lambda c: S.turn(S.turn(c, F.lit(3)), F.lit(1))) == t
    assert one(spark, "none", lambda c: S.turn(c, F.lit(-1))) == "rot270"


def test_labels(spark):
    assert one(spark, 1536, S.human_bytes, "bigint") == "1.50 KB" and one(spark, 5, S.human_bytes, "bigint") == "5 B"
    assert one(spark, -90061, S.humanise_shift, "bigint") == "-1d 1h 1m"
    assert one(spark, "a dog", S.label_of) == "dog" and one(spark, "another", S.label_of) == "another"
    names = ["img12", "img2", "img1", "IMG10"]
    assert [r["v"] for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(S.numeric_key(F.col("v"))).collect()] == ["img1", "img2", "IMG10", "img12"]
    assert one(spark, 0, lambda c: S.heat_step(c, F.lit(9)), "bigint") is None and one(spark, 9, lambda c: S.heat_step(c, F.lit(9)), "bigint") == 6
