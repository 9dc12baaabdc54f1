"""Real files: scanning, sidecars, EXIF, persisted forms, and streams."""

import json
import os
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from datewright import config as C
from datewright.operators import overlay, similar, transfer, vision
from datewright.operators.resolve import resolve
from datewright.sources import exif, listing, providers, records
from datewright.streaming import incremental


def tiff(order=">", when=b"2015:06:07 08:09:10\0", turn=6):
    """A TIFF with an orientation, and a date in the EXIF directory."""
    head = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "I", 8)
    ifd0 = struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0) + struct.pack(order + "HHII", 0x8769, 4, 1, 38) + b"\0\0\0\0"
    sub = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x9003, 2, len(when), 68) + struct.pack(order + "HHII", 0x9011, 2, 7, 88) + b"\0\0\0\0"
    return head + ifd0 + sub + when + b"+02:00\0"


def jpeg(body):
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda\0\0"


@pytest.mark.parametrize("order", [">", "<"])
def test_exif(order):
    for data in (tiff(order), jpeg(tiff(order))):
        assert exif.dates(data) == [("DateTimeOriginal +02:00", "2015:06:07 08:09:10")]
        assert exif.orientation(data) == 6
        new = exif.stamp(data, datetime(2020, 1, 2, 3, 4, 5))
        assert len(new) == len(data) and exif.dates(new)[0][1] == "2020:01:02 03:04:05"
    assert exif.dates(b"") == [] and exif.dates(b"\xff\xd8\xff") == [] and exif.orientation(b"II*\0") == 1 and exif.stamp(b"nothing", datetime(2020, 1, 1)) is None


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "out").mkdir()
    (root / "IMG_20230506_123456.jpg").write_bytes(b"x" * 10)
    (root / "_DSC1.jpg").write_bytes(jpeg(tiff()))
    (root / ".hid.jpg").write_bytes(b"")
    (root / "half.part").write_bytes(b"x")
    (root / "deep" / "er" / "holiday-edited.jpg").write_bytes(b"y" * 10)
    (root / "deep" / "er" / "holiday.jpg.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1577934245"}}))
    (root / "deep" / "pic.jpg").write_bytes(b"z")
    (root / "deep" / "pic.xmp").write_text('<x xmp:CreateDate="2011-02-03T04:05:06+01:00">')
    (root / "out" / "copied.jpg").write_bytes(b"x" * 10)
    return root


def test_scan_and_detect(spark, tree):
    files = listing.scan(spark, [str(tree)], destination=str(tree / "out"))
    names = {r.name for r in files.collect()}
    assert names == {"IMG_20230506_123456.jpg", "_DSC1.jpg", ".hid.jpg", "holiday-edited.jpg", "holiday.jpg.json", "pic.jpg", "pic.xmp"}
    assert listing.totals(files).head().files == 7
    found = {r.source.rsplit("/", 1)[1]: {c.provider: (c.taken, c.info) for c in r.candidates} for r in providers.detect(files).collect()}
    assert found["IMG_20230506_123456.jpg"]["filename"][0] == datetime(2023, 5, 6, 12, 34, 56)
    assert found["_DSC1.jpg"]["exif"] == (datetime(2015, 6, 7, 8, 9, 10), "DateTimeOriginal +02:00")
    assert found["holiday-edited.jpg"]["takeout"] == (datetime(2020, 1, 2, 3, 4, 5), "holiday.jpg.json")
    assert found["pic.jpg"]["xmp"] == (datetime(2011, 2, 3, 4, 5, 6), "xmp:CreateDate in pic.xmp")
    assert all("filesystem" in f for f in found.values())
    assert resolve(providers.detect(files)).count() == 7
    assert files.filter("name = '_DSC1.jpg'").select(providers.read_orientation("source").alias("o")).head().o == 6


def test_takeout_names(spark):
    get = lambda n: spark.createDataFrame([(n,)], "n string").select(providers.takeout_names(F.col("n")).alias("x")).head().x
    assert get("a(2).jpg") == ["a.jpg(2).json", "a(2).jpg.json", "a(2).jpg.supplemental-metadata.json"]
    assert get("b-bearbeitet.jpg")[1:] == ["b-bearbeitet.jpg.supplemental-metadata.json", "b.jpg.json", "b.jpg.supplemental-metadata.json"]
    cut = get("é" * 20 + ".jpg")[1]
    assert len(cut.encode()) <= 51 and cut.endswith(".json")


def test_plan_round_trip(spark, tmp_path):
    path = str(tmp_path / "plan")
    lines = [
        {"kind": "header", "version": 4, "created_at": "2026-01-01T00:00:00", "sources": ["/s"], "destination": "/d", "folder_pattern": "%Y", "detect": {"providers": ["exif"], "strategy": "smart", "weights": {"exif": 50}}},
        {"kind": "entry", "source": "/s/a", "destination": "/d/a", "taken": "2020-01-02T03:04:05", "provider": "exif", "provider_info": None, "size": 7},
        {"kind": "skipped", "source": "/s/b", "reason": "no date"},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    plan = records.read_plan(spark, str(tmp_path / "p.jsonl"))
    row = plan.entries.head()
    assert row.taken == datetime(2020, 1, 2, 3, 4, 5) and row.candidates == [] and row.flags == [] and row.rotate == "none"
    assert plan.skipped.head().reason == "no date" and plan.header["detect"]["weights"] == {"exif": 50}
    records.write_plan({k: v for k, v in lines[0].items() if k not in ("kind", "version")}, plan.entries, plan.skipped, path)
    again = records.read_plan(spark, path)
    assert again.entries.drop("ordinal").collect() == plan.entries.drop("ordinal").collect() and again.header["folder_pattern"] == "%Y"
    assert records.resumable(plan.header, again.header)


def test_plan_errors(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    head = json.dumps({"kind": "header", "version": 4, "sources": []})
    for text, message in ((head + "\n\n{broken\n", "line 3"), (json.dumps({"kind": "skipped", "source": "a", "reason": "b"}), "no header"), (json.dumps({"kind": "header", "version": 5}), "version 5")):
        p.write_text(text)
        with pytest.raises(ValueError, match=message):
            records.read_plan(spark, str(p))


def test_journal(spark, tmp_path):
    p = tmp_path / "j.jsonl"
    assert records.read_journal(spark, str(p)).count() == 0
    p.write_text("\n".join([json.dumps({"source": "/a", "status": "failed", "error": "x"}), "garbage", "", json.dumps({"source": "/a", "status": "copied", "destination": "/d", "written": {"size": 3, "hash": "h"}}), json.dumps({"source": "/b", "status": "copied", "written": {"size": 1, "hash": "i"}}), json.dumps({"source": "/b", "status": "failed"})]))
    j = records.read_journal(spark, str(p))
    assert {r.source: r.status for r in transfer.latest(j).collect()} == {"/a": "copied", "/b": "failed"}
    assert [r.source for r in transfer.written(j).collect()] == ["/a"]
    plan = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "source string")
    assert [r.source for r in transfer.pending(plan, j).collect()] == ["/c"]
    assert sorted(r.source for r in transfer.pending(plan, j, retry_failed=True).collect()) == ["/b", "/c"]


def test_overlays(spark, tmp_path):
    p = tmp_path / "o.json"
    assert records.read_dates(spark, str(p)).count() == 0
    p.write_text("﻿" + json.dumps({"/a": {"taken": "2020-01-02T03:04:05", "origin": "shift", "seconds": 60, "at": "2026-01-01T00:00:00"}}))
    row = records.read_dates(spark, str(p)).select("*", records.describe_origin(F.col("origin"), F.col("provider"), F.col("seconds")).alias("d")).head()
    assert row.taken == datetime(2020, 1, 2, 3, 4, 5) and row.d == "shifted by +0d 0h 1m"
    p.write_text("{broken")
    with pytest.raises(ValueError):
        records.read_dates(spark, str(p))
    p.write_text('["/b", "/a"]')
    assert sorted(r.source for r in records.read_exclusions(spark, str(p)).collect()) == ["/a", "/b"]


def test_settings_and_store(spark, tmp_path):
    p = str(tmp_path / "s.json")
    assert records.Settings.load(p) == records.Settings()
    s = records.Settings(weights={"exif": 500})
    s.save(p)
    assert records.Settings.load(p).weights == {"exif": 100}
    legacy = tmp_path / "tags.json"
    legacy.write_text(json.dumps({"/a": {"tags": ["x"]}}))
    store = records.open_store(spark, str(tmp_path / "store"), str(legacy))
    assert [r.tags for r in store.collect()] == [["x"]] and not legacy.exists()
    records.replace_store(store.filter("false"), str(tmp_path / "store"))
    assert records.open_store(spark, str(tmp_path / "store")).count() == 0


def test_duplicates_and_bursts(spark):
    rows = [("/c", 21, "h"), ("/a", 21, "h"), ("/b", 21, "h"), ("/e", 4, "i"), ("/d", 4, "i"), ("/z", 0, "0"), ("/y", 0, "0"), ("/u", 21, None)]
    got = similar.exact_duplicates(spark.createDataFrame(rows, "source string, size bigint, hash string")).collect()
    assert [(r.wasted, r.sources) for r in got] == [(42, ["/a", "/b", "/c"]), (4, ["/d", "/e"])]
    t = lambda s: datetime(2019, 7, 4, 10, 0, s)
    shots = [("/f/1", t(0), 5, 0), ("/f/2", t(10), 9, (1 << 10) - 1), ("/f/3", t(21), 5, (1 << 10) - 1), ("/f/4", t(22), 5, -1), ("/f/5", t(23), 7, -1), ("/f/6", t(24), 7, None), ("/g/1", t(0), 5, 0)]
    got = similar.bursts(spark.createDataFrame(shots, "source string, taken timestamp_ntz, size bigint, hash bigint")).collect()
    assert [(r.members, r.keeper, r.extra_bytes) for r in got] == [(2, "/f/2", 5), (2, "/f/5", 5)]


def test_vision(spark):
    ramp = np.tile(np.arange(9)[::-1], (8, 1))
    assert vision.difference_hash(ramp) == -1 and vision.difference_hash(ramp[:, ::-1]) == 0
    boxes = spark.createDataFrame(
        [(1, "none", "person", 0.6, [0.0, 0.0, 0.9, 0.2]), (1, "rot90", "person", 0.6, [0.0, 0.0, 0.2, 0.9]), (1, "rot90", "dog", 0.5, [0.0, 0.0, 0.5, 0.5]), (1, "rot90", "person", 0.5, [0.5, 0.0, 0.7, 0.9]), (2, "rot180", "cat", 0.3, [0.0] * 4), (3, "none", "person", 0.9, [0.0, 0.0, 0.2, 0.9]), (3, "rot90", "person", 1.0, [0.0, 0.0, 0.2, 0.9])],
        "file_id bigint, turn string, label string, confidence float, bounds array<float>",
    )
    got = {r.file_id: (r.transform, r.reason) for r in vision.upright(boxes).collect()}
    assert got == {1: ("rot90", "2 people, 1 dog"), 2: ("none", vision.NOTHING), 3: ("none", "1 person")}
    same = spark.createDataFrame([(1, "none", "a", 0.9, [0.0, 0.0, 1.0, 1.0]), (1, "none", "a", 0.8, [0.0, 0.0, 1.0, 0.9]), (1, "none", "b", 0.7, [0.0, 0.0, 1.0, 1.0]), (1, "none", "a", 0.3, [5.0, 5.0, 6.0, 6.0])], boxes.schema)
    assert sorted((r.label, round(r.confidence, 1)) for r in vision.suppress(same).collect()) == [("a", 0.9), ("b", 0.7)]


def test_suppressed_boxes_are_expressions(spark):
    """No Python call a picture; of equally sure boxes the first by bounds stays, whatever the order of rows; boxes without an area are kept."""
    schema = "line bigint, bounds array<float>, confidence float, label string, turn string, file_id bigint"
    rows = [(1, [1.0, 0.0, 11.0, 10.0], 0.5, "a", "none", 1), (2, [0.0, 0.0, 10.0, 10.0], 0.5, "a", "none", 1), (3, [2.0, 0.0, 12.0, 10.0], 0.5, "a", "none", 1), (4, [6.0, 0.0, 16.0, 10.0], 0.4, "a", "none", 1)]
    rows += [(5, [0.0] * 4, 0.9, "a", "none", None), (6, [0.0] * 4, 0.8, "a", "none", None), (7, [0.0, 0.0, 10.0, 10.0], 0.5, "a", "rot90", 1), (8, [0.0, 0.0, 1.0, 1.0], 0.35, "a", "none", 2)]
    for order in (rows, rows[::-1]):
        got = vision.suppress(spark.createDataFrame(order, schema))
        assert got.schema.names == ["line", "bounds", "confidence", "label", "turn", "file_id"]
        assert "Pandas" not in got._jdf.queryExecution().toString()
        assert sorted(r.line for r in got.collect()) == [2, 4, 5, 6, 7]


def test_stream(spark, tmp_path):
    t = datetime(2019, 7, 4, 10)
    rows = [("/s/a.jpg", 3, t, [("exif", None, t)], t), ("/s/b.jpg", 3, t, [("exif", None, t)], t)]
    for n in range(2):  # the same listing twice
        spark.createDataFrame(rows, incremental.LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.append(incremental.new_entries(incremental.listings(spark, str(tmp_path / "in")), "/out", "%Y"), str(tmp_path / "plan"), str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "plan")).collect()
    assert sorted(r.destination for r in got) == ["/out/2019/a.jpg", "/out/2019/b.jpg"]


def test_execute_copies(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    rows = []
    for name, body in (("a.jpg", jpeg(tiff())), ("b.jpg", b"same"), ("c.jpg", b"same"), ("d.jpg", b"other")):
        (src / name).write_bytes(body)
        rows.append((str(src / name), f"{out}/x/{'a' if name == 'a.jpg' else 'b'}.jpg", len(body), name[0] if name != "c.jpg" else "b", datetime(2021, 2, 3, 4, 5, 6)))
    plan = transfer.allocate(spark.createDataFrame(rows, "source string, destination string, size bigint, hash string, taken timestamp_ntz"))
    journal = {r.source.rsplit("/", 1)[1]: r for r in transfer.copy_files(plan, str(tmp_path / "j"), stamp=True).collect()}
    assert {k: r.status for k, r in journal.items()} == {"a.jpg": "copied", "b.jpg": "copied", "c.jpg": "already_present", "d.jpg": "duplicate"}
    assert (out / "x" / "b.jpg").read_bytes() == b"same" and (out / "x" / "b_dup_1.jpg").read_bytes() == b"other"
    assert exif.dates((out / "x" / "a.jpg").read_bytes())[0][1] == "2021:02:03 04:05:06" and journal["a.jpg"].written.size == len(jpeg(tiff()))
    assert {p.name for p in (out / "x").iterdir()} == {"a.jpg", "b.jpg", "b_dup_1.jpg"}
    again = {r.status for r in transfer.copy_files(plan, str(tmp_path / "j"), stamp=True).collect()}
    assert again == {"copied", "already_present", "duplicate"}  # the same contents may be written again
    counted = transfer.copy_counters(transfer.latest(records.read_journal(spark, str(tmp_path / "j"))).withColumn("turned", F.lit(False)).withColumn("size", F.lit(1))).head()
    assert (counted.copied, counted.duplicate, counted.already_present, counted.failed) == (2, 1, 1, 0)


def test_copies_that_rely_on_a_failed_one(spark, tmp_path):
    """A file whose content another should have written hasn't been copied if that one failed."""
    rows = [(str(tmp_path / n), str(tmp_path / "out" / "a.jpg"), 4, "same") for n in ("missing.jpg", "z.jpg")]
    (tmp_path / "z.jpg").write_bytes(b"same")
    plan = transfer.allocate(spark.createDataFrame(rows, "source string, destination string, size bigint, hash string"))
    done = {r.source.rsplit("/", 1)[1]: r for r in transfer.copy_files(plan, str(tmp_path / "j")).collect()}
    assert {k: r.status for k, r in done.items()} == {"missing.jpg": "failed", "z.jpg": "failed"} and "failed" in done["z.jpg"].error
    again = transfer.pending(spark.createDataFrame([(r[0],) for r in rows], "source string"), records.read_journal(spark, str(tmp_path / "j")), retry_failed=True)
    assert again.count() == 2


def test_turned_copies(spark, tmp_path):
    """A function of the caller's turns the bytes; what it can't turn is copied as it is."""
    rows = []
    for name, turn in (("a", "rot90"), ("b", "none"), ("c", "rot180")):
        (tmp_path / name).write_bytes(name.encode())
        rows.append((str(tmp_path / name), str(tmp_path / "out" / name), 1, name, turn, False))
    plan = transfer.allocate(spark.createDataFrame(rows, "source string, destination string, size bigint, hash string, rotate string, reencode boolean"))
    done = transfer.copy_files(plan, str(tmp_path / "j"), rotate=lambda data, turn, reencode: data + turn.encode() if turn == "rot90" else None).collect()
    assert {r.source[-1]: r.written.size if r.written else None for r in done} == {"a": 6, "b": None, "c": None}
    assert [(tmp_path / "out" / n).read_bytes() for n in "abc"] == [b"arot90", b"b", b"c"]


def test_names_run_out(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_VARIANTS", 3)
    plan = transfer.allocate(spark.createDataFrame([(f"/s/{i}", "/d/a.jpg", 1, str(i)) for i in range(5)], "source string, destination string, size bigint, hash string"))
    assert [(r.outcome, r.path) for r in plan.orderBy("source").collect()] == [("copied", "/d/a.jpg"), ("duplicate", "/d/a_dup_1.jpg"), ("duplicate", "/d/a_dup_2.jpg"), ("failed", None), ("failed", None)]
    assert {r.status for r in transfer.execute(plan.filter("path is null")).collect()} == {"failed"}
    behind = spark.createDataFrame([("/d/a.jpg", 0, 1, "x"), ("/d/a.jpg", 2, 1, "1")], "destination string, variant bigint, size bigint, hash string")
    plan = transfer.allocate(spark.createDataFrame([("/s/1", "/d/a.jpg", 1, "1")], "source string, destination string, size bigint, hash string"), behind)
    assert [(r.outcome, r.variant) for r in plan.collect()] == [("duplicate", 1)]  # a probe ends at the first free name


def test_journal_of_many_files(spark, tmp_path):
    """Spark reads large files first; the last record of a source is the last run's all the same."""
    path = str(tmp_path / "a b+c" / "j")
    row = lambda i, status: (f"/s/{i}", status, "/d", None, None)
    schema = "source string, status string, destination string, error string, written struct<size:bigint,hash:string>"
    records.append_journal(spark.createDataFrame([row(0, "failed")], schema), path)
    records.append_journal(spark.createDataFrame([row(i, "copied") for i in range(5000)], schema).repartition(7), path)
    records.append_journal(spark.createDataFrame([row(1, "failed")], schema), path)
    last = {r.source: r.status for r in transfer.latest(records.read_journal(spark, path)).collect()}
    assert len(last) == 5000 and last["/s/0"] == "copied" and last["/s/1"] == "failed" and set(last.values()) == {"copied", "failed"}


def test_a_replacement_that_was_cut_short(spark, tmp_path):
    """Whatever moment a store's replacement ends at, the old one or the new one is opened."""
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame([(s, ["t"], None, 1.0) for s in x], "source string, tags array<string>, vector array<float>, quality float")
    records.replace_store(rows("/old"), path)
    rows("/new").write.parquet(path + ".new")
    os.rename(path, path + ".old")  # as after the first of the two renames
    assert [r.source for r in records.open_store(spark, path).collect()] == ["/new"] and not os.path.exists(path + ".old")
    rows("/half").write.parquet(path + ".new")
    os.remove(path + ".new/_SUCCESS")
    os.rename(path, path + ".old")
    assert [r.source for r in records.open_store(spark, path).collect()] == ["/new"]
    records.replace_store(records.open_store(spark, path).unionByName(rows("/more")), path)
    assert sorted(r.source for r in records.open_store(spark, path).collect()) == ["/more", "/new"]


def test_guards(spark):
    """What commands refuse."""
    t = datetime(2020, 1, 2)
    plan = spark.createDataFrame([("/a", t, [("exif", None, t)]), ("/b", datetime(9999, 12, 31), [])], "source string, taken timestamp_ntz, candidates array<struct<provider:string,info:string,taken:timestamp_ntz>>")
    side = spark.createDataFrame([], "source string, taken timestamp_ntz, origin string, provider string, seconds bigint")
    done = lambda status: spark.createDataFrame([("/a", status)], "source string, status string")
    of = lambda *x: spark.createDataFrame([(s,) for s in x], "source string")
    for call, message in (
        (lambda: overlay.set_manual(plan, side, "/a", "tomorrow"), "isn't a date"),
        (lambda: overlay.set_manual(plan, side, "/c", "2020-01-01"), "isn't in the plan"),
        (lambda: overlay.set_manual(plan, side, "/a", "2020-01-01", done("copied")), "has been copied"),
        (lambda: overlay.set_candidate(plan, side, "/b", "exif"), "no date from exif"),
        (lambda: overlay.shift(plan, side, of("/a", "/b"), 86400), "outside the calendar"),
        (lambda: overlay.shift(plan, side, of("/a"), 1 << 60), "too large"),
        (lambda: overlay.reprovide(plan, side, of("/a", "/b"), "xmp"), "none of those files"),
    ):
        with pytest.raises(ValueError, match=message):
            call()
    new = overlay.set_manual(plan, side, "/a", "2021-03-04 05:06", done("failed"))
    assert [(r.source, r.taken, r.origin) for r in new.collect()] == [("/a", datetime(2021, 3, 4, 5, 6), "manual")]
    assert overlay.clear(new, of("/a")).count() == 0
    assert [r.source for r in overlay.reprovide(plan, side, of("/a", "/b"), "exif").collect()] == ["/a"]


def test_exif_containers():
    from datewright.plans.files import picture

    for ext in ("jpg", "tif", "png", "webp", "raf"):
        data = picture(ext, "2015:06:07 08:09:10", 6)
        assert exif.dates(data) == [("DateTimeOriginal", "2015:06:07 08:09:10")] and exif.orientation(data) == 6, ext
        assert exif.dates(exif.stamp(data, datetime(2021, 2, 3, 4, 5, 6)))[0][1] == "2021:02:03 04:05:06"
        assert exif.dates(data[:40]) == [] and exif.orientation(b"") == 1
    block = picture("tif", "2015:06:07 08:09:10", 6)
    boxes = b"\0\0\0\x18ftypcrx " + bytes(8) + b"\0\0\0\x50CMT1" + block
    assert exif.dates(boxes) == [("DateTimeOriginal", "2015:06:07 08:09:10")]
    for magic in (b"IIU\0", b"IIRO"):
        assert exif.orientation(magic + block[4:]) == 6


def test_scratch_needs_a_shared_folder():
    from datewright.sources import scratch

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.scratch(Session(), "x")


def test_small_rules(spark):
    assert [transfer.tuned_concurrency(f, b, 8) for f, b in ((0, 0), (1, 16 << 20), (1, 1), (1, 1 << 20))] == [8, 4, 16, 8]
    assert records.default_plan_name(["/a"], "/d") == records.default_plan_name(["/a"], "/d") != records.default_plan_name(["/a", "/d"], None)
