"""Exports for other programs, reviewers' corrections, and spectrogram images."""

import struct

import numpy as np
from pyspark.sql import functions as F

from fieldsong.operators.labels import LABEL
from fieldsong.sources import exports, images

L, S = "Long-tailed bat", "Short-tailed bat"


def labels(*pairs):
    return [(species, float(c), None, None) for species, c in pairs]


def segments(spark, rows):
    fields = [f.split(":")[0].strip() for f in LABEL.removeprefix("struct<").removesuffix(">").split(",")]
    fill = lambda x: tuple({"species": x[0], "certainty": x[1]}.get(f) for f in fields)
    return spark.createDataFrame([(*r[:-1], [fill(x) for x in r[-1]]) for r in rows], f"folder string, name string, seg_id long, labels array<{LABEL}>")


def test_categories_of_bat_recordings(spark):
    names = [f"20191106_02251{k}.bmp" for k in range(7)]
    given = [labels((L, 90)), labels((S, 85)), labels((L, 75)), labels((S, 71)), labels((L, 70)), labels((L, 10), (S, 10))]
    files = spark.createDataFrame([("night", n) for n in names], "folder string, name string")
    got = exports.bat_recordings(files, segments(spark, [("night", n, 1, x) for n, x in zip(names, given)]))
    rows = {r.name: r for r in got.collect()}
    assert [rows[n].AssignedBatCategory for n in names] == [3, 4, 5, 6, 1, 7, 1]
    assert rows[names[0]].RecTime == "2019-11-06T02:25:10" and rows[names[0]].RecordingFolderName == ".\\night"
    lines = {r.Filename: r for r in exports.bat_csv(got).collect()}
    assert (lines[names[0]].Date, lines[names[0]].Time, lines[names[5]].Category) == ("6/11/2019", "2:25:10 a.m.", "Both")


def test_bat_xml_reads_back(spark, tmp_path):
    files = spark.createDataFrame([("a", "061119_022512.bmp"), ("b", "x.bmp")], "folder string, name string")
    exports.write_bat_xml(exports.bat_recordings(files, segments(spark, [("a", "061119_022512.bmp", 1, labels((L, 99)))])), str(tmp_path / "out"))
    back = spark.read.format("xml").option("rowTag", "BatRecording").load(str(tmp_path / "out")).collect()
    assert sorted(r.AssignedBatCategory for r in back) == [1, 3]


def test_corrections_are_written_and_read(spark, tmp_path):
    before = segments(spark, [("f", "n", 1, labels(("Kiwi", 50))), ("f", "n", 2, labels(("Kiwi", 50))), ("f", "n", 3, labels(("Tui", 100)))])
    after = segments(spark, [("f", "n", 1, labels(("Morepork", 100))), ("f", "n", 3, labels(("Tui", 50)))])
    key = ["folder", "name", "seg_id"]
    found = exports.corrected(before, after, key)
    assert sorted(r.seg_id for r in found.collect()) == [1, 2]
    made = found.selectExpr("name AS file_id", "seg_id", "1.0D AS s", "5.0D AS e", "0 AS f_lo", "0 AS f_hi", "before", "after")
    value = exports.correction_text(made, F.lit('{"Operator":"A"}')).first().value
    (tmp_path / "a.corrections").write_text(value)
    back = exports.read_corrections(spark, str(tmp_path))
    assert sorted((r.s, r.e, r.before[0].species, len(r.after)) for r in back.collect()) == [(1.0, 5.0, "Kiwi", 0), (1.0, 5.0, "Kiwi", 1)]
    assert exports.rejected_as_noise(back, "Kiwi").count() == 2 and exports.rejected_as_noise(back, "Tui").count() == 0


def test_lists_and_overviews(spark):
    calls = spark.createDataFrame([("Tui", ["song"]), ("Kiwi", ["male", "female"])], "species string, calls array<string>")
    assert [r.value for r in exports.call_lines(calls).collect()] == ["Kiwi > female", "Kiwi > male", "Tui > song"]
    got = exports.species_overview(segments(spark, [("f", "n", 1, labels(("Kiwi", 50))), ("f", "m", 2, labels(("Kiwi", 90), ("Tui", 100)))]), F.col("folder"))
    assert sorted((r.species, r.least, r.n) for r in got.collect()) == [("Kiwi", 50.0, 2), ("Tui", 100.0, 1)]


def bmp(image):
    height, width = image.shape
    row = -(-width // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = image[::-1]
    head = b"BM" + struct.pack("<IHHI", 54 + 1024 + body.size, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 0, 0, 256, 0)
    return head + bytes(1024) + body.tobytes()


def test_images_and_their_clicks(spark):
    image = np.full((64, 102), 250, np.uint8)
    image[20:45, 31:36] = 5  # five columns, 24 to 54 kHz
    image[20:45, 61:63] = 5
    want = images.read_bmp(bmp(image))
    assert want.shape == (101, 64) and want[30:35, 25].min() == 1.0 and want[0, 30] < 0.05
    assert (images.read_bmp(bmp(np.rot90(image, 1, (0, 1)))) == want).all()
    assert images.read_bmp(b"RIFF" + bytes(100)) is None and images.read_bmp(bmp(image)[:500]) is None
    found = spark.createDataFrame([("f", bytearray(bmp(image))), ("g", bytearray(b"none"))], "path string, content binary")
    got = images.clicks(images.image_frames(found))
    assert sorted((r.s, r.e) for r in got.collect()) == [(30, 35), (60, 62)]
    assert images.clicks(images.image_frames(found), longest=3).count() == 1
    assert abs(images.click_spans(got).first().seconds - 32 * 512 / 176000) < 1e-9


def test_time_in_a_name_after_a_number_of_six_digits(spark):
    from fieldsong.functions.units import recorded_at

    names = spark.createDataFrame([("100000_19950707_163015.bmp",), ("7_19950707_163015.bmp",), ("x19950707_163015123.wav",)], "name string")
    assert {r.t for r in names.select(recorded_at(F.col("name")).cast("string").alias("t")).collect()} == {"1995-07-07 16:30:15"}


def test_workbook_deals_its_segments(spark, monkeypatch):
    """Segments are dealt to as many tasks as hold them, however few partitions shuffles have; a repeated row counts once."""
    from fieldsong.operators import survey

    dealt = []
    monkeypatch.setattr(survey, "TASK_SEGMENTS", 5, raising=False)
    monkeypatch.setattr(survey, "written", lambda df: dealt.append(df.rdd.getNumPartitions()) or df, raising=False)
    rows = [("f", k % 20, float(k % 20), k % 20 + 0.5, 0, 0, [("Kiwi", 50.0, None, None), ("Tui", 90.0 - k % 20, None, None)]) for k in range(40)]
    made = spark.createDataFrame(rows, f"file_id string, seg_id int, s double, e double, f_lo int, f_hi int, labels array<{LABEL}>")
    files = spark.sql("SELECT 'f' AS file_id, timestamp'2024-01-01' AS started, 60.0D AS duration")
    sheets = survey.workbook(made, files, 10.0)
    assert dealt == [40 // 5 + 1]
    assert {(r.species, r.present, r.max_cert) for r in sheets["presence"].collect()} == {("Kiwi", "Yes", 50.0), ("Tui", "Yes", 90.0), ("Any sound", "Yes", 90.0)}
    assert sheets["stamps"].count() == 60 and sheets["bins"].count() == 6
