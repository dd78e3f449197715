"""Files read and written: WAV of each width, annotations of each generation, ground truth, recognisers."""

import struct
from pathlib import Path

import numpy as np
import pytest

from fieldsong.operators.labels import valid as valid_labels
from fieldsong.sources import annotations, audio, scratch


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_samples_survive_each_width(bits):
    low, high = (0, 255) if bits == 8 else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    x = np.array([low, high, 1, 2, 100])
    wav = audio.wav_bytes(x, 8000, bits)
    channels, rate, width, at, size = audio.parse_header(wav)
    assert (channels, rate, width) == (1, 8000, bits)
    assert (audio.decode(wav[at : at + size], bits, 1) == x).all()
    assert (audio.decode(audio.encode([10.0**12, -(10.0**12)], bits), bits, 1) == [high, low]).all()


def test_the_left_channel_and_chunks_before_the_samples():
    raw = struct.pack("<4h", 1, -1, 2, -2)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 4000, 16000, 4, 16)
    wav = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + fmt + b"data" + struct.pack("<I", len(raw)) + raw
    channels, rate, bits, at, size = audio.parse_header(wav)
    assert (channels, rate, list(audio.decode(wav[at : at + size], bits, channels))) == (2, 4000, [1, 2])
    assert audio.parse_header(b"RIFX" + wav[4:]) is None and audio.parse_header(b"") is None
    assert list(audio.decode(b"ab\x00", 16, 1)) == [struct.unpack("<h", b"ab")[0]]  # a frame that is cut short is left out


def test_files_become_pages(spark, tmp_path):
    x = np.arange(9000) % 200
    (tmp_path / "a_20191106_022512.wav").write_bytes(audio.wav_bytes(x, 1000))
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "wrong.wav").write_bytes(b"x" * 2000)
    found = audio.valid(audio.files(spark, str(tmp_path)))
    assert [r.duration for r in audio.recordings(found).collect()] == [9.0]
    pages = sorted(audio.pages(found, 2.0, 4000).collect(), key=lambda r: r.page)
    assert [(r.page, r.start_sample, len(r.samples)) for r in pages] == [(0, 0, 4000), (1, 4000, 4000)]
    assert list(pages[1].samples[:3]) == [0.0, 1.0, 2.0]


NEW = """[{"Operator":"Auto","Reviewer":"","Duration":60.0,"noiseLevel":null,"noiseTypes":[]},
 [2.25,6.5,900,4100,[{"species":"Corncrake (adult)","certainty":90,"filter":"crake-2","calltype":"rasp","weather":"dry"}]],
 [28,33.5,0,0,[{"species":"Bittern","certainty":50,"filter":"M"},{"species":"Don't Know","certainty":0}]],
 [41,42,0,0,[]]]"""
OLD = """[[-1, 60.0, "Op", "Rev", ["moderate", ["wind"]]], [1, 2, 0, 0, ["Kiwi?"]], [3, 4, 0.1, 0.4, "Tui"], [5, 6, 0, 0, ["Don't Know"]]]"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "new.data").write_text(NEW)
    (tmp_path / "old.data").write_text(OLD)
    return str(tmp_path)


def test_annotations_of_both_generations(spark, folder):
    got = annotations.read_annotations(spark, folder)
    rows = {(r.file_id.rsplit("/", 1)[1], r.s): r for r in got.collect()}
    names = lambda r: [(x.species, x.certainty) for x in r.labels]
    assert names(rows["new.data", 2.25]) == [("Corncrake (adult)", 90)]
    assert names(rows["new.data", 28.0]) == [("Bittern", 50), ("Don't Know", 0)]
    assert names(rows["new.data", 41.0]) == [("Don't Know", 0)]
    assert names(rows["old.data", 1.0]) == [("Kiwi", 50)] and names(rows["old.data", 3.0]) == [("Tui", 100)]
    assert (rows["old.data", 3.0].f_lo, rows["old.data", 3.0].f_hi) == (0, 0)
    assert len(rows) == 6 and got.where(~valid_labels(got.labels)).count() == 0


def test_headers_of_both_generations(spark, folder):
    rows = {r.file_id.rsplit("/", 1)[1]: r for r in annotations.read_metadata(spark, folder).collect()}
    assert (rows["new.data"].operator, rows["new.data"].duration, rows["new.data"].noise_level) == ("Auto", 60.0, None)
    assert (rows["old.data"].operator, rows["old.data"].reviewer, rows["old.data"].noise_level, rows["old.data"].noise_types) == ("Op", "Rev", "moderate", ["wind"])


def test_written_annotations_read_back_alike(spark, folder, tmp_path_factory):
    segments, head = annotations.read_annotations(spark, folder), annotations.read_metadata(spark, folder)
    out = tmp_path_factory.mktemp("again")
    for r in annotations.annotation_text(segments, head).collect():
        (out / r.file_id.rsplit("/", 1)[1]).write_text(r.value)
    flat = lambda df: sorted((r.file_id.rsplit("/", 1)[1], r.s, r.e, r.f_lo, r.f_hi, str(r.labels)) for r in df.collect())
    assert flat(annotations.read_annotations(spark, str(out))) == flat(segments)


def test_ground_truth(spark, tmp_path):
    (tmp_path / "a-GT.txt").write_text("1.0\t0\tNone\n2.0\t1\tMorepork\n3.0\t1\tMorepork\n\n")
    rows = sorted(annotations.read_truth(spark, str(tmp_path)).collect(), key=lambda r: r.bin)
    assert [(r.bin, r.present, r.species) for r in rows] == [(0, 0, None), (1, 1, "Morepork"), (2, 1, "Morepork")]
    made = annotations.truth_lines(spark.createDataFrame(rows).drop("file_id"), [], 1.0)
    assert sorted(r.value for r in made.collect()) == ["1.0\t0\tNone", "2.0\t1\tMorepork", "3.0\t1\tMorepork"]


def test_recognisers(spark, tmp_path):
    sub = '{"calltype":"all","TimeRange":[6,32,0.0,0.6],"FreqRange":[1100,7500],"WaveletParams":{"thr":0.5,"nodes":[17,20]}}'
    (tmp_path / "Good.txt").write_text(f'{{"species":"Kiwi","SampleRate":16000,"Filters":[{sub},{sub}]}}')
    (tmp_path / "NoRange.txt").write_text('{"species":"Kiwi","SampleRate":16000,"Filters":[{"calltype":"a","WaveletParams":{"thr":0.5,"nodes":[1]}}]}')
    (tmp_path / "Method.txt").write_text(f'{{"species":"Kiwi","SampleRate":16000,"method":"zz","Filters":[{sub}]}}')
    (tmp_path / "None.txt").write_text('{"species":"Kiwi","SampleRate":16000,"Filters":[]}')
    rows = annotations.read_filters(spark, str(tmp_path)).collect()
    assert [(r.filter_id, r.method, list(r.nodes)) for r in rows] == [("Good", "wv", [17, 20])] * 2


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "calls.txt").write_text("Kiwi > male\nKiwi > female\nTui > song\n")
    assert {r.species: r.calls for r in annotations.known_calls(spark, str(tmp_path / "calls.txt")).collect()} == {"Kiwi": ["female", "male"], "Tui": ["song"]}
    (tmp_path / "log.txt").write_text("start\nGPS (lat,long): -41.1, 174.2\nGPS (lat,long): -42.5,175.0\n")
    assert [(r.lat, r.long) for r in annotations.last_position(spark, str(tmp_path / "log.txt")).collect()] == [(-42.5, 175.0)]
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    log = spark.createDataFrame([("Kiwi", "x", "a"), ("Tui", "x", "b")], "species string, settings string, path string")
    assert [r.path for r in annotations.not_done(files, log, "Kiwi", "x").collect()] == ["b"]


def test_text_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of files; those in subfolders, at the top and a path that is a file are found, hidden ones not."""
    for name, operator in (("a b.data", "A"), ("x/b.data", "B"), ("x/y/c.data", "C"), ("x/.d.data", "D"), ("_z/e.data", "E"), ("f.txt", "F")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f'[{{"Operator": "{operator}é"}}]')
    back = annotations.read_metadata(spark, f"file://{tmp_path}")
    assert back.inputFiles() == []
    assert {(r.file_id.removeprefix(f"file://{tmp_path}/"), r.operator) for r in back.collect()} == {("a b.data", "Aé"), ("x/b.data", "Bé"), ("x/y/c.data", "Cé")}
    assert [r.operator for r in annotations.read_metadata(spark, str(tmp_path / "x/b.data")).collect()] == ["Bé"]
    assert sorted(r.operator for r in annotations.read_metadata(spark, f"{tmp_path}/x*").collect()) == ["Bé", "Cé"]


def test_sheets_are_files_of_bounded_length(spark, sf_dir):
    """A sheet that grows has more annotation files, not longer ones."""
    from fieldsong.plans import file_queries

    got = file_queries.sheet_annotations(spark, sf_dir)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity <> 7")
    want = li.selectExpr("concat_ws('_', l_suppkey % 10, l_linenumber) AS k", "floor(l_orderkey / 8 / 8192) AS part").distinct().count()
    root = scratch.scratch_root(spark).removeprefix("file://")
    newest = max(Path(root, "fieldsong").iterdir(), key=lambda p: p.stat().st_mtime)
    assert len(list(newest.rglob("*-*.data"))) == want
    assert got.selectExpr("sum(n)").first()[0] == li.count()
