"""Sources, sinks and streams."""

import json
import struct
import zlib

import pytest

from sheetmill.sources import readers as I
from sheetmill.sources import sinks as O
from sheetmill.streaming import arrivals as A


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, None), (3, None, "é")], "b int, a int, text string")
    O.write_jsonl(df, f"{tmp_path}/out")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(lines) == ['{"a":1,"b":2,"text":null}', '{"a":null,"b":3,"text":"é"}']
    back = I.read_jsonl(spark, f"{tmp_path}/out", df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert I.read_jsonl_if_exists(spark, f"{tmp_path}/none", "a int").count() == 0
    O.append_jsonl(df, f"{tmp_path}/out")
    assert I.read_jsonl(spark, f"{tmp_path}/out", df.schema).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n')
    with pytest.raises(Exception, match="oops|MALFORMED|FAILFAST|Malformed"):
        I.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    (tmp_path / "free.jsonl").write_text('{"a": 1}\n  \n{"b": [2]}\n')
    assert I.read_variant_lines(spark, f"{tmp_path}/free.jsonl").count() == 2


def test_ids_and_sheets(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# image_id\tpath\na\tx\n\nb\ty\na\tz\n")
    ids = I.read_ids(spark, f"{tmp_path}/ids.txt")
    assert sorted(r.image_id for r in ids.collect()) == ["a", "b"] and I.read_ids(spark, f"{tmp_path}/none.txt") is None
    sheets = spark.createDataFrame([("a", "ok", "Z"), ("b", "ok", None), ("c", "ok", "y"), ("d", "error", "x")], "image_id string, status string, relative_path string")
    assert [r.image_id for r in I.ok_sheets(sheets, ids).collect()] == ["b", "a"]
    assert [r.image_id for r in I.ok_sheets(sheets).collect()] == ["b", "c", "a"]


def png(path, width, height, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "one.png", 3, 2, (255, 10, 0))
    (tmp_path / "note.txt").write_text("no image")
    files = I.read_images(spark, str(tmp_path)).collect()
    assert [r.image_id for r in files] == ["one"]
    (tmp_path / "note.txt").unlink()
    (tmp_path / "bad.png").write_bytes(b"nothing")
    decoded = {r.image_id: r for r in I.decode_images(spark, str(tmp_path)).collect()}
    assert (decoded["one"].width, decoded["one"].height, list(decoded["one"].data[:3])) == (3, 2, [0, 10, 255]) and decoded["bad"].error == "image_read_failed"
    gray = I.gray_pixels(I.decode_images(spark, str(tmp_path))).collect()
    assert len(gray) == 6 and {r.gray for r in gray} == {round(0.114 * 0 + 0.587 * 10 + 0.299 * 255)}


def test_labelled_folder(spark, tmp_path):
    for label, name in (("blank", "part1/img1__I_001_A.png"), ("filled", "identity/img2__sbd_01_7.png")):
        (tmp_path / label / name).parent.mkdir(parents=True)
        (tmp_path / label / name).write_bytes(b"x")
    rows = {r.gt_label: r for r in I.labelled_folder(spark, str(tmp_path)).collect()}
    assert (rows["blank"].section, rows["blank"].image_id, rows["blank"].group_id, rows["blank"].choice, rows["blank"].field) == ("part1", "img1", "I_001", "A", "answer")
    assert (rows["filled"].field, rows["filled"].choice) == ("sbd", "7") and rows["filled"].split in ("train", "val", "test")
    with pytest.raises(FileNotFoundError):
        I.labelled_folder(spark, str(tmp_path), ["blank", "other"])


def test_csv_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1)], "image_id string, file_name string, extra int")
    O.write_csv(df, f"{tmp_path}/d", O.ERROR_COLUMNS)
    back = I.read_manifest(spark, f"{tmp_path}/d")
    assert back.columns == O.ERROR_COLUMNS and back.first().image_id == "a"
    lines = spark.createDataFrame([(2, "two"), (1, "one")], "n int, line string")
    O.write_lines(lines, f"{tmp_path}/r", ["n"])
    assert next((tmp_path / "r").glob("part-*")).read_text() == "one\ntwo\n"
    assert O.union_columns([df, lines]).columns == ["image_id", "file_name", "extra", "n", "line"]
    assert O.guarded_mode(False) == "errorifexists"
    meta = spark.createDataFrame([("a", "f.png", "train", "p")], "image_id string, file_name string, split string, relative_path string")
    sheets = spark.createDataFrame([("a", "ok", ""), ("b", "need_review", "")], "image_id string, sheet_status string, file_name string")
    (r,) = O.web_payload(sheets, meta, {"sheet_status": "overridden"}).collect()
    assert (r.file_name, r.split, r.sheet_status) == ("f.png", "train", "overridden")
    O.write_splits(meta, f"{tmp_path}/s")
    assert (tmp_path / "s" / "split=train").exists()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for sheet in ("s1", "s2"):
        rows = [dict(image_id=sheet, item_id="q", section="part1", spec_ord=k, choice=c, prelabel="blank", prelabel_source="adaptive_rule", fill_score=v, darkness_score=v, alignment_status="ok", alignment_confidence=1.0, arrived="2024-01-01 10:00:00") for k, (c, v) in enumerate((("A", 0.3), ("B", 0.01)))]
        (tmp_path / "in" / f"{sheet}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = A.arriving_bubbles(spark, f"{tmp_path}/in", 1)
    A.decode_arrivals(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = sorted((r.image_id, r.selected, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("s1", "A", "accepted"), ("s2", "A", "accepted")]
    assert A.arrivals_by_hour(stream).isStreaming and A.arriving_images(spark, f"{tmp_path}/in").isStreaming


def test_optional_documents_and_bases(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "extraction_result.json").write_text('{"ok": 3,\n "total": 4}')
    assert I.read_document_if_exists(spark, f"{tmp_path}/run/extraction_result.json", "ok int, total int").first().total == 4
    assert I.read_document_if_exists(spark, f"{tmp_path}/none.json", "ok int").count() == 0
    assert I.first_that_exists(spark, "extraction_result.json", f"{tmp_path}", f"{tmp_path}/run/", "/x") == f"{tmp_path}/run/extraction_result.json"
    assert I.first_that_exists(spark, "a.json", "/b", "/c/") == "/c/a.json" and I.first_that_exists(spark, "/abs/a", "/b") == "/abs/a"


def test_guarded_folder(spark, tmp_path):
    O.prepare_folder(spark, f"{tmp_path}/out", False)
    (tmp_path / "out" / "x").write_text("1")
    with pytest.raises(FileExistsError):
        O.prepare_folder(spark, f"{tmp_path}/out", False)
    O.prepare_folder(spark, f"{tmp_path}/out", True)
    assert list((tmp_path / "out").iterdir()) == []
