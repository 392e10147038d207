"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from portico.sources import readers as R
from portico.sources import writers as W


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_gate_files(spark, tmp_path):
    cams = put(tmp_path, "c.json", json.dumps({"params_left": {"file_path": "a", "roi": [0, 5, 1, 9], "id": 0, "direction": "left"}, "params_front": {"file_path": "b", "roi": [0, 1, 2, 3], "id": 0, "direction": "front", "sleep_time": 0.5}}, indent=1))
    assert sorted((r["direction"], r["roi"][3], r["sleep_time"]) for r in R.read_cameras(spark, cams).collect()) == [("front", 3, 0.5), ("left", 9, None)]
    sizes = put(tmp_path, "s.csv", "code,description,length,height,group\n22G1,old,20,8.5,22GP\n22G1,new,20,8.5,22GP,\n45G1,high,40,x,45GP\n")
    got = {r["code"]: (r["description"], r["height"]) for r in R.read_size_types(spark, sizes, {"22G1": "o", "22K0": "tank"}).collect()}
    assert got == {"22G1": ("new", 8.5), "45G1": ("high", None), "22K0": ("tank", None)}
    assert [r["owner"] for r in R.read_owners(spark, put(tmp_path, "o.csv", "EISU,x\nABCD,y\nEVGU1,z\n")).collect()] == ["EISU"]
    assert sorted(tuple(r) for r in R.read_candidates(spark, put(tmp_path, "k.csv", "2CG, 2CG1\n4T6,42T6, 40T6\nempty\n")).collect()) == [("2CG", 0, "2CG1"), ("4T6", 0, "42T6"), ("4T6", 1, "40T6")]


def test_logs(spark, tmp_path):
    log = put(tmp_path, "l.txt", "2024-10-02 12:28:16,100 - LOGGER - INFO - top 36\n\n2024-10-02 12:28:15,100 - LOGGER - ERROR - outage\nTraceback\n  x\n")
    got = [(str(r["ts"]), r["level"], r["message"]) for r in R.read_app_log(spark, log).orderBy("record").collect()]
    assert got == [("2024-10-02 12:28:16.100000", "INFO", "top 36"), ("2024-10-02 12:28:15.100000", "ERROR", "outage\nTraceback\n  x")]
    # Many splits of one file, with lines that belong to records of the split before.
    lines = [f"2024-10-02 12:28:{k % 60:02d},{k % 1000:03d} - L - INFO - line {k}\n  more {k}\n" for k in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        many = R.read_app_log(spark, put(tmp_path, "many.txt", "".join(lines)))
        assert many.count() == 400 and [r["message"] for r in many.orderBy("record").collect()] == [f"line {k}\n  more {k}" for k in range(400)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["seconds"] for r in R.read_run_log(spark, put(tmp_path, "r.txt", "took 1.25 s\nnothing\n")).collect()] == [1.25, None]
    gpu = R.read_gpu_csv(spark, put(tmp_path, "g.csv", "t, n, p, d, P0, 4, 3, 60, 23, 50, 8192, 4096\nt, n, p, d, P0, 4, 3, [N/A], 1, 2, 100, 50\n")).collect()
    assert (gpu[0]["ratio"], gpu[0]["used"]) == (0.5, 4096.0) and gpu[1]["temperature"] != gpu[1]["temperature"]


def test_labels(spark, tmp_path):
    line = 'a.jpg\t[{"transcription": "X", "points": [[0,0],[1,0],[1,1],[0,1]], "score": 0.9}]\nb.jpg    [{"transcription": "Y", "points": []}]\n'
    assert sorted((r["image"], r["transcription"]) for r in R.read_ocr_labels(spark, put(tmp_path, "o.txt", line)).collect()) == [("a.jpg", "X"), ("b.jpg", "Y")]
    ev = R.read_evaluation(spark, put(tmp_path, "e.txt", "0\t0\t1\t0\t1\t1\t0\t1\t1\tABC\n0\t0\t1\t0\t1\t1\t0\t1\t0\nshort\n"), True).collect()
    assert [(r["ignore"], r["text"], len(r["quad"])) for r in ev] == [(True, "ABC", 8), (False, "", 8)]
    det = R.read_det_labels(spark, put(tmp_path, "d.txt", "1 0.5 0.5 0.2 0.1\n\n2 0 0 1 0 1 0.5 0 0.5\n")).orderBy("cls").collect()
    assert [(r["cls"], r["xc"], r["yc"], r["w"], r["h"]) for r in det] == [(1, 0.5, 0.5, 0.2, 0.1), (2, 0.5, 0.25, 1.0, 0.5)] and len(det[1]["points"]) == 4
    lm = R.read_landmark_labels(spark, put(tmp_path, "m.txt", "0 .5 .5 .2 .2 .1 .2 .3 .4 .5 .6 -1 -1\n")).first()
    assert lm["landmarks"][3] is None and lm["landmarks"][0]["y"] == 0.2


def test_imports(spark, tmp_path):
    voc = put(tmp_path, "v.xml", "<annotation><filename>a.jpg</filename><size><width>100</width><height>50</height></size><object><name>car</name><difficult>0</difficult><bndbox><xmin>11</xmin><ymin>11</ymin><xmax>31</xmax><ymax>21</ymax></bndbox></object><object><name>car</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>2</ymax></bndbox></object></annotation>")
    r = R.import_voc(spark, voc, ["bus", "car"]).collect()
    assert [(x["cls"], x["xc"], x["yc"], x["w"], x["h"]) for x in r] == [(1, 0.2, 0.3, 0.2, 0.2)]
    sizes = spark.createDataFrame([("p1", 100.0, 50.0)], "image string, width double, height double")
    vis = R.import_visdrone(spark, put(tmp_path, "vis/p1.txt", "10,10,20,10,1,4,0,0\n10,10,20,10,0,4,0,0\n"), sizes).collect()
    assert [(x["cls"], x["xc"], x["w"]) for x in vis] == [(3, 0.2, 0.2)]
    coco = {"images": [{"id": 7, "file_name": "c.jpg", "width": 100, "height": 50}], "categories": [{"id": 9, "name": "z"}, {"id": 2, "name": "a"}], "annotations": [{"image_id": 7, "category_id": 9, "iscrowd": 0, "bbox": [90, 0, 20, 10]}, {"image_id": 7, "category_id": 2, "iscrowd": 1, "bbox": [0, 0, 1, 1]}]}
    c = R.import_coco(spark, put(tmp_path, "c.json", json.dumps(coco))).collect()
    assert [(x["cls"], x["name"], round(x["w"], 6), round(x["xc"], 6)) for x in c] == [(1, "z", 0.1, 0.95)]
    geo = {"features": [{"properties": {"bounds_imcoords": "10,10,30,20", "image_id": "p1", "type_id": 11}}, {"properties": {"bounds_imcoords": "1,2", "image_id": "p1", "type_id": 11}}, {"properties": {"bounds_imcoords": "1,2,3,4", "image_id": "p1", "type_id": 99}}]}
    assert [(x["cls"], x["xc"]) for x in R.import_geojson(spark, put(tmp_path, "g.json", json.dumps(geo)), {11: 0}, sizes).collect()] == [(0, 0.2)]
    assert [x["h"] for x in R.import_pixel_csv(spark, put(tmp_path, "px.csv", "a,10,10,30,20,obj,100,50\n")).collect()] == [0.2]
    ev = R.read_evolve(spark, put(tmp_path, "e.csv", "  metrics/p,  map \n  0.5,  0.25\n"))
    assert ev.columns == ["metrics/p", "map"] and tuple(ev.first()) == (0.5, 0.25)
    table = "\n".join(json.dumps({"filename": str(n), "html": {"structure": {"tokens": ["t"] * n}, "cells": []}}) for n in (0, 2, 9))
    assert [x["filename"] for x in R.read_table_dataset(spark, put(tmp_path, "t.jsonl", table), 5).collect()] == ["2"]
    put(tmp_path, "img/a.JPG", "x"), put(tmp_path, "img/b.txt", "x")
    assert R.image_inventory(spark, str(tmp_path / "img")).count() == 1
    put(tmp_path, "none/b.txt", "x")
    with pytest.raises(ValueError, match="no images"):
        R.image_inventory(spark, str(tmp_path / "none"))
    wide = "f," + ",".join(f"c{k}" for k in range(3000))
    assert R.read_candidates(spark, put(tmp_path, "wide.csv", wide)).count() == 3000


def test_writers(spark, tmp_path):
    df = spark.sql("select timestamp'2024-10-02 12:00:00' ts, 'c1' channel, 'V0001' vehicle, 'f' front, cast(null as string) rear, 'l' left, 'r' right, 't' top, '1.2.3.4' ip, '241002' day, 'EISU200755522G1' code, 'double' load")
    assert df.select(W.pass_message()).first()[0] == "[C|20241002120000|c1|V0001|f||l|r|t|1.2.3.4|D]"
    assert df.select(W.ocr_record("code", "front", "rear", "load")).first()[0] == "EISU2007555 22G1\nf\ndouble"
    W.write_archive(df.unionByName(df.withColumn("rear", F.lit("x"))), str(tmp_path / "arc"))
    W.write_archive(df.withColumn("rear", F.lit("y")), str(tmp_path / "arc"))
    assert [r["rear"] for r in spark.read.parquet(str(tmp_path / "arc")).collect()] == ["y"]
    row = spark.sql("select 3 cls, 0.5 xc, 0.25 yc, 0.1 w, 0.2 h, 0.875 conf")
    assert row.select(W.label_row(), W.label_row(True)).first()[:] == ("3 0.500000 0.250000 0.100000 0.200000", "3 0.500000 0.250000 0.100000 0.200000 0.875000")
    items = spark.createDataFrame([("a", 1, "Y", [[0.0]]), ("a", 0, "X", [[1.0]])], "image string, item int, transcription string, points array<array<double>>")
    assert W.det_label_lines(items).first()[0] == 'a\t[{"transcription":"X","points":[[1.0]]},{"transcription":"Y","points":[[0.0]]}]'
    assert spark.sql("select 'p' i, ' a\"b ' t").select(W.rec_label_line("i", "t")).first()[0] == "p\tab"
