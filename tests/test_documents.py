"""Records of JSON documents, read in many blocks, against json.loads."""

import json
import random

import pytest

from kinspark.sources import scans
from kinspark.sources.documents import Reader, records

KIND = "struct<id:bigint,text:string,deep:struct<a:array<struct<b:string>>>,list:array<array<double>>>"


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda n: [spark.conf.set(x, n) for x in names]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def odd(r):
    return "".join(r.choice('ab"\\{}[],: \né/') for _ in range(r.randrange(12)))


def document(r, n):
    def one(i):
        return {"id": i, "text": odd(r), "deep": {"a": [{"b": odd(r)} for _ in range(r.randrange(3))]}, "list": [[r.random()] for _ in range(r.randrange(3))]}

    return {"info": {"images": [{"id": -1}], "x": odd(r)}, "licenses": [], "images": [one(i) for i in range(n)], "note": "images", odd(r) or "k": [[{"id": -2}]], "annotations": [one(1000 + i) for i in range(n)]}


@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_a_document_in_many_blocks(spark, tmp_path, small_splits, indent):
    r = random.Random(indent)
    for n, splits in ((0, ["100000"]), (1, ["37", "100000"]), (60, ["512"])):
        doc = document(r, n)
        path = str(tmp_path / f"{n}.json")
        with open(path, "w") as f:
            json.dump(doc, f, indent=indent, ensure_ascii=bool(n % 2))
            f.write("\n")
        for split in splits:
            small_splits(split)
            for section in ("images", "annotations", "licenses") if n == 1 else ("images", "none"):
                got = sorted((x.id, x.text, [y.b for y in x.deep.a], x["list"]) for x in records(spark, path, section, KIND).collect())
                assert got == [(x["id"], x["text"], [y["b"] for y in x["deep"]["a"]], x["list"]) for x in doc.get(section, [])]
    small_splits("256")
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20


def test_blocks_must_not_change_between_the_passes(spark, tmp_path, small_splits):
    path = str(tmp_path / "d.json")
    with open(path, "w") as f:
        json.dump(document(random.Random(1), 50), f)
    small_splits("300")
    found = records(spark, path, "images", KIND)
    small_splits("700")
    with pytest.raises(Exception, match="the sizes of splits have changed"):
        found.collect()


def test_reader_inside_strings():
    reader = Reader(inside=True)
    assert list(reader.feed('a } \\" b": {"k}": [1, "x\\\\"]}')) == [("{", 10), ("[", 17), ("]", 26), ("}", 27)] or reader.opened == ""
    assert not reader.inside and reader.closed == 0 and reader.keys == {1: "k}"}


def test_coco_of_many_blocks(spark, tmp_path, small_splits):
    path = str(tmp_path / "coco.json")
    images = [{"id": i, "license": 1, "file_name": f"p{i}}}.jpg", "height": 3, "width": 4} for i in range(40)]
    notes = [{"id": 1 + i, "image_id": (7 * i) % 40, "category_id": 1, "bbox": [1.0, 2, 3, 4], "area": 12, "segmentation": [[0, 1.5]], "iscrowd": 0, "keypoints": []} for i in range(80)]
    with open(path, "w") as f:
        json.dump({"info": {}, "images": images, "annotations": notes, "categories": [{"id": 1, "name": "ear"}]}, f)
    small_splits("400")
    got = {(x.id, x.image_id, x.file_name, x.area) for x in scans.coco_annotations(spark, path).collect()}
    assert got == {(n["id"], n["image_id"], f"p{n['image_id']}}}.jpg", 12.0) for n in notes}
    assert scans.coco_images(spark, path).count() == 40
