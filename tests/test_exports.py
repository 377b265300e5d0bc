"""Exports count what they leave out, and what they write can be read back."""

from quillspark.sources import exports

REGIONS = "split string, img_id string, region int, label string, text string, width int, height int"


def test_every_region_has_one_outcome(spark, tmp_path):
    rows = [
        ("train", "a.b.jpg", 1, "X", "ab  ba", 9, 4), ("train", "c", 12, "Y", "ab~", 1, 1), ("train", "c", 13, "Y", " ", 9, 9), ("train", "c", 14, "Y", None, 9, 9),
        ("val", "d.jpg", 1234, "Y", "a-b", 9, 3), ("val", "d.jpg", 2, "Y", "ab", None, 9), ("other", "e", 1, "X", "ab", 9, 9), (None, "e", 2, "X", "ab", 9, 9),
    ]
    tagged, counts = exports.export_samples(spark.createDataFrame(rows, REGIONS), "ab -", str(tmp_path / "out"), ["train", "val"])
    assert {k: v for k, v in counts.items() if v} == {"rows": 8, "other_splits": 2, "train/kept": 1, "train/skipped_out_of_vocab": 1, "train/skipped_empty_text": 2, "val/skipped_bad_crop": 2}
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "out" / "annotations")).collect()] == [("train/a.b_001.png\tab ba", "train")]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out" / "samples"), header=True).collect()] == [("train", "train/a.b_001.png", "a.b.jpg", "1", "X", "ab ba")]
    got = {(r["split"], r["kind"], r["name"]): r["n"] for r in exports.summary(tagged).collect()}
    assert got["train", "character", "~"] == 1 and got["train", "label", "X"] == 1 and got["val", "outcome", "skipped_bad_crop"] == 2


def test_nothing_to_export(spark, tmp_path):
    tagged, counts = exports.export_samples(spark.createDataFrame([], REGIONS), "ab", str(tmp_path / "out"), ["train"])
    assert tagged.count() == 0 and sum(counts.values()) == 0
