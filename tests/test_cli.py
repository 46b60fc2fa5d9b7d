"""The commands end to end with a model and answers put in their place."""

from __future__ import annotations

from quillspark import cli


def test_convert_review_summary(spark, tmp_path):
    out = f"file://{tmp_path}/run"

    def model(image, prompt):
        if image == b"mute":
            return ""
        return '{"marks": []}' if prompt == cli.PROMPTS["inventory"] else image.decode()

    pages = spark.createDataFrame([(1, bytearray(b"fine")), (2, bytearray(b"a $ b")), (3, bytearray(b"mute"))], "page int, image binary")
    said: list[str] = []
    assert cli.convert(spark, pages, out, model, say=said.append) == 1
    assert [x.split()[2] for x in said[:3]] == ["?", "FAIL", "ERROR"]
    assert spark.read.text(f"{out}/chapter.tex").where("value like '%PAGE 2 MISSING%'").count() == 1
    said.clear()
    assert cli.convert(spark, pages, out, lambda i, p: "now", resume=True, say=said.append) == 0
    assert [x.split()[1] for x in said if x.startswith("page")] == ["3"]

    answers = spark.createDataFrame([(2, 1, "k", 1.5, None, None, None)], "page int, group_no int, key string, seconds double, reason string, after string, crop_ok boolean")
    said.clear()
    assert cli.review(spark, out, answers, say=said.append) == 0
    assert said[0].startswith("1 decision(s) covering 1 finding(s)")
    said.clear()
    cli.review(spark, out, answers, say=said.append)
    assert "already decided" in said[0]
    assert cli.review(spark, f"{out}-none", answers, say=said.append) == 2 and cli.summary(spark, f"{out}-none", say=said.append) == 0
    assert [cli.page_range(s) for s in (None, "4", "3-9")] == [(1, None), (4, 4), (3, 9)]
