"""Papers from page tables end to end, on small papers set glyph by glyph."""

import dataclasses
import json

import numpy as np
import pytest

from foliospark.__main__ import main
from foliospark.functions import pixels as px
from foliospark.operators import convert as cv
from foliospark.operators import figures as fg

BOX = "x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "papers": "paper_id string, file string, ocr boolean", "pages": "paper_id string, page int, width double, height double, png binary, dark double",
    "lines": f"paper_id string, page int, n int, text string, {BOX}, size double, first_text string, first_x0 double, first_y0 double, first_x1 double, first_y1 double, first_bold boolean",
    "glyphs": f"paper_id string, page int, gid int, {BOX}, base double, size double, ch string, raw string, font string, bold boolean, italic boolean, math_font boolean, known boolean, ocr boolean, space_before boolean",
    "bars": "paper_id string, page int, x0 double, x1 double, y double", "graphics": f"paper_id string, page int, {BOX}", "images": f"paper_id string, page int, {BOX}",
}


def picture(boxes):
    grey = np.full((round(400 * fg.ZOOM), round(300 * fg.ZOOM)), 255, np.uint8)
    for x0, y0, x1, y1 in boxes:
        grey[round(y0 * fg.ZOOM) : round(y1 * fg.ZOOM), round(x0 * fg.ZOOM) : round(x1 * fg.ZOOM)] = 0
    return px.encode(grey)


class Printer:
    """Sets text at x, y: glyphs 5 wide, 10 high, a space is a gap of 5."""

    def __init__(self):
        self.rows = {name: [] for name in SCHEMAS}

    def paper(self, paper, n_pages, drawings=None):
        self.rows["papers"].append((paper, f"dir/{paper}.pdf", False))
        for page in range(1, n_pages + 1):
            boxes = (drawings or {}).get(page, [])
            self.rows["pages"].append((paper, page, 300.0, 400.0, picture(boxes), 0.01))
            self.rows["graphics"] += [(paper, page, *b) for b in boxes]

    def text(self, paper, page, x, y, said, size=10.0, line=True, bold=False):
        first, x, y = said.split(" ")[0], float(x), float(y)
        if line:
            n = len(self.rows["lines"])
            self.rows["lines"].append((paper, page, n, said, x, y - 7, x + 5.0 * len(said), y + 2, size, first, x, y - 7, x + 5.0 * len(first), y + 2, bold))
        for i, ch in enumerate(said):
            if ch != " ":
                at, before = x + 5.0 * i * size / 10, i > 0 and said[i - 1] == " "
                self.rows["glyphs"].append((paper, page, len(self.rows["glyphs"]), at, y - 0.7 * size, at + 0.5 * size, y + 0.2 * size, y, size, ch, ch, "F", bold, False, False, True, False, before))

    def layer(self, spark):
        return cv.Layer(**{name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in self.rows.items()})


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    p = Printer()
    p.paper("one", 3, {3: [(120.0, 100.0, 160.0, 140.0)]})
    p.text("one", 1, 50, 60, "Spring Set", 20.0)
    p.text("one", 1, 50, 90, "Paper 2 of 2001")
    p.text("one", 1, 50, 110, "Time: 60 minutes. There are 2 questions")
    p.text("one", 2, 30, 50, "1 Find the value of", bold=False)
    p.text("one", 2, 50, 66, "1")  # a fraction: 1 over 2
    p.text("one", 2, 50, 82, "2")
    p.rows["bars"].append(("one", 2, 48.0, 57.0, 72.0))
    for i, said in enumerate(["A 10", "B 11", "C ten"]):
        p.text("one", 2, 50, 120 + 16 * i, said)
    p.text("one", 2, 50, 300, "END OF TEST")
    p.text("one", 3, 30, 50, "2 2. What does the diagram show?")
    for i, said in enumerate(["A a line", "B a box"]):
        p.text("one", 3, 50, 170 + 16 * i, said)
    p.paper("two", 1)
    p.paper("three", 1)
    p.text("three", 1, 50, 60, "Only words here")
    layer = p.layer(spark)
    folder = tmp_path_factory.mktemp("layer")
    for f in dataclasses.fields(layer):
        getattr(layer, f.name).write.parquet(f"{folder}/{f.name}.parquet")
    result = cv.convert(layer)
    return {"folder": folder} | {name: [r.asDict(recursive=True) for r in getattr(result, name).collect()] for name in ("questions", "papers", "issues", "reports", "failures")}


def test_paper(done):
    assert [(r["paper_id"], r["file_name"]) for r in done["papers"]] == [("one", "Spring_Set_Paper_2.json")]
    paper = json.loads(done["papers"][0]["json"])
    assert (paper["id"], paper["title"], paper["paper"], paper["year"], paper["durationMinutes"]) == ("spring-set-paper-2", "Spring Set", "Paper 2", "2001", 60)
    one, two = paper["questions"]
    assert one["stem"].startswith("Find the value of") and "\\frac{1}{2}" in one["stem"]
    assert one["options"] == [{"label": "A", "content": "$10$"}, {"label": "B", "content": "$11$"}, {"label": "C", "content": "ten"}]
    assert two["stem"] == "What does the diagram show?" and [o["content"] for o in two["options"]] == ["a line", "a box"]
    assert (one["sourcePage"], two["sourcePage"], one["images"]) == (2, 3, [])
    assert len(two["images"]) == 1 and two["images"][0]["src"].startswith("data:image/png;base64,") and two["images"][0]["alt"] == "Diagram for question 2, cropped from page 3 of the paper"
    assert [i for i in done["issues"] if i["level"] == "error"] == []
    assert not any(q["needsReview"] for q in paper["questions"]), done["questions"]


def test_report_and_failures(done):
    assert {r["paper_id"]: r["error"] for r in done["failures"]} == {"two": "no text could be read", "three": "no questions were found"}
    report = json.loads(done["reports"][0]["json"])
    assert done["reports"][0]["file_name"] == "Spring_Set_Paper_2.report.json"
    assert (report["questionCount"], report["flagged"], report["errors"], report["ok"], report["notes"]) == (2, 0, 0, True, [])
    assert [d["sourcePage"] for d in report["detail"]] == [2, 3] and report["detail"][0]["regions"][0]["page"] == 2


def test_command(spark, done, tmp_path, capsys):
    assert main(["convert", str(done["folder"]), str(tmp_path), "--title", "Mine"], spark) == 1
    out = capsys.readouterr().out
    assert "two: no text could be read" in out and "1 papers, 2 failures, 0 errors, 0 questions to review" in out
    written = [p.read_text() for p in (tmp_path / "papers" / "file_name=Mine_Paper_2.json").glob("part-*")]
    assert json.loads("".join(written))["title"] == "Mine"
    assert [*(tmp_path / "reports" / "file_name=Mine_Paper_2.report.json").glob("part-*")]
