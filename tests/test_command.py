"""The command line on files of our own."""

import json

from foliospark.__main__ import main


def test_validate(spark, tmp_path, capsys):
    q = {"number": 1, "stem": "What?", "options": [{"label": "A", "content": "1"}], "images": [], "sourcePage": 2, "needsReview": False}
    good = {"formatVersion": 1, "id": "set-1", "title": "Set", "paper": "Paper 1", "year": "2001", "durationMinutes": 75, "questions": [q]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    assert main(["validate", str(tmp_path / "good.json")], spark) == 0 and "0 errors, 0 warnings" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text(json.dumps(good | {"questions": [q | {"number": 2, "stem": "cost $5"}]}))
    assert main(["validate", str(tmp_path / "*.json"), "--minutes", "60"], spark) == 1
    out = capsys.readouterr().out
    assert "error numbering: question 2" in out and "error dollar-balance: question 2 stem" in out and out.count("duration-mismatch") == 2 and "4 errors" in out
