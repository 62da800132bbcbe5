import json

from lexmill.__main__ import main


def test_file_to_json(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Hello world. This is a test.", encoding="utf-8")
    assert main(["-i", str(tmp_path / "a.txt"), "--compact"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["language"] == "en" and told["sentence_count"] == 2 and told["total_scenes"] == len(told["scenes"])
    assert main(["-i", str(tmp_path / "missing.txt")]) == 1


def test_blank_input(spark, monkeypatch, capsys):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("  \n"))
    assert main([]) == 1
