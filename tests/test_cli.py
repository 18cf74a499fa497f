"""The command line: listings, standard input and output, exit codes."""

import io
import json
import sys
from types import SimpleNamespace

from quern import __main__ as cli
from quern.plans.catalogue import edges


def run(capsys, *args, given=b"", monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(given)))
    code = cli.main(list(args))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_listings(capsys):
    assert run(capsys, "version")[:2] == (0, cli.VERSION + "\n")
    lines = run(capsys, "paths", "--json")[1].splitlines()
    first = json.loads(lines[0])
    assert set(first) == {"from", "to", "fidelity", "path", "losses"} and len(lines) == len(run(capsys, "paths")[1].splitlines())
    assert run(capsys, "paths", "--markdown")[1].splitlines()[1] == "| --- | --- | --- | --- |"
    assert {x.split("\t")[0] for x in run(capsys, "formats")[1].splitlines()} >= {e[1] for e in edges()}


def test_check_says_what_may_be_lost(capsys):
    code, out, _ = run(capsys, "check", "docx", "text")
    assert code == 0 and out.splitlines()[0].split("\t")[:2] == ["docx-to-text", "lossy"] and out.splitlines()[1].startswith("docx-to-text: ")
    assert run(capsys, "check", "z64", "csv")[0] == 3 and run(capsys, "check", "csv", "csv")[0] == 1


def test_standard_input_and_output(capsys, monkeypatch, tmp_path):
    target = tmp_path / "out.yaml"
    assert run(capsys, "convert", "-", str(target), "--from", "json", given=b'{"a":[1]}', monkeypatch=monkeypatch)[0] == 0
    assert target.read_bytes() == b"a:\n  - 1\n"
    assert run(capsys, "convert", "-", str(target), "--from", "json", given=b"{", monkeypatch=monkeypatch)[0] == 1
    assert run(capsys, "convert", "-", "-", given=b"{}", monkeypatch=monkeypatch)[0] == 4


def test_options_of_no_account(capsys, tmp_path):
    source = tmp_path / "a.json"
    source.write_text("{}")
    assert run(capsys, "convert", str(source), str(tmp_path / "a.yaml"), "--quality", "9")[0] == 0
    code, _, err = run(capsys, "convert", str(source), str(tmp_path / "a.yaml"), "--quality", "9", "--strict")
    assert code == 4 and "--quality" in err
