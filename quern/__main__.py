"""python -m quern formats | paths [--json | --markdown] | version | check SOURCE TARGET | convert FILE TO [--from F] [--via F] [--strict] [--sheet S] [--page N] [--delimiter D] [--quality Q]

A FILE or TO of - is the standard input or output, whose format --from or --to names.

Exit codes: 0 done, 1 error, 2 loss under --strict, 3 no path, 4 usage.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quern.operators.batch import part_stems
from quern.operators.convert import convert_bytes
from quern.plans import planner
from quern.plans.catalogue import edges, formats
from quern.sources.rows import Malformed, Report, Unsupported

VERSION = "0.2"


def _format_of(path: Path) -> str | None:
    extension = path.suffix.lower().lstrip(".")
    return next((f["id"] for f in sorted(formats(), key=lambda f: f["id"]) if extension in f["extensions"]), None)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quern", exit_on_error=False)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("formats")
    commands.add_parser("version")
    paths = commands.add_parser("paths")
    paths.add_argument("--json", action="store_true")
    paths.add_argument("--markdown", action="store_true")
    check = commands.add_parser("check")
    check.add_argument("source")
    check.add_argument("target")
    run = commands.add_parser("convert")
    run.add_argument("file", type=Path)
    run.add_argument("to", type=Path)
    run.add_argument("--from", dest="source")
    run.add_argument("--to", dest="target")
    for p in (check, run):
        p.add_argument("--via")
        p.add_argument("--strict", action="store_true")
    for option in ("sheet", "page", "delimiter", "quality"):
        run.add_argument(f"--{option}")
    try:
        a = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as e:
        print(e, file=sys.stderr)
        return 4
    try:
        if a.command == "formats":
            for f in formats():
                print(f"{f['id']}\t{f['category']}\t{f['name']}\t{','.join(f['extensions'])}\t{','.join(dict.fromkeys(f['read_options'] + f['write_options']))}")
        elif a.command == "version":
            print(VERSION)
        elif a.command == "paths":
            if a.markdown:
                print("| from | to | fidelity | path |\n| --- | --- | --- | --- |")
            for s in (f["id"] for f in formats()):
                for t, hops in sorted(planner._search(s, edges()).items()):
                    p = planner.Plan(hops)
                    row = s, t, p.worst, " ".join(h[0] for h in hops)
                    if a.json:
                        print(json.dumps({"from": s, "to": t, "fidelity": p.worst, "path": [h[0] for h in hops], "losses": p.loss_descriptions}))
                    else:
                        print(f"| {' | '.join(row)} |" if a.markdown else "\t".join(row))
        elif a.command == "check":
            p = planner.plan(a.source, a.target, a.via, a.strict)
            print(f"{' '.join(h[0] for h in p.hops)}\t{p.worst}\t{','.join(p.options)}")
            for text in p.loss_descriptions:
                print(text)
        else:
            source, target = a.source or _format_of(a.file), a.target or _format_of(a.to)
            if not source or not target:
                print("the format is unknown", file=sys.stderr)
                return 4
            p, report = planner.plan(source, target, a.via, a.strict), Report()
            options = {k: getattr(a, k) for k in ("sheet", "page", "delimiter", "quality") if getattr(a, k) is not None}
            unused = sorted(set(options) - set(p.options))
            for name in unused:
                print(f"--{name} is of no account on this path", file=sys.stderr)
            if unused and a.strict:
                return 4
            content = sys.stdin.buffer.read() if str(a.file) == "-" else a.file.read_bytes()
            parts = convert_bytes(content, [(h[1], h[2]) for h in p.hops], options, report)
            for line, column, text in report.losses:
                print(f"loss: {text}" + (f" (line {line}, column {column})" if line else ""), file=sys.stderr)
            if a.strict and report.losses:
                return 2
            if str(a.to) == "-":
                for _, body in parts:
                    sys.stdout.buffer.write(body)
                sys.stdout.flush()
            elif len(parts) == 1:
                a.to.write_bytes(parts[0][1])
            else:
                folder = a.to.with_suffix("")
                folder.mkdir(parents=True, exist_ok=True)
                for stem, (_, body) in zip(part_stems([n for n, _ in parts]), parts, strict=True):
                    (folder / f"{stem}{a.to.suffix}").write_bytes(body)
    except planner.NoPath as e:
        print(e, file=sys.stderr)
        return 3
    except (Malformed, Unsupported, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
