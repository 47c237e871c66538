"""Command line: run, validate, explain and convert."""

from __future__ import annotations

import argparse
import sys

from anchorline.plans.convert import WorkflowConverter
from anchorline.plans.pipeline import Pipeline


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="anchorline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "run a pipeline"), ("validate", "check a pipeline"), ("explain", "print the plans of a pipeline's steps")):
        sub.add_parser(name, help=text).add_argument("pipeline")
    c = sub.add_parser("convert", help="convert a workflow file to a pipeline")
    c.add_argument("source")
    c.add_argument("-o", "--output")
    c.add_argument("--dry-run", action="store_true", help="print, write nothing")
    c.add_argument("--summary", action="store_true")
    c.add_argument("-v", "--verbose", action="store_true")
    args = p.parse_args(argv)
    try:
        if args.command == "convert":
            made = WorkflowConverter(args.source)
            if args.summary or args.verbose:
                print(made.summary())
            if args.verbose:
                print("\n".join(made.warnings))
            if args.dry_run or (not args.output and not args.summary):
                print(made.to_yaml())
            elif args.output:
                print(made.save(args.output))
            return 0
        pipe = Pipeline(args.pipeline)
        if found := pipe.validate():
            print("\n".join(found), file=sys.stderr)
            return 1
        if args.command == "validate":
            print(f"{pipe.name}: {len(pipe.spec.steps)} steps, no problems")
        elif args.command == "run":
            for m in pipe.run():
                print(f"{m['step_id']}: {m['status']}, {m['duration_s']:.3f} s, rows {m['output_rows']}")
        else:
            for s in pipe.spec.steps:
                if s.tool.startswith("InOut.output") or s.tool == "InOut.browse":
                    continue
                pipe.state[s.id] = out = pipe._call(s)
                for df in out if isinstance(out, tuple) else (out,):
                    if df is not None:
                        print(f"== {s.id}")
                        df.explain("formatted")
        return 0
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
