"""The command line: ``python -m veristrata.plans.cli <verb>``; exit codes 0 (good), 1 (failed), 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

VERBS = ("init", "parse", "schema", "audit", "migrate", "doctor", "completion", "version")
CONFIG = "provider: canned\nmodel: none\noutput: runs\n"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("veristrata").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veristrata")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init").add_argument("folder", nargs="?", default=".")
    parse = verbs.add_parser("parse")
    parse.add_argument("path", nargs="+")
    parse.add_argument("--out")
    schema = verbs.add_parser("schema")
    schema.add_argument("path")
    audit = verbs.add_parser("audit")
    audit.add_argument("path")
    migrate = verbs.add_parser("migrate")
    migrate.add_argument("model")
    migrate.add_argument("--out")
    migrate.add_argument("--check", action="store_true")
    verbs.add_parser("doctor")
    verbs.add_parser("completion").add_argument("shell", choices=("bash", "zsh", "fish"))
    verbs.add_parser("version")
    return p


def completion_script(shell: str) -> str:
    words = " ".join(VERBS)
    return {"bash": f"complete -W '{words}' veristrata", "zsh": f"compdef '_arguments \"1:verb:({words})\"' veristrata", "fish": f"complete -c veristrata -n __fish_use_subcommand -a '{words}'"}[shell]


def doctor() -> list[tuple[str, bool, str]]:
    """Checks of the environment: name, outcome, detail."""
    import importlib.util
    import shutil

    found = [(m, importlib.util.find_spec(m) is not None, "importable" if importlib.util.find_spec(m) else "missing") for m in ("pyspark", "pandas", "pyarrow", "numpy")]
    return [("python", sys.version_info >= (3, 10), sys.version.split()[0]), *found, ("java", shutil.which("java") is not None, shutil.which("java") or "not on the path")]


def run(argv: list[str], out=print) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return _done(args, out)
    except (OSError, ValueError, AttributeError, ImportError) as e:
        out(str(e))
        return 1


def _done(args, out) -> int:
    from veristrata.functions import json_schema

    if args.verb == "init":
        target = Path(args.folder) / "veristrata.yml"
        if target.exists():
            raise ValueError(f"{target} is already there")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(CONFIG)
        out(f"wrote {target}")
    elif args.verb == "parse":
        from veristrata.sources import files

        sections = files.read_listed(_session(), args.path)
        if args.out:
            sections.write.mode("errorifexists").json(args.out)
        else:
            for row in sections.toJSON().toLocalIterator():
                out(row)
        return 1 if sections.where("error_code is not null").head(1) else 0
    elif args.verb == "schema":
        schema = json_schema.load(Path(args.path))
        out(json.dumps(json_schema.summary(schema)))
        return 1 if json_schema.compatibility(schema) else 0
    elif args.verb == "audit":
        out(json.dumps(json.loads(Path(args.path).read_text(encoding="utf-8")), indent=2))
    elif args.verb == "migrate":
        from veristrata.plans import completion

        text = completion.schema_of_model(args.model)
        problems = json_schema.compatibility(json.loads(text)) if args.check else []
        if problems:
            raise ValueError("; ".join(problems))
        if args.out:
            Path(args.out).parent.mkdir(parents=True, exist_ok=True)
            Path(args.out).write_text(text, encoding="utf-8")
        else:
            out(text)
    elif args.verb == "doctor":
        checks = doctor()
        for name, good, detail in checks:
            out(f"{'ok' if good else 'missing'} {name}: {detail}")
        return 0 if all(c[1] for c in checks) else 1
    elif args.verb == "completion":
        out(completion_script(args.shell))
    else:
        from importlib.metadata import PackageNotFoundError, version

        try:
            out(version("veristrata"))
        except PackageNotFoundError:
            out("0.2")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
