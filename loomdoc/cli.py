"""``python -m loomdoc``: conversion of files and the speaker catalog from a shell.

Every command builds the frames of the library and writes or prints its result; files are read by Spark, so a path may be a
folder, a pattern or an address of any file system that the session knows.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomdoc
from loomdoc.functions import meta, text
from loomdoc.functions.front import front
from loomdoc.operators import catalog, models, render
from loomdoc.session import local_session
from loomdoc.sources.converters import convert, files
from loomdoc.sources.sinks import write_files

#: Suffixes of each converter, from the table of suffixes.
TOOLS = {t: tuple(s for s, u in meta.CONVERTERS.items() if u == t) for t in dict.fromkeys(meta.CONVERTERS.values())}
#: Modules that converters need beside the standard library.
NEEDS = {"data": ("yaml",), "doc": (), "img": (), "yt": ()}


def missing(tool: str) -> list[str]:
    """Modules of a converter that are not installed."""
    return [m for m in NEEDS.get(tool, ()) if importlib.util.find_spec(m) is None]


def report(rows: Sequence[Sequence[object]], heads: Sequence[str], as_json: bool) -> str:
    """Rows as a listing of fixed width or as JSON."""
    if as_json:
        return json.dumps([dict(zip(heads, r, strict=True)) for r in rows], ensure_ascii=False, indent=2, default=str)
    cells = [list(heads), *([str(v) if v is not None else "-" for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(heads))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def outputs(docs: DataFrame, style: str) -> DataFrame:
    """``name, content`` of the files that converted documents are written to."""
    return docs.where("error is null").select(F.concat(text.stem(F.col("source")), F.lit(f".{style}")).alias("name"), "content")


def picked(envelope: str, fields: str | None) -> str:
    """A JSON envelope cut to the dotted ``fields``, null where it has none of that name."""
    if not fields:
        return envelope
    whole, out = json.loads(envelope), {}
    for path in (p.strip().split(".") for p in fields.split(",")):
        at, to = whole, out
        for p in path[:-1]:
            at = at.get(p) if isinstance(at, dict) else None
            to = to.setdefault(p, {})
        to[path[-1]] = at.get(path[-1]) if isinstance(at, dict) else None
    return json.dumps(out, ensure_ascii=False)


def run_convert(spark: SparkSession, a: argparse.Namespace) -> int:
    found = files(spark, a.path, a.pattern)
    if a.tool:
        found = found.where(F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)).isin(*TOOLS[a.tool]))
    docs = convert(found, style="txt" if a.format == "txt" else "md" if a.format == "md" and not a.json else "body", max_rows=a.max_rows, max_col_width=a.max_col_width, fetched_at=a.fetched_at)
    if a.json:  # one envelope a line
        for r in docs.toLocalIterator():
            body = {"frontmatter": json.loads(r.frontmatter or "null"), "content": r.content, "source": r.source, "converter": r.converter}
            print(r.error if r.error else picked(json.dumps(body, ensure_ascii=False), a.fields), file=sys.stderr if r.error else sys.stdout)
        return 0
    write_files(outputs(docs, a.format), a.out, "name", "content", mounted=a.mounted)
    bad = docs.where("error is not null").select("source", "error").limit(20).collect()
    for r in bad:
        print(f"{r.source}: {r.error}", file=sys.stderr)
    return 1 if bad else 0


def run_speaker(spark: SparkSession, a: argparse.Namespace) -> int:
    c = catalog.Catalog.open(spark, a.catalog)
    if a.do in ("list", "stats", "gallery", "show", "groups"):
        if a.do == "list":
            heads, df = ("name", "enrollment_count", "meeting_count", "last_seen"), c.speakers().select("name", "enrollment_count", "meeting_count", F.substring("last_seen_at", 1, 10))
        elif a.do == "stats":
            heads, df = ("name", "enrollment_count", "mean_distance", "std_distance"), c.speaker(a.name).select("name", "enrollment_count", "mean_distance", "std_distance")
        elif a.do == "gallery":
            mine = c.frames["enrollments"].join(c.speaker(a.name).select(F.col("id").alias("speaker_id")), "speaker_id", "left_semi")
            heads, df = ("id", "source_file", "source_type", "confidence", "created_at"), mine.orderBy(F.desc("created_at"), "id").select("id", "source_file", "source_type", "confidence", "created_at")
        elif a.do == "show":
            heads, df = ("name", "added_at"), c.members(a.name)
        else:
            heads, df = ("name", "members"), c.groups()
        print(report([tuple(r) for r in df.limit(a.limit).collect()], heads, a.json))
        return 0
    at = a.at or spark.range(1).select(catalog.now_iso().alias("t")).first().t
    new = lambda: spark.range(1).select(catalog.new_id().alias("i")).first().i
    change = {
        "add": lambda: c.add_speaker(a.name, at, new()), "remove": lambda: c.remove_speaker(a.name), "merge": lambda: c.merge(a.name, a.other, at, a.reason), "prune": lambda: c.pruned(at, a.keep),
        "group-create": lambda: c.create_group(a.name, at, new()), "group-delete": lambda: c.delete_group(a.name), "group-add": lambda: c.add_member(a.name, a.other, at), "group-remove": lambda: c.remove_member(a.name, a.other),
        "enroll": lambda: c.enroll(spark.read.parquet(a.rows).withColumn("speaker_id", F.lit(c._id(c.speaker(a.name), a.name))), at),
    }
    change[a.do]().save(a.out or f"{a.catalog.rstrip('/')}-{at.replace(':', '')}")
    return 0


def run_deps(_: SparkSession | None, a: argparse.Namespace) -> int:
    print(report([(t, " ".join(TOOLS[t]), " ".join(missing(t)) or "ready") for t in TOOLS], ("converter", "suffixes", "state"), a.json))
    return 0


def run_completion(_: SparkSession | None, a: argparse.Namespace) -> int:
    """Completion of commands for bash, zsh or fish."""
    words = " ".join(sorted(COMMANDS))
    print({
        "bash": f'complete -W "{words}" loomdoc', "zsh": f"#compdef loomdoc\n_arguments '1:command:({words})'", "fish": "\n".join(f"complete -c loomdoc -n __fish_use_subcommand -a {w}" for w in words.split()),
    }[a.shell])
    return 0


def run_models(_: SparkSession | None, a: argparse.Namespace) -> int:
    print(report(sorted(models.ALIASES.items()), ("name", "model"), a.json))
    return 0


def run_front(_: SparkSession | None, a: argparse.Namespace) -> int:
    print(front(json.loads(a.fields_json)))
    return 0


COMMANDS = {"convert": run_convert, "speaker": run_speaker, "deps": run_deps, "completion": run_completion, "models": run_models, "front": run_front}
LOCAL = {"deps", "completion", "models", "front"}  # need no session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomdoc", description=loomdoc.__doc__)
    p.add_argument("--version", action="version", version=f"loomdoc {loomdoc.__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="files to documents")
    c.add_argument("path")
    c.add_argument("-o", "--out", default="out")
    c.add_argument("--tool", choices=sorted(TOOLS))
    c.add_argument("--pattern")
    c.add_argument("--format", choices=("md", "txt"), default="md")
    c.add_argument("--max-rows", type=int, default=500)
    c.add_argument("--max-col-width", type=int, default=0)
    c.add_argument("--fetched-at")
    c.add_argument("--fields")
    c.add_argument("--mounted", action="store_true")
    s = sub.add_parser("speaker", help="the speaker catalog")
    s.add_argument("do", choices="list stats gallery show groups add remove merge prune enroll group-create group-delete group-add group-remove".split())
    s.add_argument("name", nargs="?")
    s.add_argument("other", nargs="?")
    s.add_argument("--catalog", required=True)
    s.add_argument("--out")
    s.add_argument("--rows", help="parquet rows with id and embedding to enrol")
    s.add_argument("--reason")
    s.add_argument("--at")
    s.add_argument("--keep", type=int, default=20)
    s.add_argument("--limit", type=int, default=1000)
    sub.add_parser("deps", help="what converters need")
    k = sub.add_parser("completion")
    k.add_argument("shell", choices=("bash", "zsh", "fish"))
    sub.add_parser("models", help="names of speech models")
    f = sub.add_parser("front", help="frontmatter of JSON fields")
    f.add_argument("fields_json")
    for q in sub.choices.values():
        q.add_argument("--json", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; errors of the catalog and of paths are one JSON line on the error stream and exit code 1."""
    a = parser().parse_args(argv)
    try:
        return COMMANDS[a.command](None if a.command in LOCAL else spark or SparkSession.getActiveSession() or local_session(name="loomdoc"), a)
    except ValueError as e:
        print(json.dumps({"code": "INVALID_INPUT", "message": str(e), "recoverable": False}), file=sys.stderr)
        return 1


__all__ = ["main", "parser", "picked", "render", "report"]
