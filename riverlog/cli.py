"""Commands over a log store: ``python -m riverlog.cli --base URI [--database NAME] COMMAND ...``.

query TEXT [--skeleton] [--limit N] [--offset N]; import PATH --producer P; export TOPIC[=VERSION] ... [--start NS] [--end NS];
tail TOPIC ...; statrange TOPIC; statistics TOPIC FIELD NAME ...; available TOPIC; databases; topics; producers; tables; schema HASH;
delete PRODUCER TOPIC START_NS END_NS; truncate PRODUCER TOPIC [NS]. Rows are printed as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import RiverlogError
from .sources import mcap
from .sources.store import LogStore, databases
from .streaming.tail import tail

EVER = (1 << 63) - 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riverlog", description="Queries and changes of a log store.")
    top.add_argument("--base", required=True, help="URI of the folder that holds the databases")
    top.add_argument("--database", default="db")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x.rstrip("*?"), **({"nargs": x[-1]} if x[-1] in "*?" else {}))
        for x, kind in options.items():
            p.add_argument(f"--{x}", **({"action": "store_true"} if kind is bool else {"type": kind}))
        return p

    command("query", "text", skeleton=bool, limit=int, offset=int)
    command("import", "path", producer=str)
    command("export", "topics*", start=int, end=int)
    command("tail", "topics*", start=int, end=int, polls=int)
    command("statrange", "topic", start=int, end=int, granularity=int, producer=str)
    command("statistics", "topic", "field", "names*", start=int, end=int, granularity=int, producer=str)
    command("available", "topic")
    for name in ("databases", "topics", "producers", "tables"):
        command(name)
    command("schema", "hash")
    command("delete", "producer", "topic", "start_ns", "end_ns")
    command("truncate", "producer", "topic", "time_ns?")
    return top


def _lines(df: DataFrame) -> Iterable[str]:
    return df.toJSON().toLocalIterator()  # partition by partition, in order


def _versions(topics: list[str]) -> dict[str, int]:
    """``topic`` or ``topic=version``."""
    return {name: int(version or 0) for name, _, version in (t.partition("=") for t in topics)}


def run(spark: SparkSession, argv: list[str]) -> Iterable[str]:
    """The lines that a command prints."""
    a = parser().parse_args(argv)
    store = LogStore(spark, a.base, a.database)
    engine = Engine(spark, store)
    start, end = getattr(a, "start", None) or 0, getattr(a, "end", None) or EVER
    if a.command == "query":
        if a.skeleton or a.limit or a.offset or a.text.lstrip().startswith(("explain", "truncate")):
            return _lines(engine.query(a.text, a.limit or 0, a.offset or 0, a.skeleton))
        return (r["line"] for r in engine.json_lines(a.text).toLocalIterator())
    if a.command == "import":
        return [json.dumps(mcap.import_file(store, a.path, a.producer or "default"))]
    if a.command == "export":
        found, versions = store.export(_versions(a.topics), start, end)
        return [*(_lines(found) if found is not None else ()), json.dumps({"versions": versions})]
    if a.command == "tail":
        return (line for found in tail(store, list(_versions(a.topics)), _versions(a.topics), start, end, polls=a.polls) for line in _lines(found))
    if a.command == "statrange":
        return _lines(engine.statrange(a.topic, start, end, (a.granularity or 60) * 10**9, a.producer))
    if a.command == "statistics":
        return _lines(engine.statistics(a.topic, a.field, a.names, start, min(end, EVER // 10**9), a.granularity or 60, a.producer))
    if a.command == "available":
        return _lines(engine.available_statistics(a.topic))
    if a.command == "databases":
        return databases(spark, a.base)
    if a.command == "topics":
        return store.topics()
    if a.command == "producers":
        return _lines(store.producers())
    if a.command == "tables":
        return _lines(engine.tables())
    if a.command == "schema":
        return [json.dumps(store.schema(a.hash))]
    if a.command == "delete":
        return [json.dumps({"version": store.delete(a.producer, a.topic, int(a.start_ns), int(a.end_ns))})]
    return [json.dumps({"version": store.truncate(a.producer, a.topic, None if a.time_ns is None else int(a.time_ns))})]


def main() -> int:
    spark = SparkSession.builder.appName("riverlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:]):
            print(line)
    except RiverlogError as e:
        print(json.dumps({"error": type(e).__name__, "detail": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
