"""Command line: index, search, outline, chunk, batch, status, removal, tools over JSON-RPC."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import load
from .plans.session import CodeSearch
from .serve import http_server, log_to, serve_lines


def show(df: DataFrame) -> None:
    """Rows as JSON lines; results are few."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def shortened(text: str, most: int = 45) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def show_status(engine: CodeSearch) -> None:
    for name, value in engine.status().first().asDict().items():
        print(f"{name:<16} {value}")
    for r in engine.project_stats().orderBy("source_path").collect():  # a row for each configured path
        print(f"{shortened(r.source_path):<45} {r.files:>8,} {r.chunks:>9,}  {r.last_indexed or '-'}")


def confirmed(question: str) -> bool:
    return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("--settings", default="config/settings.json")
    p.add_argument("--store", default="data")
    p.add_argument("--index-only", action="store_true")
    p.add_argument("--status", action="store_true")
    p.add_argument("--remove", action="store_true", help="delete the store, after asking")
    p.add_argument("--yes", action="store_true", help="do not ask")
    p.add_argument("--serve", action="store_true", help="tools over JSON-RPC lines on standard input and output")
    p.add_argument("--http-port", type=int, help="tools over JSON-RPC posts on this port")
    p.add_argument("--debug-log", help="file for the tools' calls and results")
    p.add_argument("--search-code")
    p.add_argument("--get-file-outline")
    p.add_argument("--get-chunk")
    p.add_argument("--query-batch", action="store_true", help='JSON array of {"query", "top_k"} on standard input')
    p.add_argument("--top-k", type=int)
    p.add_argument("--language")
    p.add_argument("--symbol-type")
    p.add_argument("--project")
    a = p.parse_args(argv)
    engine = CodeSearch(SparkSession.builder.appName("lodeseek").getOrCreate(), a.store, load(a.settings))
    if a.debug_log:
        log_to(a.debug_log)
    if a.remove:
        if not a.yes and not confirmed(f"Delete all tables in {a.store}?"):
            raise SystemExit("nothing deleted")
        engine.store.reset()
    if a.index_only:
        show(engine.index())
    if a.status:
        show_status(engine)
    if a.search_code:
        show(engine.search(a.search_code, a.top_k, a.language, a.symbol_type, a.project))
    if a.get_file_outline:
        show(engine.outline(a.get_file_outline))
    if a.get_chunk:
        show(engine.get_chunk(a.get_chunk))
    if a.query_batch:
        rows = [(i, q["query"], q.get("top_k")) for i, q in enumerate(json.load(sys.stdin))]
        show(engine.query_batch(engine.spark.createDataFrame(rows, "query_id int, query string, top_k int")))
    if a.http_port:
        http_server(engine, a.http_port).serve_forever()
    elif a.serve:
        serve_lines(engine)


if __name__ == "__main__":
    main()
