"""Command line: run programs over files once or as they grow, check programs, or write them anew."""

from __future__ import annotations

import argparse
import signal
import socket
import sys
import threading

from .lang.checker import MAX_DEPTH, MAX_PATTERN, compile_program
from .lang.lexer import ProgramError
from .lang.parser import dot, dump, parse, unparse
from .sources.lines import from_stdin, load_programs, read_lines


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="metricloom")
    p.add_argument("--progs", required=True, help="a program file, or a folder of them")
    p.add_argument("--logs", action="append", default=[], help="glob pattern, or - for standard input; may be repeated")
    p.add_argument("--ignore-filename-regex-pattern", default=None)
    p.add_argument("--format", default="json", choices=["json", "json-list", "prometheus", "varz", "graphite", "statsd", "collectd"])
    p.add_argument("--compile-only", action="store_true")
    p.add_argument("--dump-ast", action="store_true")
    p.add_argument("--dump-graph", action="store_true", help="print the programs as Graphviz text")
    p.add_argument("--serve", default=None, metavar="HOST:PORT", help="after the run, offer the metrics by HTTP until interrupted")
    p.add_argument("--follow", action="store_true", help="go on reading the files as they grow, until interrupted; programs are read again on SIGHUP")
    p.add_argument("--store", default=None, metavar="FOLDER", help="with --follow: where the store and the stream's state are kept")
    p.add_argument("--poll-interval", type=float, default=0.25, metavar="SECONDS")
    p.add_argument("--gc-interval", type=float, default=3600.0, metavar="SECONDS", help="between collections of expired metrics")
    p.add_argument("--push", action="append", default=[], metavar="FORMAT=ADDRESS", help="with --follow: graphite, statsd or collectd, to tcp://, udp:// or unix://; may be repeated")
    p.add_argument("--push-interval", type=float, default=60.0, metavar="SECONDS")
    p.add_argument("--rewrite", action="store_true", help="print the programs in their normal form")
    p.add_argument("--syslog-use-current-year", type=int, default=None, metavar="YEAR", help="year of times without one")
    p.add_argument("--override-timezone", default="UTC")
    p.add_argument("--omit-prog-label", action="store_true")
    p.add_argument("--emit-metric-timestamp", action="store_true")
    p.add_argument("--max-regexp-length", type=int, default=MAX_PATTERN)
    p.add_argument("--max-recursion-depth", type=int, default=MAX_DEPTH)
    return p


def follow(spark, a: argparse.Namespace, programs: dict[str, str], options):
    """The stream that keeps a store for growing files, and its running query."""
    from .sinks import text
    from .sources.tail import TailSource
    from .streaming.run import Pusher, StoreStream

    spark.dataSource.register(TailSource)
    forms = {"graphite": text.graphite, "statsd": text.statsd, "collectd": lambda s: text.collectd(s, socket.gethostname())}
    targets = [(address, forms[name]) for name, _, address in (x.partition("=") for x in a.push)]
    stream = StoreStream(spark, programs, f"{a.store}/store", options, Pusher(targets, a.push_interval) if targets else None, a.gc_interval)
    stream.follow(a.progs, signal.SIGHUP if threading.current_thread() is threading.main_thread() else None)
    source = spark.readStream.format("tail").option("path", ",".join(a.logs))
    if a.ignore_filename_regex_pattern:
        source = source.option("ignore", a.ignore_filename_regex_pattern)
    return stream, stream.start(source.load(), f"{a.store}/checkpoint", f"{max(1, round(a.poll_interval * 1000))} milliseconds")


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.follow and not (a.store and a.logs):
        print("--follow needs --store and --logs", file=sys.stderr)
        return 1
    programs = load_programs(a.progs)
    try:
        for name, text in programs.items():
            if a.rewrite:
                print(unparse(parse(text, name)), end="")
                continue
            checked = compile_program(text, name, a.max_regexp_length, a.max_recursion_depth)
            if a.dump_ast:
                print(dump(checked.body))
            if a.dump_graph:
                print(dot(checked.body))
    except ProgramError as why:
        print(why, file=sys.stderr)
        return 1
    if a.compile_only or a.dump_ast or a.dump_graph or a.rewrite:
        return 0
    from pyspark.sql import SparkSession

    from .api import Options, run
    from .sinks import text

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = Options(year=a.syslog_use_current_year, zone=a.override_timezone, max_pattern=a.max_regexp_length, max_depth=a.max_recursion_depth)
    if a.follow:
        stream, query = follow(spark, a, programs, options)
        if a.serve:
            from .sinks.pages import serve

            host, _, port = a.serve.rpartition(":")
            threading.Thread(target=serve(stream.latest, host or "127.0.0.1", int(port), programs).serve_forever, daemon=True).start()
        query.awaitTermination()
        return 0
    files = [p for p in a.logs if p not in ("-", "/dev/stdin")]
    lines = read_lines(spark, files, a.ignore_filename_regex_pattern) if files else None
    if len(files) < len(a.logs) or not files:
        typed = from_stdin(spark)
        lines = lines.unionByName(typed) if files else typed
    store = run(lines, programs, options).store
    if a.serve:
        from .sinks.pages import serve

        host, _, port = a.serve.rpartition(":")
        serve(store.cache(), host or "127.0.0.1", int(port), programs).serve_forever()
    if a.format == "json":
        print(text.json_by_name(store))
    elif a.format == "json-list":
        print(text.json_document(store))
    elif a.format == "collectd":
        print("".join(sorted(f"{r['line']}\n" for r in text.collectd(store, socket.gethostname()).collect())), end="")
    elif a.format == "prometheus":
        print(text.document(text.prometheus(store, not a.omit_prog_label, a.emit_metric_timestamp)), end="")
    else:
        print("".join(sorted(f"{r['line']}\n" for r in text.FORMATS[a.format](store).collect())), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
