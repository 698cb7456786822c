"""The store by HTTP: each page is made anew from the store when it is asked for."""

from __future__ import annotations

import html
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from . import text

PLAIN, JSON, HTML = "text/plain; version=0.0.4", "application/json", "text/html; charset=utf-8"


def _sorted(lines: DataFrame) -> str:
    return "".join(sorted(f"{r['line']}\n" for r in lines.collect()))


def page(store: DataFrame, path: str, programs: dict[str, str] | None = None) -> tuple[str, str] | None:
    """(kind, body) of a page, or None if there is none of that path."""
    if path == "/metrics":
        return PLAIN, text.document(text.prometheus(store))
    if path == "/json":
        return JSON, text.json_document(store)
    if path == "/varz":
        return PLAIN, _sorted(text.varz(store))
    if path == "/graphite":
        return PLAIN, _sorted(text.graphite(store))
    if path == "/":
        links = "".join(f'<li><a href="{x}">{x}</a></li>' for x in ("/metrics", "/json", "/varz", "/graphite", "/programs"))
        return HTML, f"<h1>metricloom</h1><ul>{links}</ul><p>{store.count()} cells</p>"
    if path == "/programs":
        return HTML, "".join(f"<h2>{html.escape(name)}</h2><pre>{html.escape(source)}</pre>" for name, source in sorted((programs or {}).items()))
    return None


def serve(store: DataFrame | Callable[[], DataFrame | None], host: str = "127.0.0.1", port: int = 3903, programs: dict[str, str] | None = None) -> ThreadingHTTPServer:
    """A server of these pages, not yet running: call serve_forever, or run it in a thread.

    store: one, or what gives the latest (a stream's; with None there is none yet)."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            now = store() if callable(store) else store
            found = page(now, self.path.partition("?")[0], programs) if now is not None else None
            kind, body = found or (PLAIN, "not found\n" if now is not None else "no batch has ended yet\n")
            raw = body.encode("utf-8")
            self.send_response(200 if found else 404 if now is not None else 503)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
