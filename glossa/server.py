"""An engine over HTTP: JSON answers to GET and POST, and a client for them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlencode, urlsplit
from urllib.request import Request, urlopen

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from .engine import Engine, NotFound
from .operators.resolve import Step


def _settings(data: dict) -> dict:
    return {"errors": [int(k) for k in data.get("Errors") or ()], "resolvers": [Step(r["Name"], int(r.get("MemorySize", 10)), float(r.get("Threshold", 0.5))) for r in data.get("Resolvers") or ()]}


def answers(engine: Engine) -> dict[tuple[str, str], object]:
    """What each method and path does with its parameters (of a GET) or its body (of a POST)."""
    named = lambda p: (p.get("url", ""), int(p.get("id", 0)))

    def needed(p: dict, key: str) -> str:
        if not p.get(key):
            raise ValueError(f"{key} is missing")
        return p[key]

    def put(data: dict) -> list[dict]:
        settings = _settings(data)
        if data.get("Content"):
            return engine.put_text(data.get("URL", ""), data["Content"], data.get("ContentType") or "text/plain", **settings)
        if not data.get("Local"):
            raise ValueError("content is missing, and nothing is fetched")
        return engine.put_files(needed(data, "URL"), data.get("ContentType") or "text/plain", **settings)

    def flush(p: dict) -> dict:
        engine.flush()
        return {}

    return {
        ("GET", "/concept"): lambda p: engine.concept(*named(p)),
        ("GET", "/search"): lambda p: engine.search(needed(p, "q")),
        ("GET", "/parents"): lambda p: engine.parents(*named(p)),
        ("GET", "/predicates"): lambda p: engine.predicates(needed(p, "q")),
        ("GET", "/info"): lambda p: engine.info(*named(p)),
        ("GET", "/get"): lambda p: engine.get(needed(p, "q"), int(p.get("n", 0)), int(p.get("s", 0))),
        ("GET", "/ctx"): lambda p: engine.context(needed(p, "url"), *(int(p.get(k, 0)) for k in "ben")),
        ("GET", "/dump"): lambda p: engine.dump(needed(p, "url")),
        ("GET", "/flush"): flush,
        ("POST", "/put"): put,
    }


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server; serve_forever() runs it. One request is answered at a time: Spark spreads each of them."""
    known, lock = answers(engine), Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            status, body = self.reply(url.path, {k: v[0] for k, v in parse_qs(url.query).items()})
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def reply(self, path: str, parameters: dict) -> tuple[int, object]:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if path not in {p for _, p in known}:
                return 404, {"error": f"nothing at {path}"}
            if (self.command, path) not in known:
                return 405, {"error": f"{path} takes no {self.command}"}
            try:
                with lock:
                    return 201 if self.command == "POST" else 200, known[self.command, path](json.loads(body) if self.command == "POST" else parameters)
            except NotFound as e:
                return 404, {"error": str(e)}
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return 400, {"error": str(e)}
            except (PySparkException, Py4JJavaError) as e:
                return 400 if "USER_RAISED_EXCEPTION" in str(e) else 500, {"error": str(e).splitlines()[0]}

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    """Asks a server. resolvers: dicts of Name, MemorySize and Threshold."""

    def __init__(self, host: str, errors: list[int] | None = None, resolvers: list[dict] | None = None):
        self.host, self.settings = host.rstrip("/"), {"Errors": errors or [], "Resolvers": resolvers or []}

    def ask(self, path: str, **parameters) -> object:
        return self._read(Request(f"{self.host}/{path}?{urlencode(parameters)}"))

    def put(self, url: str, content: str = "", kind: str = "text/plain", local: bool = False) -> list[dict]:
        data = {"URL": url, "Content": content, "ContentType": kind, "Local": local, **self.settings}
        return self._read(Request(f"{self.host}/put", json.dumps(data).encode(), {"Content-Type": "application/json"}))

    @staticmethod
    def _read(request: Request) -> object:
        try:
            with urlopen(request) as got:
                return json.load(got)
        except HTTPError as e:
            raise NotFound(e.read().decode()) if e.code == 404 else ValueError(e.read().decode()) from e
