"""The web service: GET /health, POST /search, /ask and /ask/stream (server-sent events) over `answer.Api`."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lorekeep.plans.answer import Api


def handler_of(api: Api) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, payload: dict) -> None:
            body = json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path != "/health":
                return self._send(404, {"error": "unknown path"})
            return self._send(200, api.health())

        def do_POST(self) -> None:
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                question = asked["question"]
                options = {k: asked[k] for k in ("top_k", "profile", "decompose") if asked.get(k) is not None}
                if self.path == "/search":
                    return self._send(200, api.search(question, options.get("top_k")))
                if self.path == "/ask":
                    return self._send(200, api.ask(question, **options))
                if self.path != "/ask/stream":
                    return self._send(404, {"error": "unknown path"})
                events = api.ask_stream(question, **options)
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for e in events:
                    self.wfile.write(f"data: {json.dumps(e, ensure_ascii=False)}\n\n".encode())
            except (KeyError, TypeError, json.JSONDecodeError):
                self._send(422, {"error": "a JSON object with a question is needed"})
            except (ValueError, RuntimeError) as e:  # checks say their status first
                code, _, why = str(e).partition(": ")
                self._send(int(code) if code.isdigit() else 500, {"error": why or str(e)})
            return None

        def log_message(self, *args) -> None:
            """Quiet: the caller decides what is logged."""

    return Handler


def server(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but does not serve yet; call serve_forever."""
    return ThreadingHTTPServer((host, port), handler_of(api))
