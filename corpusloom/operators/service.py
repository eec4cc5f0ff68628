"""The HTTP interface as a pure function from a request to a status and a JSON body, and a small server around it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from ..config import EVIDENCE_BYTES, EVIDENCE_RECORDS
from ..errors import RecordError, status_of
from ..functions.preview import formatted
from ..functions.textsplit import trim
from .engine import RecordEngine


class _Refused(Exception):
    def __init__(self, status: int, code: str, message: str) -> None:
        self.status, self.code, self.message = status, code, message


def _invalid(message: str) -> _Refused:
    return _Refused(400, "invalid_request", message)


def _number(value: str | None, name: str) -> int:
    if value is None or not (value.isascii() and value.isdigit()):
        raise _invalid(f"{name} must be a non-negative integer")
    return int(value)


class Service:
    """One corpus with its engine."""

    def __init__(self, corpus: str, engine: RecordEngine) -> None:
        self.corpus, self.engine = corpus, engine
        self._routes = {
            ("GET", "/local_data/corpus"): self._corpus,
            ("GET", "/local_data/status"): self._status,
            ("POST", "/local_data/search"): self._search,
            ("POST", "/local_data/findevidence"): self._find_evidence,
            ("GET", "/local_data"): self._record,
            ("GET", "/local_data/getevidence"): self._get_evidence,
        }

    @property
    def is_prepared(self) -> bool:
        return self.engine.is_prepared

    def handle(self, method: str, url: str, body: bytes = b"") -> tuple[int, dict]:
        """Status and body of the answer."""
        status, answer = self._answer(method, url, body)
        return status, {k: list(v) if isinstance(v, Iterator) else v for k, v in answer.items()}

    def respond(self, method: str, url: str, body: bytes = b"") -> tuple[int, Iterator[bytes]]:
        """The same with the body as JSON in pieces, so results without a limit pass through one at a time."""
        status, answer = self._answer(method, url, body)
        return status, _pieces(answer)

    def _answer(self, method: str, url: str, body: bytes) -> tuple[int, dict]:
        parts = urlsplit(url)
        route = self._routes.get((method, parts.path))
        try:
            if route is None:
                raise _Refused(404, "not_found", "unknown endpoint")
            query: dict[str, str] = {}
            for name, value in parse_qsl(parts.query, keep_blank_values=True):
                query.setdefault(name, value)
            return 200, route(query, body)
        except _Refused as e:
            return e.status, {"error": {"code": e.code, "message": e.message}}
        except RecordError as e:
            status, code = status_of(e)
            return status, {"error": {"code": code, "message": str(e)}}

    def _known(self, corpus: str | None) -> None:
        if corpus is None:
            raise _invalid("corpus is required")
        if corpus != self.corpus:
            raise _Refused(404, "corpus_not_found", f"unknown corpus {corpus}")

    def _asked(self, query: str | None) -> str:
        if query is None:
            raise _invalid("query is required")
        if not trim(query):
            raise _Refused(400, "invalid_query", "query must not be empty")
        return query

    def _body(self, body: bytes, numbers: tuple[str, ...]) -> dict:
        try:
            value = json.loads(body)
        except ValueError as e:
            raise _invalid(f"invalid JSON body: {e}") from e
        if not isinstance(value, dict) or any(not isinstance(value.get(k), str) for k in ("corpus", "query")):
            raise _invalid("corpus and query are required")
        for k in numbers:
            v = value.get(k)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise _invalid(f"{k} must be a non-negative integer")
        return value

    def _corpus(self, query: dict, body: bytes) -> dict:
        return {"corpus": self.corpus}

    def _status(self, query: dict, body: bytes) -> dict:
        self._known(query.get("corpus"))
        return {"corpus": self.corpus, "prepared": self.is_prepared}

    def _search(self, query: dict, body: bytes) -> dict:
        asked = self._body(body, ("limit",))
        self._known(asked["corpus"])
        text = self._asked(asked["query"])
        rows = self.engine.search_previews(text, asked.get("limit")).select("index", formatted("elements").alias("preview")).toLocalIterator()
        return {"corpus": self.corpus, "query": text, "results": ({"index": r["index"], "preview": r["preview"]} for r in rows)}

    def _find_evidence(self, query: dict, body: bytes) -> dict:
        asked = self._body(body, ("record_limit", "max_bytes"))
        self._known(asked["corpus"])
        text = self._asked(asked["query"])
        limits = [asked[k] if asked.get(k) is not None else d for k, d in (("record_limit", EVIDENCE_RECORDS), ("max_bytes", EVIDENCE_BYTES))]
        rows = self.engine.search_to_get_fragment(text, *limits).toLocalIterator()
        return {"corpus": self.corpus, "query": text, "results": ({"index": r["index"], "record": r["record"]} for r in rows)}

    def _record(self, query: dict, body: bytes) -> dict:
        self._known(query.get("corpus"))
        index = _number(query.get("i"), "i")
        record = self.engine.get(index)
        if record is None:
            raise _Refused(404, "record_not_found", f"no record {index}")
        return {"corpus": self.corpus, "index": index, "record": record.text}

    def _get_evidence(self, query: dict, body: bytes) -> dict:
        self._known(query.get("corpus"))
        index = _number(query.get("i"), "i")
        text = self._asked(query.get("query"))
        most = _number(query["max_bytes"], "max_bytes") if "max_bytes" in query else EVIDENCE_BYTES
        if self.engine.get(index) is None:
            raise _Refused(404, "record_not_found", f"no record {index}")
        record = self.engine.get_fragment(index, text, most)
        if record is None:
            raise _Refused(404, "evidence_not_found", "the record has no such words")
        return {"corpus": self.corpus, "query": text, "index": index, "record": record}


def _pieces(answer: dict) -> Iterator[bytes]:
    """A JSON object of which one value may be an iterator of results."""
    lead = "{"
    for name, value in answer.items():
        yield f"{lead}{json.dumps(name)}: ".encode()
        lead = ", "
        if isinstance(value, Iterator):
            yield b"["
            for k, result in enumerate(value):
                yield (", " if k else "").encode() + json.dumps(result, ensure_ascii=False).encode()
            yield b"]"
        else:
            yield json.dumps(value, ensure_ascii=False).encode()
    yield b"}"


def serve(service: Service, host: str = "127.0.0.1", port: int = 60005) -> HTTPServer:
    """A server that answers one request after another; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, pieces = service.respond(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()  # the body ends with the connection
            for piece in pieces:
                self.wfile.write(piece)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer((host, port), Handler)
