"""An HTTP service over the engine, with the standard library only.

``python -m hopframe.server`` serves with the backends in the environment variable BACKENDS, the
mapping in the file that MAPPING_PATH names, and mappings kept in MAPPING_STORE
(``.mapping-store``), on PORT (7000). Tables stay in executor memory for FRESH_SECONDS (30; 0: not at all).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain, islice
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import AnalysisException

from hopframe.engine import Engine
from hopframe.errors import QueryError


def _upload(headers, body: bytes) -> dict[str, str]:
    """Fields of a JSON or multipart body; the mapping is in ``mapping`` or ``file``."""
    kind = headers.get("Content-Type", "")
    if kind.startswith("multipart/"):
        message = BytesParser().parsebytes(f"Content-Type: {kind}\r\n\r\n".encode() + body)
        return {p.get_param("name", header="content-disposition"): p.get_payload(decode=True).decode() for p in message.get_payload()}
    told = _object(body)
    return told if "mapping" in told else {"mapping": told}


def _object(body: bytes) -> dict:
    told = json.loads(body or b"{}")
    if not isinstance(told, dict):
        raise QueryError("the body is a JSON object")
    return told


def _text(told: dict) -> str:
    query = told.get("gremlin", "")
    if not isinstance(query, str):
        raise QueryError("gremlin is a text")
    return query


def _first_line(e: Exception) -> str:
    return str(e).splitlines()[0] if str(e) else type(e).__name__


@dataclass
class Answer:
    """A query's answer, whose rows are written as they come."""

    head: dict
    rows: Iterator
    limit: int | None = None

    def chunks(self) -> Iterator[str]:
        """The JSON text in pieces."""
        yield json.dumps(self.head)[:-1] + ', "results": ['
        n, more = 0, False
        for row in self.rows:
            if n == self.limit:
                more = True
                break
            yield (", " if n else "") + json.dumps(row)
            n += 1
        end = {"resultCount": n} | ({} if self.limit is None else {"truncated": more})
        yield "], " + json.dumps(end)[1:]


class Service:
    """Routes: (method, path, parameters, headers, body) to (status, JSON value or :class:`Answer`)."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, method: str, target: str, headers, body: bytes) -> tuple[int, object]:
        url = urlsplit(target)
        params = {k: v[-1] for k, v in parse_qs(url.query).items()}
        mapping = headers.get("X-Mapping-Id") or params.get("mappingId")
        store, engine = self.engine.store, self.engine
        try:
            match (method, url.path):
                case ("GET", "/health"):
                    return 200, {"status": "ok", "backends": [b["id"] for b in engine.registry.described()]}
                case ("GET", "/backends"):
                    return 200, engine.registry.described()
                case ("POST", "/backends/register"):
                    return 201, {"id": engine.registry.register(_object(body))}
                case ("GET", "/mappings"):
                    return 200, store.list()
                case ("GET", "/mapping/status"):
                    return 200, store.status()
                case ("GET", "/mapping"):
                    return 200, dict(store.get(mapping).source)
                case ("POST", "/mapping/upload"):
                    told = _upload(headers, body)
                    keep = str(told.get("activate", params.get("activate", "true"))).lower() != "false"
                    id = store.put(told.get("mapping") or told.get("file") or "", told.get("id") or params.get("id"), told.get("name") or params.get("name"), keep)
                    engine.adopt(store.get(id))
                    return 201, {"id": id, "active": store.active_id}
                case ("POST", "/mapping/active"):
                    store.set_active(_object(body).get("id") or mapping or "")
                    return 200, store.status()
                case ("DELETE", "/mapping"):
                    store.delete(mapping or params.get("id") or store.active_id or "")
                    return 200, store.status()
                case ("POST", "/gremlin/query"):
                    return 200, self._query(_object(body), headers, params, mapping)
                case ("POST", "/query"):
                    return 307, {"location": "/gremlin/query" + (f"?{url.query}" if url.query else "")}
                case ("POST", "/query/explain"):
                    return 200, engine.explain(_text(_object(body)), mapping).as_dict()
            return 404, {"error": f"no route {method} {url.path}"}
        except (QueryError, AnalysisException, ValueError) as e:  # ValueError: no JSON, no UTF-8, no number
            return 400, {"error": _first_line(e)}
        except Exception as e:  # noqa: BLE001 - the edge of the service: a client is always answered
            return 500, {"error": _first_line(e)}

    def _query(self, told: dict, headers, params: dict, mapping: str | None) -> Answer:
        """All rows; at most ``limit`` of them, and whether there are more, where the client asks so."""
        query, backend = _text(told), headers.get("X-Backend-Id") or params.get("backendId")
        limit = told.get("limit", params.get("limit"))
        limit = None if limit is None else int(limit)
        if limit is not None and limit < 0:
            raise QueryError("limit is not negative")
        head = {"gremlin": query, "transaction": "read-only"}
        if str(headers.get("X-SQL-Trace") or params.get("sql_log") or "").lower() in ("1", "true"):
            head["trace"] = self.engine.explain(query, mapping).as_dict()
        rows = self.engine.stream(query, mapping, backend, None if limit is None else limit + 1)
        first = list(islice(rows, 1))  # what fails, fails before the answer begins
        return Answer(head, chain(first, rows), limit)


def serve(engine: Engine, port: int = 7000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready; ``serve_forever()`` runs it."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = service.handle(self.command, self.path, self.headers, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            if isinstance(value, Answer):  # the end of the connection ends the answer
                self.end_headers()
                for piece in value.chunks():
                    self.wfile.write(piece.encode())
                return
            if status == 307:
                self.send_header("Location", value["location"])
            data = json.dumps(value).encode()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    from pathlib import Path

    from pyspark.sql import SparkSession

    from hopframe.sources.registry import Registry
    from hopframe.sources.store import MappingStore

    spark = SparkSession.builder.appName("hopframe").getOrCreate()
    store = MappingStore(os.environ.get("MAPPING_STORE", ".mapping-store"))
    engine = Engine(spark, registry=Registry.from_env(spark), store=store, fresh_seconds=float(os.environ.get("FRESH_SECONDS", "30")))
    if path := os.environ.get("MAPPING_PATH"):
        store.put(Path(path).read_text(), id=Path(path).stem)
    if store.active_id:
        engine.adopt(store.get())
    serve(engine, int(os.environ.get("PORT", "7000"))).serve_forever()


if __name__ == "__main__":
    main()
