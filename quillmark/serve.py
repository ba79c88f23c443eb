"""Serving queries over an opened workspace: modes, formats, cached results, statistics, and named servers."""

from __future__ import annotations

import asyncio
import json
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.operators import context, embedding, global_search, parsing, search
from quillmark.operators.registry import Registry
from quillmark.workspace import Workspace


@dataclass
class Request:
    query: str
    max_tokens: int | None = None
    search_type: str = "hybrid"
    format: str = "text"
    include_metadata: bool = False
    limit: int = K.MAX_RESULTS


@dataclass
class Response:
    content: str
    results_count: int
    metadata: dict = field(default_factory=dict)
    performance: dict = field(default_factory=dict)


class FirstInCache:
    """Keeps the latest `size` entries by insertion: the oldest goes first, however often it is read."""

    def __init__(self, size: int = K.CACHED_RESULTS):
        self.size, self.rows, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, key, make):
        if key in self.rows:
            self.hits += 1
            return self.rows[key]
        self.misses += 1
        value = make()
        if self.size > 0:
            if len(self.rows) >= self.size:
                self.rows.popitem(last=False)
            self.rows[key] = value
        return value

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "size": len(self.rows), "max_size": self.size}


class Server:
    """Answers queries over one workspace. Results are few rows, collected once for each new request."""

    def __init__(self, workspace: Workspace, factory=embedding.hashed_encoder, cache: int = K.CACHED_RESULTS):
        self.workspace, self.factory, self.cache = workspace, factory, FirstInCache(cache)
        self.began, self.connections, self.lock = time.time(), set(), threading.Lock()
        self.asked, self.seconds, self.last = 0, 0.0, None
        self.reload()

    def reload(self) -> None:
        if not self.workspace.exists():
            raise FileNotFoundError(f"no index at {self.workspace.path}")
        self.index, self.vectors, self.cache = self.workspace.index(), self.workspace.vectors(), FirstInCache(self.cache.size)

    def ranked(self, request: Request) -> DataFrame:
        vector = [float(x) for x in self.factory()([request.query])[0]] if self.vectors is not None and request.search_type != "keyword" else None
        return context.ranked(search.search(self.index, request.query, request.search_type, self.vectors, vector, request.limit))

    def _answer(self, request: Request) -> tuple[str, list]:
        rows = self.ranked(request).persist()
        try:
            made = {"json": lambda: context.json_response(rows), "structured": lambda: context.structured_response(rows)}.get(request.format, lambda: context.text_response(context.within_budget(rows, request.max_tokens or K.TOKEN_LIMIT)))()
            return made.first()["content"], [r.asDict() for r in rows.drop("content").orderBy("rank").collect()]
        finally:
            rows.unpersist()

    def query(self, request: Request | str) -> Response:
        """The answer; an error becomes an answer without results."""
        request = Request(request) if isinstance(request, str) else request
        began = time.time()
        try:
            content, rows = self.cache.get((request.query, request.max_tokens, request.limit, request.search_type, request.format), lambda: self._answer(request))
            out = Response(content, len(rows), {"results_found": len(rows), "search_type": request.search_type, "query_processed": request.query, "timestamp": time.time()})
            if request.include_metadata:
                out.metadata["detailed_results"] = rows
        except Exception as error:  # a server answers on
            out = Response(f"Error processing query: {error}", 0, {"error": str(error)})
        took = time.time() - began
        with self.lock:
            self.asked, self.seconds, self.last = self.asked + 1, self.seconds + took, time.time()
        out.performance = {"query_time": took, "results_count": out.results_count, "server_uptime": time.time() - self.began}
        return out

    async def query_async(self, request: Request | str, connection: str | None = None) -> Response:
        with self.lock:
            self.connections.add(connection)
        try:
            return await asyncio.to_thread(self.query, request)
        finally:
            with self.lock:
                self.connections.discard(connection)

    def context(self, query: str, budget: int = K.TOKEN_LIMIT) -> str:
        return context.engine_context(context.within_budget(self.ranked(Request(query)), budget)).first()["context"]

    def stats(self) -> dict:
        with self.lock:
            return {"total_queries": self.asked, "total_time": self.seconds, "mean_time": self.seconds / self.asked if self.asked else 0.0, "last_query": self.last, "active_connections": len(self.connections), "cache": self.cache.stats()}

    def health(self) -> dict:
        answer = self.query("test")
        return {"status": "unhealthy" if "error" in answer.metadata else "healthy", "uptime": time.time() - self.began}

    def __enter__(self) -> Server:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def stop(self) -> None:
        self.connections.clear()


class Servers:
    """Servers by name."""

    def __init__(self):
        self.by_name: dict[str, Server] = {}

    def create(self, name: str, workspace: Workspace, **options) -> Server:
        if name in self.by_name:
            raise ValueError(f"Server already exists: {name}")
        self.by_name[name] = Server(workspace, **options)
        return self.by_name[name]

    def get(self, name: str) -> Server | None:
        return self.by_name.get(name)

    def remove(self, name: str) -> bool:
        if server := self.by_name.pop(name, None):
            server.stop()
        return server is not None

    def names(self) -> list[str]:
        return list(self.by_name)

    def stats(self) -> dict:
        return {k: s.stats() for k, s in self.by_name.items()}

    def shut_down(self) -> None:
        for name in self.names():
            self.remove(name)


class Tools:
    """The five tools over a registry; each returns a JSON string, an error included."""

    def __init__(self, registry: Registry, open_workspace=None):
        self.registry, self.open, self.engines = registry, open_workspace or (lambda row: Workspace(registry.spark, f"{row.path}/.quillmark")), {}

    def engine(self, workspace_id: str) -> Server | None:
        if workspace_id not in self.engines:
            row = self.registry.get(workspace_id)
            workspace = self.open(row) if row else None
            if workspace is None or not workspace.exists():
                return None
            self.engines[workspace_id] = Server(workspace)
        return self.engines[workspace_id]

    def search_workspaces(self, query: str, workspace_id: str | None = None, max_results: int = 10, search_type: str = "all") -> str:
        cleaned, results = global_search.cleaned(query), []
        if workspace_id and self.registry.get(workspace_id) is None:
            return json.dumps({"error": f"Workspace not found: {workspace_id}", "query": query}, indent=2)
        workspaces = [self.registry.get(workspace_id)] if workspace_id else self.registry.workspaces().collect()
        if not workspace_id:
            top = global_search.with_workspaces(global_search.search(self.registry.facts(), cleaned, max_results, search_type), self.registry.workspaces(True))
            columns = ["workspace_name", "workspace_id", "file_path", "title", "content_preview", "section_type", F.col("score").alias("relevance_score"), F.slice("keywords", 1, 5).alias("keywords"), "workspace_path"]
            results = [r.asDict() for r in top.orderBy(F.desc(F.round("score", 6)), "section_id").select(*columns).collect()]
        if not results:
            for w in workspaces:
                engine = self.engine(w.id)
                text = engine.context(cleaned) if engine else ""
                if global_search.is_meaningful(text):
                    results.append({"workspace_name": w.name, "workspace_id": w.id, "file_path": "multiple_files", "title": f"Search results in {w.name}", "content_preview": text[:300] + "...", "section_type": "mixed", "relevance_score": 0.7, "keywords": query.split(), "workspace_path": w.path})
        out = {"query": query, "processed_query": cleaned, "search_type": search_type, "total_results": len(results), "workspaces_searched": len(workspaces), "results": results[:max_results]}
        if not results:
            out |= {"message": f"No results found for '{query}'", "suggestions": global_search.suggestions(query)}
        return json.dumps(out, indent=2, ensure_ascii=False)

    def list_workspaces(self, include_stats: bool = True) -> str:
        rows = [r.asDict() for r in self.registry.workspaces().collect()]
        counted = ("file_count", "document_count", "code_symbol_count", "embedding_count", "index_size_mb", "health_score", "last_indexed")
        listed = [{k: v for k, v in r.items() if include_stats or k not in counted} for r in rows]
        out = {"total_workspaces": len(rows), "workspaces": listed}
        return json.dumps(out | ({"registry_stats": self.registry.stats().first().asDict()} if include_stats else {}), indent=2, ensure_ascii=False)

    def workspace_info(self, workspace_id: str, include_files: bool = False) -> str:
        row = self.registry.get(workspace_id)
        if row is None:
            return json.dumps({"error": f"Workspace not found: {workspace_id}"})
        out = row.asDict() | {"relationships": [r.asDict() for r in self.registry.related(workspace_id).collect()]}
        if include_files:
            workspace = self.open(row)
            out["files"] = [r.path for r in workspace.table("files").select("path").orderBy("path").limit(50).collect()] if workspace.exists() else []
        return json.dumps(out, indent=2, ensure_ascii=False)

    def _file(self, file_path: str, workspace_id: str | None) -> DataFrame:
        """The file's row (path, content). A path must lie inside its workspace, or inside a registered one."""
        import posixpath

        roots = [w.path for w in ([self.registry.get(workspace_id)] if workspace_id else self.registry.workspaces().collect()) if w]
        for root in roots:
            full = posixpath.normpath(file_path if file_path.startswith("/") else posixpath.join(root, file_path))
            if full.startswith(root.rstrip("/") + "/") and embedding.exists(self.registry.spark, full):
                rows = self.registry.spark.read.text(full, wholetext=True)
                return rows.select(F.lit(full).alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))
        raise FileNotFoundError(f"File not found in a registered workspace: {file_path}")

    def file_content(self, file_path: str, workspace_id: str | None = None, start_line: int | None = None, end_line: int | None = None) -> str:
        try:
            row = self._file(file_path, workspace_id).persist()
            out = parsing.line_slice(row, start_line, end_line).first().asDict()
            out["outline"] = [{k: v for k, v in o.asDict().items() if v is not None and k not in ("file_path", "n")} for o in parsing.outlines(row).orderBy("n").collect()]
        except FileNotFoundError as error:
            out = {"error": str(error)}
        return json.dumps(out, indent=2, ensure_ascii=False)

    def function_content(self, file_path: str, function_name: str, workspace_id: str | None = None) -> str:
        try:
            found = parsing.function_body(self._file(file_path, workspace_id), function_name).first()
            out = found.asDict() | {"function_name": function_name} if found else {"error": f"Function not found: {function_name}"}
        except FileNotFoundError as error:
            out = {"error": str(error)}
        return json.dumps(out, indent=2, ensure_ascii=False)


def quick_query(workspace: Workspace, query: str, **options) -> str:
    with Server(workspace) as server:
        return server.query(Request(query, **options)).content


async def quick_query_async(workspace: Workspace, query: str, **options) -> str:
    return await asyncio.to_thread(quick_query, workspace, query, **options)


_servers = Servers()


def shared_servers() -> Servers:
    return _servers
