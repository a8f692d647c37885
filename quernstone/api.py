"""Requests of a search service as functions that give JSON; a web server only has to pass them on."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import sanitize
from quernstone.operators.index import SearchIndex, open_or_build
from quernstone.operators.search import Searcher


@dataclass
class SearchAPI:
    searcher: Searcher
    index_path: str | None = None
    pages: DataFrame | None = None

    def handle(self, method: str, path: str, params: dict | None = None) -> tuple[int, str]:
        """(status, JSON) of a request. Unknown paths give 404, wrong methods 405, bad parameters 400."""
        routes = {"/api/v1/search": (("GET", "POST"), self.search), "/api/v1/stats": (("GET",), self.stats), "/health": (("GET",), self.health), "/api/v1/index/rebuild": (("POST",), self.rebuild)}
        if path not in routes:
            return 404, _error(404, "not found")
        methods, run = routes[path]
        if method not in methods:
            return 405, _error(405, "method not allowed")
        try:
            return 200, run(**{k: v for k, v in (params or {}).items()})
        except (TypeError, ValueError) as e:
            return 400, _error(400, str(e))

    def search(self, q: str = "", query: str = "", limit: int = 10, offset: int = 0, explain: bool = False) -> str:
        text, limit, offset = (q or query).strip(), int(limit), int(offset)
        if not text:
            raise ValueError("query is empty")
        if not 0 < limit <= 1000 or offset < 0:
            raise ValueError("limit must lie in 1..1000, offset must not be negative")
        began = time.time()
        found = self.searcher.search(text, limit, offset)
        safe = [F.coalesce(sanitize(F.col(c)), F.lit("")).alias(c) for c in ("title", "snippet")]
        rows = found.select("position", "doc_id", "url", *safe, "score").orderBy("position").collect()  # at most limit rows
        out = {"query": text, "total": self.searcher.total(text), "results": [r.asDict() for r in rows], "seconds": round(time.time() - began, 3)}
        if explain:
            out["plan"] = found._jdf.queryExecution().simpleString()
        return json.dumps(out)

    def stats(self) -> str:
        return json.dumps(self.searcher.index.stats().first().asDict())

    def health(self) -> str:
        return json.dumps({"status": "ok", "indexed": not self.searcher.index.doc_info.isEmpty()})

    def rebuild(self) -> str:
        if self.pages is None or self.index_path is None:
            raise ValueError("no pages to build from")
        index: SearchIndex = open_or_build(self.pages.sparkSession, self.index_path, self.pages, rebuild=True)
        self.searcher.index = index
        return json.dumps({"documents": index.document_count()})


def _error(status: int, message: str) -> str:
    return json.dumps({"error": message, "status": status})
