"""Registries of tools and retrieval components, and a configurable retrieval pipeline."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import retrieval as R

#: The kinds of tools.
TOOL_KINDS = ("read", "write", "think", "generic")


class Registry:
    """Names to things; a name is given once."""

    def __init__(self, what: str):
        self.what, self.found = what, {}

    def register(self, name: str, **about: Any) -> Callable:
        def add(x):
            if name in self.found:
                raise ValueError(f"{self.what} {name} is registered already")
            self.found[name] = (x, about)
            return x

        return add

    def get(self, name: str):
        if name not in self.found:
            raise KeyError(f"unknown {self.what} {name}; known: {', '.join(sorted(self.found))}")
        return self.found[name][0]

    def about(self, name: str) -> dict:
        self.get(name)
        return self.found[name][1]

    def names(self) -> list[str]:
        return sorted(self.found)


class Toolkit:
    """Functions with a kind and whether they change state; those that have a return type become SQL functions."""

    def __init__(self):
        self.registry = Registry("tool")

    def tool(self, kind: str, changes: bool | None = None, returns: str | None = None, name: str | None = None):
        if kind not in TOOL_KINDS:
            raise ValueError(f"unknown kind {kind}")

        def add(f):
            return self.registry.register(name or f.__name__, kind=kind, changes=kind == "write" if changes is None else changes, returns=returns)(f)

        return add

    def kinds(self) -> dict[str, str]:
        return {n: self.registry.about(n)["kind"] for n in self.registry.names()}

    def mutating(self) -> list[str]:
        return [n for n in self.registry.names() if self.registry.about(n)["changes"]]

    def use(self, name: str, **args: Any) -> Any:
        return self.registry.get(name)(**args)

    def register_sql(self, spark: SparkSession) -> list[str]:
        done = [n for n in self.registry.names() if self.registry.about(n)["returns"]]
        for n in done:
            spark.udf.register(n, self.registry.get(n), self.registry.about(n)["returns"])
        return done


preprocessors, inputs, retrievers, postprocessors = (Registry(n) for n in ("document preprocessor", "input preprocessor", "retriever", "postprocessor"))


def validate(config: Mapping[str, Any]) -> dict[str, Any]:
    """The configuration with its defaults; raises ValueError where it can't run."""
    c = dict(config)
    if ("retriever" in c) == ("retrievers" in c):
        raise ValueError("give either retriever or retrievers")
    c["retrievers"] = c.pop("retrievers") if "retrievers" in c else [c.pop("retriever")]
    if not isinstance(c["retrievers"], list) or not c["retrievers"]:
        raise ValueError("retrievers must be a list with an entry")
    for part in ("document_preprocessors", "input_preprocessors", "retrievers", "postprocessors"):
        c.setdefault(part, [])
        if not isinstance(c[part], list) or any("type" not in x for x in c[part]):
            raise ValueError(f"{part} must be a list of entries with a type")
    for key in ("tool_name", "description"):
        if not isinstance(c.get(key, ""), str):
            raise ValueError(f"{key} must be a text")
    if not all(isinstance(x, str) for kv in c.get("parameters", {}).items() for x in kv):
        raise ValueError("parameters must map names to descriptions")
    return c


@preprocessors.register("bm25_indexer")
def _bm25(docs: DataFrame, state: dict, **_: Any) -> None:
    state["bm25"] = R.bm25_index(docs, "id", "content")


@preprocessors.register("embedding_indexer")
def _embedded(docs: DataFrame, state: dict, vector: str = "embedding", **_: Any) -> None:
    state["vectors"] = docs.select("id", vector)


@inputs.register("embedding_encoder")
def _encoded(queries: DataFrame, state: dict, **_: Any) -> DataFrame:
    """Query vectors come with the queries, as the column ``embedding``."""
    if "embedding" not in queries.columns:
        raise ValueError("queries need an embedding")
    return queries


@retrievers.register("bm25")
def _by_words(queries: DataFrame, state: dict, top_k: int = 10, **_: Any) -> DataFrame:
    return R.bm25_top_k(state["documents"], queries, top_k, "id", "content", "query", "text")


@retrievers.register("cosine")
def _by_vector(queries: DataFrame, state: dict, top_k: int = 10, vector: str = "embedding", **_: Any) -> DataFrame:
    return R.cosine_top_k(state["vectors"], "id", vector, queries, "query", "embedding", top_k)


@retrievers.register("grep")
def _by_pattern(queries: DataFrame, state: dict, top_k: int = 10, case_sensitive: bool = False, **_: Any) -> DataFrame:
    return R.grep_top_k(state["documents"], queries, top_k, "id", "content", "query", "text", not case_sensitive)


@postprocessors.register("reranker")
def _reranked(results: DataFrame, state: dict, min_score: float | None = None, top_k: int | None = None, **_: Any) -> DataFrame:
    return R.rerank(results, state["scores"], state["documents"], "id", "content", min_score, top_k)


@dataclass
class RetrievalPipeline:
    """Document preprocessors, input preprocessors, retrievers with the best score kept, a cut, postprocessors."""

    config: Mapping[str, Any]
    state: dict[str, Any] = field(default_factory=dict)
    timing: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.config = validate(self.config)

    def _timed(self, name: str, f: Callable, *a: Any, **k: Any) -> Any:
        began = time.perf_counter()
        try:
            return f(*a, **k)
        finally:
            self.timing[name] = self.timing.get(name, 0.0) + time.perf_counter() - began

    def index(self, docs: DataFrame) -> None:
        """Columns id, content and what the preprocessors need."""
        self.state["documents"] = docs
        for p in self.config["document_preprocessors"]:
            self._timed(p["type"], preprocessors.get(p["type"]), docs, self.state, **p.get("params", {}))

    def retrieve(self, queries: DataFrame, top_k: int | None = None, retriever_k: int | None = None) -> DataFrame:
        """``query, doc, score, rank`` for queries (query, text, ...)."""
        for p in self.config["input_preprocessors"]:
            queries = self._timed(p["type"], inputs.get(p["type"]), queries, self.state, **p.get("params", {}))
        found = []
        for r in self.config["retrievers"]:
            params = {**r.get("params", {}), **({"top_k": retriever_k} if retriever_k is not None else {})}
            found.append(self._timed(r["type"], retrievers.get(r["type"]), queries, self.state, **params))
        out = R.fuse_max(*found, k=top_k)
        for p in self.config["postprocessors"]:
            out = self._timed(p["type"], postprocessors.get(p["type"]), out, self.state, **p.get("params", {}))
        return out


def document_prompt(template: str, docs: DataFrame, ids: list[str]) -> str:
    """A template with the named documents in place of ``{documents}``, in the order of the ids."""
    found = {r.id: r for r in docs.where(F.col("id").isin(ids)).collect()}
    missing = [i for i in ids if i not in found]
    if missing:
        raise KeyError(f"unknown documents: {', '.join(missing)}")
    text = "\n\n".join(f"## {found[i].title}\n{found[i].content}" for i in ids)
    return re.sub(r"\{documents\}", lambda _: text, template)
