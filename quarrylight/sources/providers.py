"""Web search providers and text generators by name. A provider says how to ask and where its answer holds results; sending
is the caller's function, so that nothing here opens a connection and tests and clusters can bring their own."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.web import url_key


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    body: dict[str, object] | None = None


@dataclass(frozen=True)
class Settings:
    """What providers need: which one, its key, an engine's id or an address of one's own, and how many results."""

    provider: str = "tavily"
    api_key: str = ""
    engine_id: str = ""
    endpoint: str = ""
    most: int = 6


@dataclass(frozen=True)
class Provider:
    """``request`` builds the request for a query, ``path`` leads to the list of results, ``needs`` are the settings without which it can't ask; ``items`` reads an answer that no path leads through."""

    name: str
    request: Callable[[Settings, str], Request]
    path: tuple[str, ...] = ("results",)
    needs: tuple[str, ...] = ("api_key",)
    items: Callable[[object], list[dict]] | None = None

    def ready(self, settings: Settings) -> bool:
        return all(getattr(settings, n) for n in self.needs)

    def results(self, payload: object) -> list[dict]:
        if self.items:
            return self.items(payload)
        for key in self.path:
            payload = payload.get(key) if isinstance(payload, dict) else None
        return [x for x in payload if isinstance(x, dict)] if isinstance(payload, list) else []


def flattened(topics: list[dict]) -> list[dict]:
    """Topics, and those nested in them at any depth, that have an address and a text; a title ends at the first dash."""
    out, todo = [], list(reversed(topics or []))
    while todo:
        t = todo.pop()
        if "Topics" in t:
            todo += reversed(t["Topics"] or [])
            continue
        url, text = (str(t.get(k) or "").strip() for k in ("FirstURL", "Text"))
        if url and text:
            out.append({"title": text.split(" - ", 1)[0], "url": url, "content": text})
    return out


def _answers(payload: object) -> list[dict]:
    """An instant answer, its results and its related topics."""
    p = payload if isinstance(payload, dict) else {}
    url, text = (str(p.get(k) or "").strip() for k in ("AbstractURL", "AbstractText"))
    own = [{"title": p.get("Heading") or url, "url": url, "content": text}] if url and text else []
    return own + flattened(p.get("Results") or []) + flattened(p.get("RelatedTopics") or [])


def _any_list(payload: object) -> list[dict]:
    """The first list of results under any of the usual names."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    for path in (("results",), ("organic_results",), ("items",), ("web", "results"), ("webPages", "value"), ("data",), ("documents",)):
        at = payload
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, list):
            return [x for x in at if isinstance(x, dict)]
    return []


def _custom(s: Settings, query: str) -> Request:
    """An address of one's own: the query and the key where it names them, else as a parameter and a header."""
    url = s.endpoint.replace("{query}", quote_plus(query)).replace("{api_key}", quote_plus(s.api_key))
    named = "{query}" in s.endpoint
    headers = {} if "{api_key}" in s.endpoint or not s.api_key else {"Authorization": f"Bearer {s.api_key}"}
    return Request("GET", url, {"Accept": "application/json", **headers}, {} if named else {"q": query})


# Addresses and parameters of public search services.
BUILT_IN = (
    Provider("tavily", lambda s, q: Request("POST", "https://api.tavily.com/search", {"Authorization": f"Bearer {s.api_key}"}, {}, {"query": q, "search_depth": "basic", "include_answer": False, "include_raw_content": False, "max_results": s.most, "exact_match": False})),
    Provider("duckduckgo", lambda s, q: Request("GET", "https://api.duckduckgo.com/", {}, {"q": q, "format": "json", "no_html": 1, "no_redirect": 1, "skip_disambig": 1}), needs=(), items=_answers),
    Provider("brave", lambda s, q: Request("GET", "https://api.search.brave.com/res/v1/web/search", {"Accept": "application/json", "X-Subscription-Token": s.api_key}, {"q": q, "count": s.most}), ("web", "results")),
    Provider("exa", lambda s, q: Request("POST", "https://api.exa.ai/search", {"Content-Type": "application/json", "x-api-key": s.api_key}, {}, {"query": q, "numResults": s.most, "contents": {"text": True}})),
    Provider("serpapi", lambda s, q: Request("GET", "https://serpapi.com/search.json", {}, {"engine": "google", "q": q, "api_key": s.api_key, "num": s.most}), ("organic_results",)),
    Provider("bing", lambda s, q: Request("GET", "https://api.bing.microsoft.com/v7.0/search", {"Ocp-Apim-Subscription-Key": s.api_key}, {"q": q, "count": s.most, "responseFilter": "Webpages"}), ("webPages", "value")),
    Provider("google_cse", lambda s, q: Request("GET", "https://www.googleapis.com/customsearch/v1", {}, {"key": s.api_key, "cx": s.engine_id, "q": q, "num": min(s.most, 10)}), ("items",), ("api_key", "engine_id")),
    Provider("custom", _custom, needs=("endpoint",), items=_any_list),
)
_providers: dict[str, Provider] = {}
_generators: dict[str, Callable[..., object]] = {}


def _key(name: str) -> str:
    return "_".join(name.lower().replace("-", " ").replace("_", " ").split())


def register_provider(provider: Provider) -> None:
    """A later registration replaces an earlier one, a built-in one too."""
    _providers[_key(provider.name)] = provider


for _p in BUILT_IN:
    register_provider(_p)


def available() -> list[str]:
    return sorted(_providers)


def provider_for(settings: Settings) -> Provider:
    """The provider of that name; an unknown name gives the first built-in one."""
    return _providers.get(_key(settings.provider), BUILT_IN[0])


def register_generator(name: str, make: Callable[..., object]) -> None:
    """``make(**options)`` gives an object with ``answer(question, sources) -> str``."""
    _generators[_key(name)] = make


def generator(name: str, **options) -> object:
    if _key(name) not in _generators:
        raise ValueError(f"no text generator {name!r}; there are {sorted(_generators)}")
    return _generators[_key(name)](**options)


class Extractive:
    """Answers with the sentence that shares most words with the question, and its label; says so if none does. Needs no model."""

    def answer(self, question: str, sources: list[tuple[str, str]]) -> str:
        asked = set(question.lower().replace("?", " ").split())
        every = [(len(asked & set(s.lower().split())), label, s) for label, text in sources for s in text.replace("!", ".").split(". ") if s.strip()]
        n, label, sentence = max(every, key=lambda x: x[0], default=(0, "", ""))
        return f"{sentence.strip().rstrip('.')}. [{label}]" if n else "The sources hold not enough information."


register_generator("extractive", Extractive)

RESULT = "qid {}, query string, pos int, url string, title string, content string"
# Names that services give to a result's address, title and text.
URL_NAMES, TITLE_NAMES, TEXT_NAMES = ("url", "link", "href"), ("title", "name", "heading"), ("content", "snippet", "description", "text", "body", "abstract", "raw_content")


def search(queries: DataFrame, settings: Settings, send: Callable[[Request], str], id_col: str = "qid") -> DataFrame:
    """``qid``, ``rank``, ``url``, ``title``, ``content``: what a provider answers to each row's ``query``, ``send`` giving a request's answer as JSON text.

    Requests go out from the executors, a batch of rows at a time; a request that fails gives no results, as does an
    answer that is no JSON, and an unready provider none at all. Only http(s) addresses count; of one question's results
    with the same address key the first stays, in the order of the queries and of each answer, ``most`` at most (a top-k).
    """
    provider, kind = provider_for(settings), queries.schema[id_col].dataType.simpleString()
    first = lambda item, names: next((str(item[n]).strip() for n in names if item.get(n)), "")

    def run(batches):
        for b in batches:
            rows = []
            for qid, query in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not provider.ready(settings) or not (query or "").strip():
                    continue
                try:
                    items = provider.results(json.loads(send(provider.request(settings, query))))
                except (OSError, ValueError):
                    continue
                for pos, item in enumerate(items):
                    url = first(item, URL_NAMES)
                    if urlsplit(url).scheme in ("http", "https"):
                        rows.append((qid, query, pos, url, first(item, TITLE_NAMES) or url, first(item, TEXT_NAMES)))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), *(pa.array(columns[k], pa.string()) for k in (3, 4, 5))], names=["qid", "query", "pos", "url", "title", "content"])

    from pyspark.sql import Window

    order = queries.select(F.col(id_col).alias("qid"), "query", F.monotonically_increasing_id().alias("at"))
    found = order.select("qid", "query").mapInArrow(run, RESULT.format(kind)).withColumn("key", url_key(F.col("url")))
    nth = order.groupBy("qid", "query").agg(F.min("at").alias("at"))
    placed = found.join(nth, ["qid", "query"])
    best = placed.groupBy("qid", "key").agg(F.min(F.struct("at", "pos", "url", "title", "content")).alias("x")).select("qid", "x.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "pos")))
    return ranked.where(F.col("rank") <= settings.most).select(F.col("qid").alias(id_col), "rank", "url", "title", "content")
