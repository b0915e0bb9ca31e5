"""Live providers: pages, chat and embeddings fetched by tasks. Analysis never needs them; it reads what they have captured.

A provider is a function from one request to a result, pickled into the tasks. The number of partitions is the number of requests at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.shipping import ship

PAGE = "url string, final_url string, status_code int, html string, load_ms double, ok boolean, error string, via string"
Fetch = Callable[[str], dict]


@dataclass(frozen=True)
class Settings:
    """Limits of a run; credentials live here and are never written: see store.scrubbed."""

    page_timeout: float = 20.0
    concurrency: int = 12
    chat_tries: int = 3
    chat_waits: tuple[float, ...] = (4.0, 8.0)
    batch: int = 128
    credentials: dict[str, str] = field(default_factory=dict, repr=False)


def http_page(url: str, timeout: float = 20.0) -> dict:
    """One page by plain HTTP; faults are told in the row."""
    began = time.time()
    out = {"url": url, "final_url": url, "status_code": None, "html": None, "load_ms": None, "ok": False, "error": None, "via": "http"}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
            body = r.read()
            out |= {"final_url": r.geturl(), "status_code": r.status, "html": body.decode(r.headers.get_content_charset() or "utf-8", "replace")}
    except urllib.error.HTTPError as e:
        out |= {"status_code": e.code, "error": str(e)}
    except (OSError, ValueError) as e:
        out["error"] = str(e)
    out["load_ms"] = (time.time() - began) * 1000
    out["ok"] = 200 <= (out["status_code"] or 0) < 400 and bool(out["html"])
    return out


def escalating(*steps: Fetch, blocked: Callable[[str], bool]) -> Fetch:
    """The first step whose page is neither missing nor blocked; else the last result."""

    def fetch(url: str) -> dict:
        got: dict = {}
        for step in steps:
            got = step(url)
            if got.get("html") and not blocked(got["html"]):
                return got | {"ok": True}
        return got | {"ok": False}

    return fetch


def fetch_pages(urls: DataFrame, fetch: Fetch = http_page, at_once: int = 12) -> DataFrame:
    """PAGE of every distinct url; a provider that raises gives a row with the error."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    rows.append(fetch(url))
                except Exception as e:  # noqa: BLE001  one bad page mustn't fail the run
                    rows.append({"url": url, "ok": False, "error": str(e), "via": "error"})
            yield _frame({c: [r.get(c) for r in rows] for c in (x.split()[0] for x in PAGE.split(", "))})

    return urls.select("url").filter("url is not null").distinct().repartition(at_once).mapInPandas(run, PAGE)


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    """Plain Python objects, whichever string type pandas prefers."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def first_good(endpoints: list[str], post: Callable[[str, dict], tuple[int, str]], body: dict) -> dict | None:
    """Failover: the first endpoint that answers 200 with a JSON object."""
    for e in endpoints:
        try:
            status, text = post(e, body)
            got = json.loads(text)
        except (OSError, ValueError):
            continue
        if status == 200 and isinstance(got, dict):
            return got
    return None


def retrying(ask: Callable[[str], tuple[int, str]], settings: Settings, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A chat function that waits and tries again on 429 only, answers ``[error]`` texts instead of raising, and cuts out thoughts and credentials."""

    def chat(prompt: str) -> str:
        for k in range(settings.chat_tries):
            try:
                status, reply = ask(prompt)
            except Exception as e:  # noqa: BLE001  a reply that can't be read mustn't fail the task
                return redact(f"[error] {e}", settings)
            if status == 200:
                return redact(re.sub(r"(?s)<think>.*?</think>", "", reply).strip(), settings)
            if status != 429:
                return redact(f"[error] {status}", settings)
            if k + 1 < settings.chat_tries:
                sleep(settings.chat_waits[min(k, len(settings.chat_waits) - 1)])
        return "[error] 429"

    return chat


def redact(text: str, settings: Settings) -> str:
    for v in settings.credentials.values():
        text = text.replace(v, "[redacted]") if v else text
    return text


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def captured_replies(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """prompts with the reply captured for them (prompt_hash, reply); null where there is none."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(replies.select("prompt_hash", "reply"), "prompt_hash", "left")


def ask_all(prompts: DataFrame, chat: Callable[[str], str], at_once: int = 6) -> DataFrame:
    """prompt_hash, reply for every distinct prompt, to be captured."""
    ship(prompts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b["prompt"].tolist()
            yield _frame({"prompt_hash": [prompt_hash(p) for p in asked], "reply": [chat(p) for p in asked]})

    return prompts.select("prompt").distinct().repartition(at_once).mapInPandas(run, "prompt_hash string, reply string")


def embed_all(texts: DataFrame, embed: Callable[[list[str]], list[list[float]] | None], batch: int = 128, at_once: int = 6) -> DataFrame:
    """text, embedding in batches; a batch that fails gives nulls."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b["text"].iloc[k : k + batch].tolist()
                got = embed(part)
                yield _frame({"text": part, "embedding": got if got is not None and len(got) == len(part) else [None] * len(part)})

    return texts.select("text").distinct().repartition(at_once).mapInPandas(run, "text string, embedding array<double>")
