"""Connections to chat and embedding models, replies as tables, and a cache of replies.

Clients are created in the workers, one per partition, so nothing that holds a socket is pickled.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import unfenced


class ModelError(RuntimeError):
    """A model could not be asked."""


class BackendUnavailable(ModelError):
    """No backend is configured or reachable."""


class ReplyError(ModelError):
    """A reply does not have the schema asked for."""


@dataclass(frozen=True)
class Backend:
    """Where to send requests.  ``style`` is "openai" (chat completions) or "ollama"."""

    style: str
    host: str
    model: str
    key: str | None = None
    timeout: float = 60.0
    supports_schema: bool = True
    supports_json: bool = True

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.host.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read())
        except (OSError, ValueError) as e:
            raise ModelError(str(e)) from e

    def response_format(self, schema: dict | None) -> object:
        """The strictest form that the backend knows: schema, then JSON, then none."""
        if schema and self.supports_schema:
            named = dict(strict=True, schema=schema, name="reply")
            return dict(type="json_schema", json_schema=named) if self.style == "openai" else schema
        if schema and self.supports_json:
            return {"type": "json_object"} if self.style == "openai" else "json"
        return None

    def chat(self, messages: list[dict], temperature: float = 0.0, schema: dict | None = None) -> str:
        form = self.response_format(schema)
        if self.style == "openai":
            body = {"model": self.model, "messages": messages, "temperature": temperature} | ({"response_format": form} if form else {})
            return self._post("/v1/chat/completions", body)["choices"][0]["message"]["content"]
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature}} | ({"format": form} if form else {})
        return self._post("/api/chat", body)["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.style == "openai":
            return [d["embedding"] for d in self._post("/v1/embeddings", {"model": self.model, "input": texts})["data"]]
        return [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]

    def ping(self) -> bool:
        try:
            with urllib.request.urlopen(self.host.rstrip("/") + ("/v1/models" if self.style == "openai" else "/api/tags"), timeout=3) as reply:
                return reply.status == 200
        except (OSError, ValueError):
            return False


def default_backend(environ: dict | None = None) -> Backend:
    """An API key first, then a local server that answers, else an error."""
    env = os.environ if environ is None else environ
    if env.get("OPENAI_API_KEY"):
        return Backend("openai", env.get("OPENAI_BASE_URL", "https://api.openai.com"), env.get("OPENAI_MODEL", "gpt-4o-mini"), env["OPENAI_API_KEY"])
    local = Backend("ollama", env.get("OLLAMA_HOST", "http://127.0.0.1:11434"), env.get("OLLAMA_MODEL", "llama3.1"))
    if local.ping():
        return local
    raise BackendUnavailable("set OPENAI_API_KEY or start a local model server")


class Scripted:
    """Canned replies for tests: the first whose trigger is in the prompt."""

    def __init__(self, replies: list[tuple[str, str]]):
        self.replies = replies

    def chat(self, messages: list[dict], temperature: float = 0.0, schema: dict | None = None) -> str:
        text = "\n".join(m["content"] for m in messages)
        for trigger, reply in self.replies:
            if trigger in text:
                return reply
        raise ModelError("no canned reply fits")


def fingerprint(requests: DataFrame, provider: str) -> DataFrame:
    """Adds ``fingerprint``: the SHA-256 of provider, model, prompt and temperature as JSON with sorted keys."""
    return requests.withColumn("fingerprint", F.sha2(F.to_json(F.struct("model", "prompt", F.lit(provider).alias("provider"), "temperature")), 256))


def chat(requests: DataFrame, make: Callable[[], object]) -> DataFrame:
    """Adds reply and error to requests (model, prompt, temperature); ``make`` builds a client once per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            reply, error = [], []
            for prompt, heat in zip(b["prompt"], b["temperature"], strict=True):
                try:
                    reply.append(client.chat([{"role": "user", "content": prompt}], float(heat)))
                    error.append(None)
                except ModelError as e:
                    reply.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield b.assign(reply=reply, error=error)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, fields + ", reply string, error string")


def cached_chat(requests: DataFrame, cache: DataFrame, make: Callable[[], object], provider: str) -> tuple[DataFrame, DataFrame]:
    """(requests with replies, new cache rows to append): only requests that the cache lacks are sent, each distinct one once.

    The cache is a table: fingerprint, reply.
    """
    keyed = fingerprint(requests, provider)
    missing = keyed.select("fingerprint", "model", "prompt", "temperature").join(cache, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
    from factloom.plans.scratch import materialise

    asked = materialise(chat(missing, make), "replies")
    new = asked.filter("reply IS NOT NULL").select("fingerprint", "reply")
    known = cache.select("fingerprint", "reply").unionByName(new)
    return keyed.join(known, "fingerprint", "left").join(asked.select("fingerprint", "error"), "fingerprint", "left"), new


def embed(rows: DataFrame, text: str, make: Callable[[], object], name: str = "embedding", size: int = 64) -> DataFrame:
    """Adds vectors of a model, asked for ``size`` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            texts = b[text].fillna("").tolist()
            yield b.assign(**{name: [v for i in range(0, len(texts), size) for v in client.embed(texts[i : i + size])]})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {name} array<double>")


def parsed(replies: DataFrame, schema: str, column: str = "reply") -> DataFrame:
    """Adds ``parsed`` (a struct, null if the reply doesn't parse or has unknown keys) and ``parse_error``."""
    text = unfenced(column)
    keys = F.array(*(F.lit(k) for k in replies.sparkSession.createDataFrame([], schema).columns))
    value = F.from_json(text, schema)
    extra = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), keys)
    bad = F.when(F.col(column).isNull(), "no reply").when(F.json_object_keys(text).isNull(), "not a JSON object").when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ", ")))
    return replies.withColumn("parse_error", bad).withColumn("parsed", F.when(F.col("parse_error").isNull(), value))


def repaired(requests: DataFrame, schema: str, make: Callable[[], object], repairs: int = 1) -> DataFrame:
    """Requests with parsed replies; those that don't parse are asked again with the error, ``repairs`` times at most."""
    from factloom.plans.scratch import materialise

    out = materialise(parsed(chat(requests, make), schema), "parsed")
    for _ in range(repairs):
        bad = out.filter("parse_error IS NOT NULL").select(*requests.columns, "parse_error")
        again = bad.withColumn("prompt", F.concat("prompt", F.lit("\nThe last reply could not be used ("), "parse_error", F.lit("). Reply with valid JSON only."))).drop("parse_error")
        out = materialise(out.filter("parse_error IS NULL").unionByName(parsed(chat(again, make), schema)), "repaired")
    return out


def schema_of(fields: dict[str, object]) -> dict:
    """A strict JSON schema of an object: names to schemas of their values."""
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def scripted(replies: list[tuple[str, str]]) -> Callable[[], Scripted]:
    return partial(Scripted, replies)
