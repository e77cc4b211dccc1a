"""A completion service over HTTP, as the `post` of engine.model_generator."""

from __future__ import annotations

import asyncio
import http.client
import json
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd

from ..operators.grounding import FALLBACK, RETRYABLE


class ProviderError(RuntimeError):
    """A call failed; the text never holds the key, the payload or the body."""


class ConfigurationError(ProviderError):
    """A setting that calls need is missing or out of bounds."""


class CallFailed(ProviderError):
    """The service or the way to it failed."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status
        self.retryable = transient(status)
        self.fallback_allowed = self.retryable or status == FALLBACK


class UnusableResponse(ProviderError):
    """The service answered, but with nothing that can be used."""


@dataclass(frozen=True)
class HttpProvider:
    """provider(model, payload) gives a status and a body, 0 where no response came: no connection in `connect_timeout`
    seconds, or nothing to read for `timeout` seconds. Redirects aren't followed."""

    url: str
    key: str
    timeout: float = 30.0
    connect_timeout: float = 10.0

    def __post_init__(self):
        if not self.key or not self.url.startswith(("http://", "https://")) or any(c.isspace() for c in self.key):
            raise ConfigurationError("a provider needs an http address and a key")
        if not 0 < self.timeout <= 120 or not 0 < self.connect_timeout <= 120:
            raise ConfigurationError("timeouts have to be positive and 120 seconds at most")

    def __repr__(self) -> str:
        return f"HttpProvider({self.url})"

    def __call__(self, model: str, payload: str) -> tuple[int, str]:
        body = json.dumps(json.loads(payload) | {"model": model}).encode()
        at = urlsplit(self.url)
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        connection = kind(at.hostname, at.port, timeout=self.connect_timeout)
        try:
            connection.connect()
            connection.sock.settimeout(self.timeout)
            path = (at.path or "/") + (f"?{at.query}" if at.query else "")
            connection.request("POST", path, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            response = connection.getresponse()
            text = response.read().decode("utf-8", "replace")
            return response.status, text if 200 <= response.status <= 299 else ""
        except (OSError, http.client.HTTPException):
            return 0, ""
        finally:
            connection.close()

    def require(self, model: str, payload: str) -> str:
        """The body, or the error that the status stands for."""
        status, body = self(model, payload)
        if not 200 <= status <= 299:
            raise CallFailed(f"the service gave status {status}" if status else "the service gave no response", status)
        if not body.strip():
            raise UnusableResponse("the service gave an empty response")
        return body


@dataclass(frozen=True)
class Settings:
    """Where answers come from: PROVIDER_URL, PROVIDER_KEY, LLM_MODEL, and LLM_FALLBACK_MODEL, LLM_TIMEOUT_SECONDS if wanted."""

    post: HttpProvider
    models: tuple[str, ...]

    @classmethod
    def of(cls, given: Mapping[str, str]) -> Settings | None:
        """From named settings (names in lower case); None if no address is given, an error if only part of the rest is."""
        if not given.get("provider_url"):
            return None
        models = tuple(m for name in ("llm_model", "llm_fallback_model") if (m := given.get(name, "").strip()))
        if not given.get("llm_model", "").strip():
            raise ConfigurationError("LLM_MODEL is not set")
        try:
            timeout = float(given.get("llm_timeout_seconds") or 30)
        except ValueError:
            raise ConfigurationError("LLM_TIMEOUT_SECONDS has to be a number") from None
        return cls(HttpProvider(given["provider_url"], given.get("provider_key", ""), timeout, min(10.0, timeout)), models)


Post = Callable[[str, str], tuple[int, str]]


def transient(status: int) -> bool:
    return status == 0 or status in RETRYABLE or 500 <= status <= 599


def calls(post: Post, model: str, attempts: int, window: int):
    """For mapInPandas over (query_id, payload): query_id, body, provider_status, attempts.

    Each task runs an event loop that keeps up to `window` calls open; a call is repeated while its failure is
    transient, up to `attempts` times. Rows come back in their order. The model's name takes the place of {model}.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(window) as pool:
            for pdf in batches:
                yield pd.DataFrame(asyncio.run(every(pool, pdf)), columns=["query_id", "body", "provider_status", "attempts"])

    async def every(pool, pdf):
        return await asyncio.gather(*(one(pool, key, payload) for key, payload in zip(pdf["query_id"], pdf["payload"])))

    async def one(pool, key, payload):
        loop = asyncio.get_running_loop()
        asked = payload.replace('"{model}"', json.dumps(model), 1)
        for attempt in range(1, attempts + 1):
            # the pool has a thread for each open call; the rest wait their turn
            status, body = await loop.run_in_executor(pool, post, model, asked)
            if not transient(status):
                break
        return key, body if 200 <= status <= 299 else None, status, attempt

    return run
