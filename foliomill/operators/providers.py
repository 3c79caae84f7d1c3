"""Model providers: what the pipeline asks of external models, and offline ones for tests."""

from __future__ import annotations

import inspect
import time
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol


class Provider(Protocol):
    """``embed`` may also take ``input_type``: "passage" for texts that are stored, "query" for those that are searched for."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def complete(self, prompt: str) -> str: ...
    def transcribe(self, image: bytes, prompt: str) -> str: ...


class HashingProvider:
    """Deterministic and offline: hashed words as vectors, an empty object as completion."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.width
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                vector[h % self.width] += 1.0 if h >> 31 else -1.0
            out.append(vector)
        return out

    def complete(self, prompt: str) -> str:
        return "{}"

    def transcribe(self, image: bytes, prompt: str) -> str:
        return "NO_CONTENT"


def is_transient(error: Exception) -> bool:
    """Lost connections, timeouts, too many requests and server errors pass; other errors stay."""
    status = getattr(error, "status_code", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(status, int) and (status == 429 or status >= 500))


def with_retries(call: Callable, attempts: int = 5, least: float = 2.0, most: float = 60.0, retry: Callable[[Exception], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again on passing errors, with waits that double from ``least`` to ``most`` seconds."""

    def run(*args, **kwargs):
        wait = least
        for attempt in range(1, attempts + 1):
            try:
                return call(*args, **kwargs)
            except Exception as error:
                if attempt == attempts or not retry(error):
                    raise
                sleep(wait)
                wait = min(most, 2 * wait)

    return run


def with_timeout(call: Callable, seconds: float) -> Callable:
    """``call`` given up after so many seconds with a TimeoutError; what it does meanwhile is left to itself."""

    def run(*args, **kwargs):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, *args, **kwargs).result(seconds)
        finally:
            pool.shutdown(wait=False)

    return run


def embed_as(provider: Provider, texts: list[str], input_type: str) -> list[list[float]]:
    """The provider's vectors of texts of a type; a provider that knows no types is just asked."""
    parameters = inspect.signature(provider.embed).parameters.values()
    if any(p.name == "input_type" or p.kind is p.VAR_KEYWORD for p in parameters):
        return provider.embed(texts, input_type=input_type)
    return provider.embed(texts)


class Breaker:
    """Calls of one task, given up once ``most`` in a row have failed: what is left is not asked for any more."""

    def __init__(self, most: int | None) -> None:
        self.most, self.failed, self.last = most, 0, None

    def call(self, function: Callable, *args):
        if self.most is not None and self.failed >= self.most:
            raise ConnectionError(f"not asked after {self.failed} failures, the last: {self.last}")
        try:
            out = function(*args)
        except Exception as error:
            self.failed, self.last = self.failed + 1, f"{type(error).__name__}: {error}"
            raise
        self.failed = 0
        return out


class PatientProvider:
    """Another provider's calls with a time limit, tried again on passing errors."""

    def __init__(self, provider: Provider, seconds: float = 120.0, **retries) -> None:
        self.provider, self.seconds, self.retries = provider, seconds, retries

    def _ask(self, name: str, *args):
        return with_retries(with_timeout(getattr(self.provider, name), self.seconds), **self.retries)(*args)

    def embed(self, texts: list[str], input_type: str = "passage") -> list[list[float]]:
        return with_retries(with_timeout(lambda: embed_as(self.provider, texts, input_type), self.seconds), **self.retries)()

    def complete(self, prompt: str) -> str:
        return self._ask("complete", prompt)

    def transcribe(self, image: bytes, prompt: str) -> str:
        return self._ask("transcribe", image, prompt)
