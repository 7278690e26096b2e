"""What a caller may plug in, by name, and the seam to a model: nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from quillstone.functions import text as T


class ModelError(Exception):
    """A request to a model that gave no reply."""


class AuthenticationFailed(ModelError):
    pass


class ModelNotFound(ModelError):
    pass


class RateLimited(ModelError):
    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class InvalidRequest(ModelError):
    pass


class ProviderUnavailable(ModelError):
    pass


class MalformedReply(ModelError):
    pass


class BudgetExhausted(Exception):
    """The hard cap of requests is reached. No ModelError, so that nothing takes it for a failed request."""


def error_for(status: int, message: str = "") -> ModelError:
    """The error that an HTTP status stands for."""
    kinds = {401: AuthenticationFailed, 403: AuthenticationFailed, 404: ModelNotFound, 429: RateLimited, 400: InvalidRequest, 422: InvalidRequest}
    return kinds.get(status, ProviderUnavailable if status >= 500 else ModelError)(message)


class Registry:
    """Named things of one kind; a name is given once."""

    def __init__(self, kind: str):
        self.kind, self.held = kind, {}

    def add(self, name: str, thing: Any) -> Any:
        if name in self.held:
            raise ValueError(f"there is a {self.kind} named {name!r}")
        self.held[name] = thing
        return thing

    def get(self, name: str) -> Any:
        if name not in self.held:
            raise KeyError(f"no {self.kind} named {name!r}; known: {', '.join(sorted(self.held)) or 'none'}")
        return self.held[name]


scorers, tokenizers, strategies, judges, providers, renderers = (Registry(k) for k in ("scorer", "tokenizer", "strategy", "judge", "provider", "renderer"))


def unavailable(reason: str) -> Callable[[Column], Column]:
    """A tokenizer that cannot count: it raises when it is used, not when it is named."""

    def count(text: Column) -> Column:
        raise RuntimeError(reason)

    return count


@dataclass
class Fake:
    """A provider without a model: replies from a queue, from a function of the request, or always the same; it keeps its requests."""

    replies: list[str] = field(default_factory=list)
    responder: Callable[[Any], str] | None = None
    fixed: str | None = None
    requests: list = field(default_factory=list)

    def __call__(self, request: Any) -> str:
        self.requests.append(request)
        if self.replies:
            return self.replies.pop(0)
        if self.responder is not None:
            return self.responder(request)
        if self.fixed is not None:
            return self.fixed
        raise ModelError("the fake has no reply left")


@dataclass
class Failing:
    """A provider whose every request fails."""

    error: ModelError = field(default_factory=lambda: ProviderUnavailable("not there"))

    def __call__(self, request: Any) -> str:
        raise self.error


@dataclass
class Limited:
    """A provider with a hard cap on requests."""

    provider: Callable[[Any], str]
    most: int
    used: int = 0

    def __call__(self, request: Any) -> str:
        if self.used >= self.most:
            raise BudgetExhausted(f"all {self.most} requests are used")
        self.used += 1
        return self.provider(request)


def keyword_judge(needles: dict[str, Sequence[str]]) -> Callable[[Column, Column], Column]:
    """A judge of (question_id, response): passed if any of the question's words is contained; null, undecided, without a rule."""
    from pyspark.sql import functions as F

    def judge(question: Column, response: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for name, words in needles.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(F.lower(response), F.lit(w.lower()))
            out = F.when(question == name, hit).otherwise(out)
        return out

    return judge


def model_judge(provider: Callable[[Any], str]) -> Callable[[str, str], bool | None]:
    """A judge that asks a provider one question at a time; a failed request or another answer than YES or NO is undecided."""

    def judge(question: str, response: str) -> bool | None:
        try:
            reply = provider({"question": question, "response": response})
        except ModelError:
            return None
        first = next((x for x in reply.split("\n") if x.strip()), "")
        word = "".join(c for c in first if c.isalpha()).upper()
        return {"YES": True, "NO": False}.get(word)

    return judge


scorers.add("lexical", T.score)
tokenizers.add("words", T.word_count)
tokenizers.add("chars", T.char_tokens)
