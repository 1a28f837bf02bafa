"""Providers of answers: each function gives what answered() takes, a maker of a function (system, user) to text, run once in a task.

Clients of hosted models are imported where they are used, on the executors; a
client can be handed in, as tests do.
"""

from __future__ import annotations

from collections.abc import Callable

Generate = Callable[[str, str], str]


def function(fn: Generate) -> Callable[[], Generate]:
    """Any function of a system and a user prompt."""
    return lambda: fn


def _imported(module: str, package: str):
    from importlib import import_module

    try:
        return import_module(module)
    except ImportError as missing:
        raise ImportError(f"this provider needs the package {package}") from missing


def anthropic(model: str, api_key: str | None = None, max_tokens: int = 1024, client=None) -> Callable[[], Generate]:
    """Anthropic's Messages API; the model has no default. Without a key the client reads its own environment variable."""
    if not model:
        raise ValueError("name a model")

    def make() -> Generate:
        api = client or _imported("anthropic", "anthropic").Anthropic(**({"api_key": api_key} if api_key else {}))

        def generate(system: str, user: str) -> str:
            said = api.messages.create(model=model, max_tokens=max_tokens, system=system, messages=[{"role": "user", "content": user}])
            return "".join(b.text for b in said.content if getattr(b, "type", None) == "text")

        return generate

    return make


def gemini(model: str, api_key: str | None = None, client=None) -> Callable[[], Generate]:
    """Google's Gemini API. Without a key GOOGLE_API_KEY is read on the executor."""

    def make() -> Generate:
        import os

        key = api_key or os.environ.get("GOOGLE_API_KEY")
        if not client and not key:
            raise ValueError("set GOOGLE_API_KEY, or give a key")
        api = client or _imported("google.genai", "google-genai").Client(api_key=key)

        def generate(system: str, user: str) -> str:
            return api.models.generate_content(model=model, contents=user, config={"system_instruction": system}).text or ""

        return generate

    return make
