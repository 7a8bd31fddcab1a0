"""HTTP clients of model servers; `post(url, payload)` yields the reply's JSON objects, so tests need no network."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from lorekeep.config import Settings

Post = Callable[[str, dict], Iterator[dict]]


def http_post(url: str, payload: dict, timeout: float = 300.0) -> Iterator[dict]:
    """The JSON objects of a reply, one a line as they arrive."""
    ask = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask, timeout=timeout) as reply:  # noqa: S310 - the address is the user's own setting
        for line in reply:
            if line.strip():
                yield json.loads(line)


class ChatClient:
    """chat(model, messages, **options) for `answer.Engine`: pieces of text as the server sends them."""

    def __init__(self, base_url: str, settings: Settings = Settings(), post: Post = http_post, context: int = 8192):
        self.base_url, self.settings, self.post, self.context = base_url.rstrip("/"), settings, post, context

    def payload(self, model: str, messages: list[dict], temperature: float | None = None, max_tokens: int | None = None) -> dict:
        s = self.settings
        options = {"temperature": s.temperature if temperature is None else temperature, "num_ctx": self.context, "num_predict": max_tokens or s.max_answer_tokens}
        return {"model": model, "messages": messages, "stream": True, "options": options}

    def __call__(self, model: str, messages: list[dict], **options) -> Iterator[str]:
        for event in self.post(f"{self.base_url}/api/chat", self.payload(model, messages, **options)):
            if piece := event.get("message", {}).get("content"):
                yield piece
            if event.get("done"):
                return


class EmbedClient:
    """embed(texts): vectors of texts that carry their prefix; both shapes of replies are read."""

    def __init__(self, base_url: str, model: str, post: Post = http_post, tags: Callable[[], list[str]] | None = None):
        self.base_url, self.model, self.post, self.tags = base_url.rstrip("/"), model, post, tags

    def __call__(self, texts: list[str]) -> list[list[float]]:
        reply = next(iter(self.post(f"{self.base_url}/api/embed", {"model": self.model, "input": texts})))
        if "embeddings" in reply:
            return reply["embeddings"]
        if len(texts) == 1 and "embedding" in reply:
            return [reply["embedding"]]
        raise RuntimeError("the embedding server sent no vectors")

    def health(self) -> tuple[bool, str]:
        """Whether the server answers and has the model, and what to say of it."""
        try:
            names = self.tags() if self.tags else []
        except OSError as e:
            return False, f"not reachable: {e}"
        found = any(n == self.model or n.split(":")[0] == self.model for n in names)
        return found, "ok" if found else f"model {self.model} is missing"
