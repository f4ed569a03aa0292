"""A client of services that speak the common JSON protocol of chat completions and embeddings. Picklable, so it can run on executors."""
from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from noteloom.operators.remote import ProviderOptions, RemoteError, embed_with_retries, with_retries

SUMMARISE = "Summarise the text briefly. List its main points."
REWRITE = "Rewrite the search query as a few precise keywords. Answer with the keywords only."


@dataclass(frozen=True)
class Reply:
    content: str
    model: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    finish_reason: str | None = None


@dataclass(frozen=True)
class Service:
    base_url: str
    api_key: str
    model: str
    timeout: float = 30.0
    retries: int = 3
    provider: ProviderOptions | None = None

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, raw = answer.status, answer.read()
        except urllib.error.HTTPError as error:
            status, raw = error.code, error.read()
            if status == 429:
                after = error.headers.get("Retry-After", "")
                raise RemoteError("rate_limit", retry_after=float(after) if after.isdigit() else None) from error
            if status == 401:
                raise RemoteError("authentication") from error
        except OSError as error:  # refused, timed out, cut off
            raise RemoteError("network", str(error)) from error
        try:
            found = json.loads(raw)
        except ValueError as error:
            raise RemoteError("parse" if status < 400 else "api", f"{status}: {raw[:200]!r}") from error
        problem = found.get("error") if isinstance(found, dict) else None
        if problem:
            raise RemoteError("model_not_found" if problem.get("code") == "model_not_found" else "api", problem.get("message", ""))
        if status >= 400:
            raise RemoteError("api", str(status))
        return found

    def complete(self, text: str, system: str = SUMMARISE, max_tokens: int = 500, temperature: float = 0.3) -> Reply:
        """One answer, with retries."""
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "max_tokens": max_tokens, "temperature": temperature}
        if self.provider and (options := self.provider.to_json()):
            body["provider"] = options
        found = with_retries(self._post, "chat/completions", body, retries=self.retries)
        try:
            choice, usage = found["choices"][0], found.get("usage") or {}
            content = choice["message"]["content"]
        except (KeyError, IndexError, TypeError) as error:
            raise RemoteError("parse", "no content in the answer") from error
        if content is None:
            raise RemoteError("parse", "no content in the answer")
        return Reply(content, found.get("model") or "", usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0, choice.get("finish_reason"))

    def summarise(self, text: str) -> str:
        return self.complete(text).content

    def rewrite(self, query: str) -> str:
        return self.complete(query, REWRITE, max_tokens=100).content.strip()

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts, with retries."""
        if not texts:
            return []
        found = embed_with_retries(lambda t: self._post("embeddings", {"model": self.model, "input": t}), texts)
        try:
            return [row["embedding"] for row in found["data"]]
        except (KeyError, TypeError) as error:
            raise RemoteError("parse", "no vectors in the answer") from error

    def embed_query(self, query: str) -> list[float]:
        return self.embed([query])[0]
