"""Clients of a language model. A client is built once per Python worker and answers one prompt at a time."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Callable


class Client:
    """What a judge needs: ``ask`` gives the model's text for a prompt; ``describe`` that for an image."""

    def ask(self, prompt: str) -> str:
        raise NotImplementedError

    def describe(self, image: bytes, context: str) -> str:
        raise NotImplementedError("this provider describes no images")


class Scripted(Client):
    """Answers from a script: the first key found in the prompt wins; else the default. The testable provider."""

    def __init__(self, answers: dict[str, object] | None = None, default: object | None = None, image: str = "mock: description image"):
        self.answers, self.default, self.image = answers or {}, {} if default is None else default, image

    def ask(self, prompt: str) -> str:
        for key, answer in self.answers.items():
            if key in prompt:
                return answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)
        return self.default if isinstance(self.default, str) else json.dumps(self.default, ensure_ascii=False)

    def describe(self, image: bytes, context: str) -> str:
        return self.image


class Http(Client):
    """A chat endpoint over HTTP, of the chat-completions or of the messages kind; the key is read when it is needed."""

    def __init__(self, config: dict):
        self.config = config
        self.kind = "messages" if config["provider"] == "anthropic" else "chat"
        self.key_name = config.get("api_key_env", "JUDGE_API_KEY")

    def _post(self, body: dict) -> dict:
        key = os.environ.get(self.key_name)
        if key is None:
            raise RuntimeError(f"no key: set the environment variable {self.key_name}")
        base = (self.config.get("base_url") or "").rstrip("/")
        if self.config["provider"] == "azure_openai":
            url = f"{base}/openai/deployments/{self.config.get('model')}/chat/completions?api-version={self.config.get('api_version', '2024-06-01')}"
            head = {"api-key": key}
        elif self.kind == "chat":
            url, head = f"{base}/chat/completions", {"Authorization": f"Bearer {key}"}
        else:
            url, head = f"{base}/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **head})
        with urllib.request.urlopen(request, timeout=float(self.config.get("timeout", 300))) as r:
            return json.load(r)

    def ask(self, prompt: str) -> str:
        body = {"model": self.config.get("model"), "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
        if self.kind == "chat":
            return self._post(body | {"response_format": {"type": "json_object"}})["choices"][0]["message"]["content"]
        return self._post(body | {"max_tokens": int(self.config.get("max_tokens", 4096))})["content"][0]["text"]


class CommandLine(Client):
    """A command that reads the prompt on its standard input and prints the answer, or JSON with it in ``result``."""

    def __init__(self, config: dict):
        self.command = [str(x) for x in config["command"]]
        self.timeout = float(config.get("timeout", 300))

    def ask(self, prompt: str) -> str:
        done = subprocess.run(self.command, input=prompt, capture_output=True, text=True, timeout=self.timeout)
        if done.returncode:
            raise RuntimeError(f"the command failed ({done.returncode}): {done.stderr[:500]}")
        try:
            envelope = json.loads(done.stdout)
        except ValueError:
            return done.stdout
        if isinstance(envelope, dict) and envelope.get("is_error"):
            raise RuntimeError(f"the command reports an error: {str(envelope.get('result', ''))[:500]}")
        return (envelope.get("result") or "") if isinstance(envelope, dict) and "result" in envelope else done.stdout


class Manual(Client):
    """Answers of a manifest filled by hand: describes images it knows, judges nothing."""

    def __init__(self, filled: dict[str, str]):
        self.filled = filled

    def ask(self, prompt: str) -> str:
        raise RuntimeError("the manual provider judges no text")

    def describe(self, image: bytes, context: str) -> str:
        return self.filled.get(context.split("|", 1)[1] if "|" in context else "", "")


def read_manifest(path: str | None) -> dict[str, str]:
    """Descriptions that a person has filled in: placeholder -> text. None, a missing or a broken file has none."""
    from docgauge.sinks import paths

    try:
        fs, p = paths.at(path or "")
        with fs.open_input_stream(p) as f:
            rows = json.loads(f.read())
        return {r["placeholder"]: r["description"].strip() for r in rows if r.get("placeholder") and (r.get("description") or "").strip()}
    except (OSError, ValueError, AttributeError, TypeError):
        return {}


def factory(config: dict) -> Callable[[], Client]:
    """A function that builds the configured client on a worker; an unknown provider is refused at once."""
    provider = config.get("provider", "mock")
    if provider == "mock":
        return lambda: Scripted(config.get("answers"), config.get("default"))
    if provider in ("openai", "azure_openai", "anthropic"):
        return lambda: Http(config)
    if provider in ("command", "claude_cli"):
        return lambda: CommandLine({"command": ["claude", "-p", "--output-format", "json"], **config})
    if provider == "manual":
        filled = config.get("filled") or read_manifest(config.get("manifest"))
        return lambda: Manual(filled)
    raise ValueError(f"unknown provider: {provider}")
