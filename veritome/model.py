"""Model calls: a client protocol, a stub whose faults are planned, and clients for two HTTP interfaces."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from functools import cache
from hashlib import sha256
from typing import NamedTuple, Protocol

from veritome.functions.matching import blocks
from veritome.prompts import CLOSE, OPEN, PLAIN_ARTICLE


class Params(NamedTuple):
    temperature: float = 0.0
    max_new_tokens: int = 1024
    seed: int | None = 42
    top_p: float = 1.0


class Completion(NamedTuple):
    text: str
    input_tokens: int
    output_tokens: int
    latency_s: float
    finish_reason: str = "stop"


class Client(Protocol):
    """What a run needs of a model; a client is sent to the workers, so it must pickle."""

    @property
    def model_name(self) -> str: ...

    def generate(self, system: str | None, user: str, params: Params) -> Completion: ...


def estimated_tokens(text: str, chars_per_token: float = 4.0) -> int:
    return max(1, round(len(text) / chars_per_token)) if text else 0


@dataclass(frozen=True)
class Stub:
    """Answers from the article itself.  Faults strike a given share of prompts.

    Which prompts is decided by a hash of prompt, seed and temperature, so a retried task
    answers as before, at any temperature; ``draw`` stands for another sample.
    """

    broken_json: float = 0.0
    invented_quote: float = 0.0
    invented_limitation: float = 0.0
    unstable: float = 0.0
    truncated: float = 0.0
    noise: bool = True
    draw: int = 0
    model_name: str = field(default="stub/hash-v1")

    def _strikes(self, fault: str, rate: float, user: str, params: Params) -> bool:
        warm = params.temperature > 0 and self.noise
        key = f"{fault}|{params.seed}|{params.temperature}|{self.draw if warm else 0}|{user}"
        share = int.from_bytes(sha256(key.encode()).digest()[:8]) / 2**64
        return share < min(1.0, rate + 0.3 * params.temperature * warm * (rate > 0))

    @staticmethod
    def article(user: str) -> str:
        """The last delimited article, else what follows the last plain label."""
        if OPEN in user:
            return user.rpartition(OPEN)[2].partition(CLOSE)[0]
        return user.rpartition(f"\n{PLAIN_ARTICLE}\n")[2]

    def generate(self, system: str | None, user: str, params: Params) -> Completion:
        began = time.perf_counter()
        strikes = lambda fault: self._strikes(fault, getattr(self, fault), user, params)
        parts = blocks(self.article(user).strip())
        page, text = next(((p, t) for p, t in parts if len(t) >= 20), (1, "nothing that could be quoted was sent"))
        sentence = next((s for s in re.split(r"(?<=[.!?])\s+", text) if len(s) >= 20), text)[:300]
        limits = next((s for _, t in parts for s in re.split(r"(?<=[.!?])\s+", t) if re.search(r"\blimited by\b", s)), None)
        card = {
            "problema": "Explicar o que o texto descreve" + (" de outro modo." if strikes("unstable") else "."),
            "dados": "Registros citados no texto.",
            "metodo": "O método descrito no texto.",
            "metrica": "O erro relatado no texto.",
            "limitacao": limits or ("A amostra é pequena e regional." if strikes("invented_limitation") else None),
            "evidencia": {"trecho": "A sentence that nobody ever wrote in this article at all." if strikes("invented_quote") else sentence, "pagina": max(1, page)},
        }
        out = json.dumps(card, ensure_ascii=False)
        reason = "stop"
        if strikes("truncated"):
            out, reason = out[: len(out) // 2], "length"
        elif strikes("broken_json"):
            out = f"```json\n{out[:-1]},}}\n```"
        return Completion(out, estimated_tokens((system or "") + user), estimated_tokens(out), time.perf_counter() - began, reason)


def _post(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class ChatCompletions:
    """A server with the common chat completions interface.  The key comes from the environment only."""

    model_name: str
    base_url: str = "http://localhost:8000/v1"
    key_variable: str = "VERITOME_API_KEY"
    timeout: float = 120.0

    def generate(self, system: str | None, user: str, params: Params) -> Completion:
        began = time.perf_counter()
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}]
        body = {"model": self.model_name, "messages": messages, "temperature": params.temperature, "max_tokens": params.max_new_tokens, "top_p": params.top_p} | ({"seed": params.seed} if params.seed is not None else {})
        headers = {"authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        try:
            got = _post(f"{self.base_url}/chat/completions", headers, body, self.timeout)
        except urllib.error.HTTPError as e:
            if e.code != 400 or "seed" not in body:
                raise
            got = _post(f"{self.base_url}/chat/completions", headers, {k: v for k, v in body.items() if k != "seed"}, self.timeout)  # some servers refuse a seed
        choice, usage = got["choices"][0], got.get("usage") or {}
        text = choice["message"].get("content") or ""
        return Completion(text, usage.get("prompt_tokens", estimated_tokens(user)), usage.get("completion_tokens", estimated_tokens(text)), time.perf_counter() - began, choice.get("finish_reason") or "stop")


@dataclass(frozen=True)
class Messages:
    """A server with a messages interface: the system text apart, content in typed blocks."""

    model_name: str
    base_url: str
    key_variable: str = "VERITOME_API_KEY"
    version: str = "2023-06-01"
    timeout: float = 120.0

    def generate(self, system: str | None, user: str, params: Params) -> Completion:
        began = time.perf_counter()
        body = {"model": self.model_name, "max_tokens": params.max_new_tokens, "temperature": params.temperature, "messages": [{"role": "user", "content": user}]} | ({"system": system} if system else {})
        got = _post(f"{self.base_url}/messages", {"x-api-key": os.environ.get(self.key_variable, ""), "anthropic-version": self.version}, body, self.timeout)
        text = "".join(b.get("text", "") for b in got["content"] if b.get("type") == "text")
        usage = got.get("usage") or {}
        return Completion(text, usage.get("input_tokens", estimated_tokens(user)), usage.get("output_tokens", estimated_tokens(text)), time.perf_counter() - began, "length" if got.get("stop_reason") == "max_tokens" else "stop")


@dataclass(frozen=True)
class Local:
    """A model on the worker's own device, loaded once per worker; needs the optional transformers."""

    model_name: str
    four_bit: bool = False

    def generate(self, system: str | None, user: str, params: Params) -> Completion:
        began = time.perf_counter()
        pipe = _local_pipeline(self.model_name, self.four_bit)
        warm = params.temperature > 0
        options = {"max_new_tokens": params.max_new_tokens, "do_sample": warm, "return_full_text": False, "repetition_penalty": 1.0}
        options |= {"temperature": params.temperature, "top_p": params.top_p} if warm else {}
        text = pipe([{"role": "system", "content": system or ""}, {"role": "user", "content": user}], **options)[0]["generated_text"]
        count = lambda t: len(pipe.tokenizer.encode(t, add_special_tokens=False))
        n = count(text)
        return Completion(text, count((system or "") + user), n, time.perf_counter() - began, "length" if n >= params.max_new_tokens else "stop")


@cache
def _local_pipeline(name: str, four_bit: bool):
    from transformers import pipeline

    return pipeline("text-generation", model=name, model_kwargs={"load_in_4bit": True} if four_bit else {"torch_dtype": "auto"})


BACKENDS = {"stub": Stub, "chat": ChatCompletions, "messages": Messages, "local": Local}


def client(backend: str, **options) -> Client:
    """A client by name; wrong names and options fail here, before any job runs."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[backend](**options)


def params_billions(model: str) -> float | None:
    """Size that a model's name states, in billions of parameters."""
    m = re.search(r"(\d+(?:\.\d+)?)\s*[bB]\b", model)
    return float(m[1]) if m else None


def memory_gb(billions: float, four_bit: bool, overhead: float = 2.5) -> float:
    return billions * (0.75 if four_bit else 2.0) + overhead


def fits(billions: float, four_bit: bool, free_gb: float, overhead: float = 2.5) -> bool:
    return memory_gb(billions, four_bit, overhead) <= free_gb
