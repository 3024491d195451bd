"""Settings from the environment, with overrides; what may be shown leaves secrets out."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from typing import Any, get_type_hints

from veritome.model import Params
from veritome.operators.cost import Price
from veritome.operators.selection import FirstPages, Hybrid, Keyword, Semantic, Strategy

PREFIX = "VERITOME_"


@dataclass(frozen=True)
class Settings:
    data: str = "data"
    backend: str = "stub"
    model: str = "stub"
    base_url: str = ""
    api_key: str = ""
    temperature: float = 0.0
    max_new_tokens: int = 1024
    seed: int = 42
    n_pages: int = 3
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 6
    semantic_chars: int = 8000
    hybrid_chars: int = 12_000
    tail_pages: int = 0
    cue_windows: int = 10
    input_price: float = 3.0
    output_price: float = 15.0
    price_source: str = "tabela pública"

    @property
    def params(self) -> Params:
        return Params(self.temperature, self.max_new_tokens, self.seed)

    @property
    def price(self) -> Price:
        return Price(self.input_price, self.output_price, self.price_source)

    def strategy(self, name: str) -> Strategy:
        """A context selection strategy with these settings."""
        semantic = lambda chars: Semantic(top_k=self.top_k, chunk_size=self.chunk_size, overlap=self.chunk_overlap, max_chars=chars)
        made = {
            "first_pages": lambda: FirstPages(self.n_pages),
            "keyword": Keyword,
            "semantic": lambda: semantic(self.semantic_chars),
            "hybrid": lambda: Hybrid(semantic=semantic(None), max_chars=self.hybrid_chars, tail_pages=self.tail_pages, cue_windows=self.cue_windows),
        }
        if name not in made:
            raise ValueError(f"unknown strategy {name!r}; there are {', '.join(made)}")
        return made[name]()

    def public(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k != "api_key"}


def settings(**overrides: Any) -> Settings:
    """Defaults, then ``VERITOME_<NAME>`` variables, then ``overrides``."""
    kinds = get_type_hints(Settings)
    read = {f.name: kinds[f.name](os.environ[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in os.environ}
    return Settings(**read | overrides)
