"""Encoders and generators as plug-ins, with deterministic offline defaults."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import text


@dataclass(frozen=True)
class EncoderConfig:
    """What a neural encoder is loaded with; remote code is never trusted by default."""

    model: str = "offline-hashing"
    max_visual_tokens: int = 1280
    dtype: str = "bfloat16"
    attention: str = "sdpa"
    trust_remote_code: bool = False
    batch_size: int = 2


class Encoder(Protocol):
    def is_available(self) -> bool: ...

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        """(query_id, query) to (query_id, unit_vec)."""

    def encode_images(self, pages: DataFrame) -> DataFrame:
        """(source, page, image) to (source, page, patch, vec), from patch 0 on; a model is loaded once in each worker."""


class HashingTextEncoder:
    """Signed hashed token counts at length one; no model, no network."""

    def __init__(self, config: EncoderConfig | None = None):
        self.config = config or EncoderConfig()

    def is_available(self) -> bool:
        return True

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        return text.encode(queries, "query_id", "query")

    def encode_images(self, pages: DataFrame) -> DataFrame:
        """Takes an image's bytes as text, as `text_pages` renders it; what empty lines part is a patch."""
        parts = F.split(F.make_valid_utf8(F.col("image").cast("string")), r"\n\s*\n")
        each = pages.select("source", "page", F.posexplode(parts).alias("patch", "part")).select(F.struct("source", "page", "patch").alias("id"), "part")
        return text.encode(each, "id", "part").select("id.source", "id.page", "id.patch", F.col("unit_vec").cast("array<float>").alias("vec"))


def text_pages(content: bytes, dpi: int) -> list[bytes]:
    """The offline stand-in for a renderer: the pages of a plain text are what form feeds part."""
    return content.split(b"\f") if content else []


class AnswerGenerator(Protocol):
    def generate(self, prompt: str, pages: list[dict]) -> str:
        """pages: rank, source, page and image (bytes, None where images aren't opened) of each hit, best first."""

    def healthcheck(self) -> str: ...


class CitationGenerator:
    """Names the pages found; the offline stand-in for a hosted model."""

    def generate(self, prompt: str, pages: list[dict]) -> str:
        return "See " + "; ".join(f"{p['source']} page {p['page']}" for p in pages) + "."

    def healthcheck(self) -> str:
        return self.generate("health", [{"source": "none", "page": 0}])


class HostedGenerator:
    """A hosted model behind call(prompt, pages, key). The key comes from an environment variable of the worker, read when an answer is made and not before."""

    def __init__(self, call: Callable[[str, list[dict], str], str], variable: str):
        self.call, self.variable = call, variable

    def generate(self, prompt: str, pages: list[dict]) -> str:
        key = os.environ.get(self.variable)
        if not key:
            raise RuntimeError(f"{self.variable} is not set")
        return self.call(prompt, pages, key)

    def healthcheck(self) -> str:
        return self.generate("health", [])


_generators: dict[str, Callable] = {"citations": CitationGenerator}
_encoders: dict[str, Callable] = {"hashing": HashingTextEncoder}
_renderers: dict[str, Callable] = {"text": lambda: text_pages}


def _made(kind: str, known: dict[str, Callable], name: str, *args):
    """What a name stands for, or what the factory at module:attribute makes."""
    if ":" in name:
        module, attribute = name.split(":", 1)
        return getattr(importlib.import_module(module), attribute)(*args)
    if name not in known:
        raise ValueError(f"no {kind} {name}; there are {sorted(known)}")
    return known[name](*args)


def generators() -> list[str]:
    return sorted(_generators)


def generator(name: str) -> AnswerGenerator:
    return _made("generator", _generators, name)


def encoder(name: str, config: EncoderConfig | None = None) -> Encoder:
    return _made("encoder", _encoders, name, config)


def renderer(name: str) -> Callable[[bytes, int], Sequence[bytes]]:
    return _made("renderer", _renderers, name)
