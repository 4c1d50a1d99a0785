"""Model providers behind one small interface: availability, catalogue, lookup, streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MODEL = "name string, provider string, available boolean, path string, size_bytes long"


@dataclass
class Provider:
    """What a provider offers: generate a text, list its models (name -> bytes), stream tokens, say whether it answers."""

    generate: Callable[..., str]
    models: Callable[[], dict[str, int]] = dict
    stream: Callable[..., Iterator[str]] | None = None
    probe: Callable[[], Any] = lambda: True
    name: str = "local"

    def available(self) -> bool:
        """Whether the probe succeeds; an exception means no."""
        try:
            return bool(self.probe())
        except Exception:  # whatever the provider's library raises
            return False

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """The models as a table; empty if the provider doesn't answer."""
        try:
            found = self.models()
        except Exception:  # whatever the provider's library raises
            found = {}
        return spark.createDataFrame([(n, self.name, True, n, int(size)) for n, size in sorted(found.items())], MODEL)

    def model(self, spark: SparkSession, name: str) -> DataFrame:
        found = self.catalogue(spark).filter(f"name = '{name}'") if "'" not in name else self.catalogue(spark).limit(0)
        if found.isEmpty():
            raise LookupError(f"model {name!r} isn't on the server")
        return found

    def streamed(self, prompt: str, **options: Any) -> dict:
        """A streamed answer as one record: text, tokens_out, success, error; what came before a failure is kept."""
        tokens, error = [], ""
        try:
            for token in self.stream(prompt, **options) if self.stream else [self.generate(prompt, **options)]:
                tokens.append(token)
        except Exception as e:  # a failed call is a failed record
            error = f"{type(e).__name__}: {e}"
        text = "".join(tokens)
        return {"text": text, "tokens_out": len(text.split()), "success": not error, "error": error}


PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register(name: str, make: Callable[[], Provider]) -> None:
    PROVIDERS[name] = make


def create(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unsupported provider {name!r}")
    return PROVIDERS[name]()
