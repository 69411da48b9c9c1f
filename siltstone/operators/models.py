"""Models behind one interface, called partition by partition; fakes for tests without a network."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


log = logging.getLogger(__name__)


class Model(Protocol):
    """Anything that can be sent to the tasks and answers or embeds a list of texts."""

    def answer(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Echo:
    """Answers with the last line of a prompt; vectors come from a hash."""

    def __init__(self, width: int = 8):
        self.width = width

    def answer(self, prompts: list[str]) -> list[str]:
        return [p.rsplit("\n", 1)[-1] for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.width]] for t in texts]


def _each(call: Callable[[list[str]], list], texts: list[str], empty: object) -> list:
    """A batch's results; if the batch fails, each item's by itself, so that one that can't be answered costs only its own. Failures are logged."""
    try:
        found = call(texts)
        if len(found) == len(texts):
            return found
        log.warning("%d results for %d items; asking one by one", len(found), len(texts))
    except Exception:
        log.warning("a batch of %d failed; asking one by one", len(texts), exc_info=True)
    out = []
    for text in texts:
        try:
            out.append(call([text])[0])
        except Exception:
            log.warning("an item failed", exc_info=True)
            out.append(empty)
    return out


def with_answers(df: DataFrame, model: Model, prompt: str, to: str = "answer") -> DataFrame:
    """Adds the model's answers, a batch of rows at a time; an empty one for each row that fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{to: _each(model.answer, batch[prompt].fillna("").tolist(), "")})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{to}` string")


def with_embeddings(df: DataFrame, model: Model, text: str, to: str = "embedding") -> DataFrame:
    """Adds vectors; an empty one for each row that fails, which dense search skips."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{to: _each(model.embed, batch[text].fillna("").tolist(), [])})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{to}` array<double>")
