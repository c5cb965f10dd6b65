"""Calls of a language model as a column: answers, and what became of each call, so that no failure is lost as an empty answer."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a client gives for a prompt: the answer, tokens in and out, and why it ended.
Answer = tuple[str, int, int, str]
RESULT = "answer string, tokens_in int, tokens_out int, finish string, tries int, status string"


class Refused(Exception):
    """A call that no repetition helps (credentials, configuration, an unknown model): the job stops."""


def complete(prompts: DataFrame, id_col: str, client: Callable[[], Callable[[str], Answer]], tries: int = 4, first_wait: float = 1.0, longest_wait: float = 60.0) -> DataFrame:
    """(id, answer, tokens_in, tokens_out, finish, tries, status) of prompts (id, prompt).

    client() is called once in each task and gives the function that is asked. A failed call is repeated after a wait that doubles, with a random part, up to
    `tries` times; then status is the kind of the last error and the answer null. Refused ends the job. Null prompts aren't asked: status "no prompt".
    """
    kind = prompts.schema[id_col].dataType.simpleString()

    def one(ask: Callable[[str], Answer], prompt: str | None) -> tuple:
        if prompt is None:
            return None, None, None, None, 0, "no prompt"
        wait, error = first_wait, ""
        for n in range(1, tries + 1):
            try:
                return (*ask(prompt), n, "ok")
            except Refused:
                raise
            except Exception as e:  # noqa: BLE001 - whatever the client raises is the status
                error = type(e).__name__
            if n < tries:
                time.sleep(min(longest_wait, wait) * (0.5 + random.random() / 2))
                wait *= 2
        return None, None, None, None, tries, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        names = [c.split()[0] for c in RESULT.split(", ")]
        for f in frames:
            out = pd.DataFrame([one(ask, p) for p in f["prompt"]], columns=names).astype({c: "Int32" for c in ("tokens_in", "tokens_out", "tries")})
            yield pd.concat([f[[id_col]].reset_index(drop=True), out], axis=1)

    return prompts.select(id_col, "prompt").mapInPandas(run, f"{id_col} {kind}, {RESULT}")
