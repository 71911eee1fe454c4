"""Model calls as a source of completions, and requests guarded on both sides of the call. The function is the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.decisions import Limits, screen
from sondage.session import cut_lineage


def complete(requests: DataFrame, model: Callable[[str], str], *, timeout_s: float = 60.0, threads: int = 8, where: str | None = None) -> DataFrame:
    """Requests with ``completion`` and ``model_error``: ``model(prompt)`` called from the workers, several at once.

    ``where`` names a boolean column: only rows where it is true are sent. An exception or a call that takes too long is the
    row's model_error, by the name of the exception; null prompts are sent as empty text. Existing columns of these names are replaced.
    """
    kept = [f for f in requests.schema.fields if f.name not in ("completion", "model_error")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", completion string, model_error string"
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(threads)
        try:
            for b in batches:
                asked = [bool(x) for x in b[where].fillna(False)] if where else [True] * len(b)
                calls = [pool.submit(model, p if isinstance(p, str) else "") if ask else None for p, ask in zip(b["prompt"], asked)]
                texts, errors = [], []
                for f in calls:
                    try:
                        got, failed = (None if f is None else str(f.result(timeout_s))), None
                    except Exception as e:
                        got, failed = None, type(e).__name__
                    texts.append(got)
                    errors.append(failed)
                yield b.assign(completion=pd.Series(texts, index=b.index, dtype="object"), model_error=pd.Series(errors, index=b.index, dtype="object"))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return requests.select(*[F.col(f"`{n}`") for n in names]).mapInPandas(run, out)


def guarded(requests: DataFrame, model: Callable[[str], str], p: Limits = Limits(), **options: float) -> DataFrame:
    """Screened requests whose prompts went to the model only if nothing stood against them before the call.

    The calls are written once, in ``spark.checkpoint.dir``, so no later step and no lost executor repeats those already made. Columns as
    :func:`sondage.operators.decisions.screen` gives them.
    """
    before = screen(requests.drop("completion", "model_error"), p).select("*", (F.col("decision.status") == "APPROVED").alias("_call"))
    made = complete(before.select(*[c for c in requests.columns if c not in ("completion", "model_error")], "_call"), model, where="_call", **options)
    return screen(cut_lineage(made.drop("_call")), p)
