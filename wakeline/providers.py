"""Models behind an interface: what they answer becomes columns.

A provider is a function from a list of requests (dicts of the input columns) to a list of answers (dicts of the output
columns). It runs on executors in batches, after all filters. A request that fails gives an `error` instead of failing the
job; the cluster's task retry covers lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[dict]], list[dict]]
#: Output columns of the kinds of providers.
SAMPLES = "sample_idx int, tokens array<int>, logprobs array<double>, text string"
COMPLETION = "text string"
LOG_PROBS = "x_top array<map<string,double>>, z_top array<map<string,double>>, n_x_context int, n_z_context int, n_x_full int"


def ask(requests: DataFrame, key: str, columns: list[str], provider: Provider, output: str, batch: int = 64) -> DataFrame:
    """key, the output columns and error. An answer names its key; a request may have several answers."""
    names = [f.split()[0] for f in output.split(", ")] if "<" not in output else [x.strip().split()[0] for x in output.split(", ")]
    kind = requests.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    answers = [a | {"error": None} for a in provider(part)]
                except Exception as e:  # noqa: BLE001
                    answers = [{key: r[key], "error": f"{type(e).__name__}: {e}"} for r in part]
                yield pd.DataFrame([{key: a[key], **{n: a.get(n) for n in names}, "error": a["error"]} for a in answers], columns=[key, *names, "error"]).astype(object)

    return requests.select(key, *columns).mapInPandas(run, f"`{key}` {kind}, {output}, error string")


def from_table(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """A provider that is a table of answers: for tests and for answers gathered before."""
    return requests.join(answers, key, "left").withColumn("error", F.lit(None).cast("string"))
