"""Claims judged on evidence by any callable: validated, tried again with what was wrong, with a default.

A judge is a function of (claim, evidence, faults), where faults are what was wrong with its earlier
answers to the same pair; it gives a mapping of numbers. It runs in the tasks, so that a model behind it
is asked by all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT

Judge = Callable[[str, str, list[str]], Mapping[str, float]]
CONFIDENCE = {"confidence": (0.0, 1.0)}
ANALYSIS = {"support_score": (0.0, 1.0), "contradiction_score": (0.0, 1.0)}


def faults_of(answer: object, bounds: Mapping[str, tuple[float, float]]) -> list[str]:
    """What is wrong with an answer: fields that are missing, no numbers or out of bounds."""
    if not isinstance(answer, Mapping):
        return ["the answer has no fields"]
    out = []
    for name, (low, high) in bounds.items():
        v = answer.get(name)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not low <= v <= high:
            out.append(f"{name} must be a number from {low} to {high}")
    return out


def ask(judge: Judge, claim: str, evidence: str, bounds: Mapping[str, tuple[float, float]], attempts: int, default: float) -> tuple[list[float], int, str | None]:
    """The answer's fields, how often the judge was asked, and the last fault if none of its answers was right."""
    faults: list[str] = []
    for n in range(1, attempts + 1):
        try:
            answer = judge(claim, evidence, list(faults))
            new = faults_of(answer, bounds)
        except Exception as e:  # a judge may fail in any way
            answer, new = None, [f"{type(e).__name__}: {e}"]
        if not new:
            return [float(answer[name]) for name in bounds], n, None
        faults += new
    return [default] * len(bounds), attempts, faults[-1] if faults else "not asked"


def judged(df: DataFrame, keys: list[str], claim: str, evidence: str, judge: Judge, bounds: Mapping[str, tuple[float, float]], attempts: int = 3, default: float = 0.5) -> DataFrame:
    """keys, the fields of bounds, attempts and error of each row.

    A pair that the judge does not answer rightly within `attempts` gets the default in every field,
    and its last fault as error. Null texts count as empty. Equal pairs of a batch are asked once.
    """
    rows = df.select(*keys, F.coalesce(F.col(claim), F.lit("")).alias("_claim"), F.coalesce(F.col(evidence), F.lit("")).alias("_evidence"))
    schema = ", ".join([f"{k} {t}" for k, t in rows.dtypes if not k.startswith("_")] + [f"{b} double" for b in bounds] + ["attempts int", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: dict[tuple[str, str], tuple] = {}
            pairs = list(zip(batch.column("_claim").to_pylist(), batch.column("_evidence").to_pylist()))
            for p in pairs:
                if p not in told:
                    told[p] = ask(judge, *p, bounds, attempts, default)
            out = [told[p] for p in pairs]
            fields = [pa.array([x[0][i] for x in out], pa.float64()) for i in range(len(bounds))]
            more = [pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *fields, *more], names=[*keys, *bounds, "attempts", "error"])

    return rows.mapInArrow(run, schema)


def shared_words(claim: str, evidence: str, faults: list[str]) -> dict[str, float]:
    """A judge without a model: the share of the evidence's words that the claim has, and lacks."""
    words = set(TEXT.query(evidence))
    share = len(words & set(TEXT.query(claim))) / len(words)
    return {"confidence": share, "support_score": share, "contradiction_score": 1 - share}
