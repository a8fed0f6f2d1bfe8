"""The feature-engineering request of the reference: optional generation,
then selection, then reduction.

Differences from the reference, on purpose: the target is an explicit
argument and is carried through untouched (the reference takes "the last
column", which after polynomial generation is a generated square), and
string columns are kept aside instead of breaking the numeric steps.
t-SNE is not offered (a single-machine all-pairs method).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.functions.expressions import col
from tessera.functions.schema import numeric_columns
from tessera.operators import features

GENERATIONS = ("none", "polynomial", "interaction", "datetime")
SELECTIONS = ("none", "variance", "kbest", "rfe")
REDUCTIONS = ("none", "pca", "lda")


@dataclass(frozen=True)
class EngineeringResult:
    frame: DataFrame
    columns: list[str]


def engineer(df: DataFrame, generation: str = "none", selection: str = "none",
             reduction: str = "none", target: str | None = None,
             carry: tuple[str, ...] = ()) -> EngineeringResult:
    """``carry`` names row keys that pass through every step untouched."""
    keep = [*carry, target] if target else list(carry)
    if generation in ("polynomial", "interaction"):
        df = features.polynomial(df, numeric_columns(df, exclude=keep),
                                 interaction_only=generation == "interaction", keep=keep)
    elif generation == "datetime":
        df = features.datetime_parts(df)
    elif generation not in (None, "none"):
        raise ValueError(f"unknown feature generation: {generation}")

    if selection == "variance":
        df = features.variance_select(df, keep=keep)
    elif selection in ("kbest", "rfe"):
        if not target:
            raise ValueError(f"{selection} selection needs a target column")
        cols = numeric_columns(df, exclude=keep)
        if selection == "kbest":
            chosen = features.kbest_select(df, target, cols).columns
            df = df.select(*[col(c) for c in [*keep, *[c for c in chosen if c not in keep]]])
        else:
            chosen = features.rfe_select(df, target, cols)
            df = df.select(*[col(c) for c in [*keep, *chosen]])
    elif selection not in (None, "none"):
        raise ValueError(f"unknown feature selection: {selection}")

    if reduction in ("pca", "lda"):
        if reduction == "lda" and not target:
            raise ValueError("lda needs a target column")
        cols = numeric_columns(df, exclude=keep)
        model = (features.fit_pca(df, cols) if reduction == "pca"
                 else features.fit_lda(df, target, cols))
        df = model.transform(df, keep)
    elif reduction not in (None, "none"):
        raise ValueError(f"unknown dimensionality reduction: {reduction}")
    return EngineeringResult(df, list(df.columns))


def engineer_dataset(spark, root: str, name: str, generation: str = "none",
                     selection: str = "none", reduction: str = "none",
                     target: str | None = None) -> dict:
    """Load from the raw zone, engineer, save as ``{stem}_processed.{ext}``;
    returns the name, shape and a 5-row preview (the only rows collected)."""
    from tessera.sources.files import load_dataset, save_dataset

    result = engineer(load_dataset(spark, root, name), generation, selection, reduction, target)
    out_name = save_dataset(result.frame, root, name, "suffix")
    saved = load_dataset(spark, root, out_name)
    return {"processed_dataset": out_name, "shape": (saved.count(), len(saved.columns)),
            "preview": [r.asDict() for r in saved.limit(5).collect()]}
