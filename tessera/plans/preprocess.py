"""The preprocessing request of the reference, in its fixed order:

tokens -> drop -> missing values -> outliers -> skewness -> encoding ->
scaling -> class balance -> duplicates -> (optional) save.

Each fitted step runs one small aggregation job over the lineage so far and
then adds a projection; no step collects rows.  Column defaults follow the
reference, except that ``{c}_missing`` indicator columns are left out of the
outlier, skewness and scaling defaults and a string target is never encoded.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from tessera.functions.schema import numeric_columns
from tessera.operators import balance, clean, encode, outliers, scale, skew

INDICATOR_SUFFIX = "_missing"


@dataclass(frozen=True)
class PreprocessConfig:
    """All keys optional, as in the reference's JSON config."""

    target_column: str | None = None
    drop_columns: tuple[str, ...] = ()
    missing_strategy: str | None = None
    missing_columns: tuple[str, ...] = ()
    missing_indicator: bool = False
    outlier_method: str | None = None
    outlier_columns: tuple[str, ...] = ()
    outlier_detection: str = "iqr"
    outlier_transform_method: str = "log"
    skewness_method: str | None = None
    skewness_columns: tuple[str, ...] = ()
    encoding_method: str | None = None
    encoding_columns: tuple[str, ...] = ()
    scaler: str | None = None
    scaling_columns: tuple[str, ...] = ()
    imbalance_method: str | None = None
    random_state: int = 42
    duplicate_handling: str = "none"
    # Not in the reference: row order and row key must be explicit in Spark.
    order_by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    dedupe_before_balance: bool = False
    exact_quantiles: bool = True

    @classmethod
    def from_dict(cls, config: dict) -> "PreprocessConfig":
        known = {f.name for f in fields(cls)}
        values = {}
        for k, v in config.items():
            if k not in known:
                continue
            values[k] = tuple(v) if isinstance(v, list) else v
        return cls(**values)


def _without_indicators(df: DataFrame, cols: tuple[str, ...]) -> list[str] | None:
    if cols:
        return list(cols)
    return [c for c in numeric_columns(df) if not c.endswith(INDICATOR_SUFFIX)]


def preprocess(df: DataFrame, config: PreprocessConfig | dict) -> DataFrame:
    """Apply the configured steps and return the processed DataFrame."""
    cfg = config if isinstance(config, PreprocessConfig) else PreprocessConfig.from_dict(config)
    target = cfg.target_column
    df = clean.standardize_missing(df)
    df = clean.drop_columns(df, list(cfg.drop_columns))
    df = clean.impute(df, cfg.missing_strategy, list(cfg.missing_columns),
                      cfg.missing_indicator, list(cfg.order_by) or None, cfg.exact_quantiles)
    df = outliers.handle_outliers(df, cfg.outlier_method,
                                  _without_indicators(df, cfg.outlier_columns),
                                  cfg.outlier_detection, cfg.outlier_transform_method,
                                  cfg.exact_quantiles)
    skew_cols = list(cfg.skewness_columns) or [
        c for c in numeric_columns(df, exclude=[target] if target else [])
        if not c.endswith(INDICATOR_SUFFIX)]
    df = skew.handle_skewness(df, cfg.skewness_method, skew_cols, target)
    # As in the reference, an empty list in the request means its default; the
    # operators get the columns by name, so that no column means none.
    df = encode.encode(df, cfg.encoding_method,
                       list(cfg.encoding_columns) or encode.encoding_columns(
                           df, None, exclude=[target] if target else []), target)
    scale_cols = list(cfg.scaling_columns) or [
        c for c in numeric_columns(df) if not c.endswith(INDICATOR_SUFFIX)]
    df = scale.scale(df, cfg.scaler, scale_cols, target, cfg.exact_quantiles)

    def dedupe(frame: DataFrame) -> DataFrame:
        return clean.deduplicate(frame, cfg.duplicate_handling, None, None)

    if cfg.dedupe_before_balance:
        df = dedupe(df)
    df = balance.balance(df, cfg.imbalance_method, target, list(cfg.key) or None,
                         seed=cfg.random_state)
    if not cfg.dedupe_before_balance:
        df = dedupe(df)
    return df


def preprocess_dataset(spark, root: str, name: str, config: PreprocessConfig | dict,
                       fmt: str | None = None) -> str:
    """The reference's request: load from the zones, preprocess, save as
    ``processed_{name}``; returns the processed name."""
    from tessera.sources.files import load_dataset, save_dataset

    out = preprocess(load_dataset(spark, root, name), config)
    return save_dataset(out, root, name, "prefix", fmt)
