"""Extension points: strategies, detectors, judges and metrics by name, with deterministic defaults, and their settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MODEL_LABELS
from ..functions.spans import SPAN, cascade, detect
from .mask import mask_documents

STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}
DETECTOR_SLOTS: dict[str, Callable[[Column], Column]] = {"regex": detect}
METRICS: dict[str, Callable] = {}


def register_strategy(name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = transform


def register_detector(name: str, detector: Callable[[Column], Column]) -> None:
    DETECTOR_SLOTS[name] = detector


def register_metric(name: str, udf: Callable) -> None:
    METRICS[name] = udf


def strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in STRATEGIES:
        raise KeyError(f"no strategy {name}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def model_detector(find: Callable[[str, tuple[str, ...]], list[tuple[int, int, str]]]) -> Callable[[Column], Column]:
    """A detector from a function of text and labels; a failure counts as finding nothing, and then the regex detectors find."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([{"s": s, "ord": 0, "e": e, "label": label.upper().replace(" ", "_")} for s, e, label in find(t or "", MODEL_LABELS)])
            except Exception:  # a model's failure is not the text's
                out.append([])
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, f"array<{SPAN}>")
    return lambda text: cascade(udf(text), detect(text))


@dataclass
class PrivacySettings:
    """enabled: null means on if a method is named; switched off forces the method none."""

    enabled: bool = False
    method: str = "none"
    args: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict | None) -> PrivacySettings:
        if given is None:
            return cls(True, "token_anonymization", {})
        if not isinstance(given, dict):
            raise TypeError("privacy settings must be a mapping")
        method, enabled, args = given.get("method"), given.get("enabled"), given.get("args") or {}
        if not isinstance(args, dict):
            raise TypeError("args must be a mapping")
        if enabled is None:
            enabled = method not in (None, "", "none")
        if not isinstance(enabled, bool):
            raise TypeError("enabled must be true or false")
        return cls(enabled, (method or "token_anonymization") if enabled else "none", args)


register_strategy("none", lambda df: df.withColumn("masked", F.col("text")))
register_strategy("token_anonymization", lambda df: mask_documents(df, "token"))
register_strategy("full_cover", lambda df: mask_documents(df, "full"))
