"""User-supplied functions by name: metrics, comparators, blockers, classifiers, preprocessors, tokenizers.

Registries live on the driver; a function is shipped with the plan that uses it. Column functions (Column -> Column) stay
in the JVM; plain Python functions are wrapped in Arrow UDFs. An exception in a plain function gives the fallback
of its kind (score 0, no match, the input itself) for that row only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F

KINDS = ("metric", "comparator", "blocker", "classifier", "preprocessor", "tokenizer")
_REGISTERED: dict[str, dict[str, Any]] = {k: {} for k in KINDS}
_COLUMNAR: set[tuple[str, str]] = set()


def _add(kind: str, name: str, f: Any, columnar: bool) -> Any:
    _REGISTERED[kind][name] = f
    (_COLUMNAR.add if columnar else _COLUMNAR.discard)((kind, name))
    return f


def register_metric(name: str | Callable, func: Callable | None = None, *, columnar: bool = False):
    """register_metric(name, f), @register_metric(name) or @register_metric; built-in names cannot be taken."""
    from kinloom.functions.similarity import METRICS

    if callable(name):
        return register_metric(name.__name__, name)
    if func is None:
        return lambda f: register_metric(name, f, columnar=columnar)
    if name in METRICS:
        raise ValueError(f"{name!r} is a built-in metric")
    if not columnar:
        float(func("test", "test"))
    return _add("metric", name, func, columnar)


def register_comparator(name: str, func: Callable, *, columnar: bool = False):
    if not columnar:
        float(func("test", "test"))
    return _add("comparator", name, func, columnar)


def register_blocker(name: str, blocker: Any):
    """An object with block_dedup(df) -> pairs and block_link(left, right) -> pairs, pairs having left_id and right_id."""
    for method in ("block_dedup", "block_link"):
        if not callable(getattr(blocker, method, None)):
            raise ValueError(f"a blocker needs a method {method}")
    return _add("blocker", name, blocker, True)


def register_classifier(name: str, func: Callable, *, columnar: bool = False):
    return _add("classifier", name, func, columnar)


def register_preprocessor(name: str, func: Callable, *, columnar: bool = False):
    if not columnar and not isinstance(func("test"), str):
        raise ValueError("a preprocessor returns a string")
    return _add("preprocessor", name, func, columnar)


def register_tokenizer(name: str, func: Callable, *, columnar: bool = False):
    return _add("tokenizer", name, func, columnar)


def unregister(kind: str, name: str) -> bool:
    return _REGISTERED[kind].pop(name, None) is not None


def registered(kind: str) -> list[str]:
    return sorted(_REGISTERED[kind])


def _named(kind: str):
    return lambda name: unregister(kind, name), lambda: registered(kind)


unregister_metric, list_custom_metrics = _named("metric")
unregister_comparator, list_custom_comparators = _named("comparator")
unregister_blocker, list_custom_blockers = _named("blocker")
unregister_classifier, list_custom_classifiers = _named("classifier")
unregister_preprocessor, list_custom_preprocessors = _named("preprocessor")
unregister_tokenizer, list_custom_tokenizers = _named("tokenizer")


def _get(kind: str, name: str) -> Any:
    try:
        return _REGISTERED[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} named {name!r}; registered: {registered(kind)}") from None


def _pairwise(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    def one(a, b):
        if a is None or b is None:
            return None
        try:
            return float(f(a, b))
        except Exception:  # noqa: BLE001 - a failing user function scores 0
            return 0.0

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def metric(name: str) -> Callable[[Column, Column], Column]:
    f = _get("metric", name)
    return f if ("metric", name) in _COLUMNAR else _pairwise(f)


def comparator(name: str) -> Callable[[Column, Column], Column]:
    f = _get("comparator", name)
    return f if ("comparator", name) in _COLUMNAR else _pairwise(f)


def blocker(name: str) -> Any:
    return _get("blocker", name)


def classifier(name: str) -> Callable[[Column], Column]:
    """scores array -> struct<score double, match_class string>."""
    f = _get("classifier", name)
    if ("classifier", name) in _COLUMNAR:
        return f

    def one(scores):
        try:
            score, label = f([float(x) for x in scores])
            return float(score), label if label in ("match", "possible", "non_match") else "non_match"
        except Exception:  # noqa: BLE001
            return 0.0, "non_match"

    @F.pandas_udf("score double, match_class string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=["score", "match_class"])

    return run


def preprocessor(name: str) -> Callable[[Column], Column]:
    f = _get("preprocessor", name)
    if ("preprocessor", name) in _COLUMNAR:
        return f

    def one(x):
        if x is None:
            return None
        try:
            return str(f(x))
        except Exception:  # noqa: BLE001
            return x

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


def tokenizer(name: str) -> Callable[[Column], Column]:
    f = _get("tokenizer", name)
    if ("tokenizer", name) in _COLUMNAR:
        return f

    def one(x):
        if x is None:
            return None
        try:
            return [str(t) for t in f(x)]
        except Exception:  # noqa: BLE001
            return [x]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run
