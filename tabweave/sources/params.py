"""Tuned parameters as typed documents for estimators."""

from __future__ import annotations

from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.ml.base import Estimator
from pyspark.ml.param import Params


def typed_params(stage: Params, document: dict[str, Any]) -> dict:
    """A parameter map of ``stage`` from a document of names and plain values.

    A name that the stage doesn't have, or a value that isn't of the parameter's type (a whole number
    given as text, a number for a switch), is refused with the names of all that are wrong.
    """
    found, wrong = {}, []
    for name, value in document.items():
        if not isinstance(name, str) or not stage.hasParam(name):
            wrong.append(f"{name}: unknown")
            continue
        param = stage.getParam(name)
        try:
            found[param] = param.typeConverter(value)
        except (TypeError, ValueError):
            wrong.append(f"{name}: {value!r} is not of its type")
    if wrong:
        raise ValueError(f"parameters refused by {type(stage).__name__}: {'; '.join(sorted(wrong))}")
    return found


def configured(stage: Estimator, document: dict[str, Any]) -> Estimator:
    """A copy of ``stage`` with the document's parameters; values out of their range are refused here, not in the fit."""
    params = typed_params(stage, document)
    try:
        return stage.copy(params)
    except IllegalArgumentException as e:  # the JVM's own checks of ranges
        raise ValueError(f"parameters refused by {type(stage).__name__}: {e}") from e


def documented(stage: Params) -> dict[str, str]:
    """Every parameter of a stage that is set, as text: what a fitted model was made with."""
    return {p.name: str(stage.getOrDefault(p)) for p in stage.params if stage.isSet(p)}
