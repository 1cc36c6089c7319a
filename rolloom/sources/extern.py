"""Functions and classes of the user's own, by file or module and name."""

from __future__ import annotations

import functools
import importlib
import importlib.util
import inspect
import os
import sys
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def load_extern(path: str, name: str) -> Any:
    """The object ``name`` of a Python file, or of a module (``pkg://package.module``).

    What it defines travels to Python workers with its code, so executors need no copy of
    the file. A missing file raises FileNotFoundError, a file that fails RuntimeError, a
    missing name AttributeError."""
    if path.startswith("pkg://"):
        return getattr(importlib.import_module(path[len("pkg://") :].replace("/", ".")), name)
    place = os.path.abspath(os.path.expanduser(path))
    if not os.path.isfile(place):
        raise FileNotFoundError(f"no file {path}")
    called = "rolloom_extern_" + "".join(c if c.isalnum() else "_" for c in place)
    module = sys.modules.get(called)
    if module is None:
        spec = importlib.util.spec_from_file_location(called, place)
        module = importlib.util.module_from_spec(spec)
        sys.modules[called] = module
        try:
            spec.loader.exec_module(module)
        except Exception as e:
            del sys.modules[called]
            raise RuntimeError(f"{path} could not be loaded") from e
        cloudpickle.register_pickle_by_value(module)
    return getattr(module, name)


def custom_score(path: str, name: str, extra: Mapping[str, Any] | None = None, parts: Mapping[str, str] | None = None) -> Callable[..., Column]:
    """A scorer ``(source, response, truth, info) -> struct`` from a user's function
    ``fn(data_source=, solution_str=, ground_truth=, extra_info=, **extra)``.

    The function gives a number or a mapping with ``score``; ``parts`` names further entries
    to keep and their SQL types. The result has ``score`` and the parts; ``extra`` goes before
    what the row brings. ``info`` is any column, a JSON text say. A coroutine is run to its end."""
    fn, fixed, parts = load_extern(path, name), dict(extra or {}), dict(parts or {})
    if not callable(fn):
        raise TypeError(f"{name} of {path} is no function")
    run = functools.partial(_scored, fn, fixed, tuple(parts))
    schema = ", ".join(["score double", *[f"{k} {t}" for k, t in parts.items()]])

    @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def score(source: pd.Series, response: pd.Series, truth: pd.Series, info: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run(*row) for row in zip(source, response, truth, info, strict=True)], columns=["score", *parts])

    return lambda source, response, truth, info=None: score(source, response, truth, info if info is not None else F.lit(None).cast("string"))


def _scored(fn: Callable, fixed: dict, parts: tuple, source, response, truth, info) -> tuple:
    made = fn(**({"data_source": source, "solution_str": response, "ground_truth": truth, "extra_info": info} | fixed))
    if inspect.iscoroutine(made):
        import asyncio

        made = asyncio.run(made)
    if isinstance(made, Mapping):
        return (float(made["score"]), *[made.get(p) for p in parts])
    return (float(made), *[None for _ in parts])
