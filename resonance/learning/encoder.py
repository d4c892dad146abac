"""A text encoder of the user's own as a stage: it is saved, loaded and streamed with the pipeline it is in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

#: What a function from texts to a matrix is called here.
Encoder = Callable[[list[str]], np.ndarray]
#: Encoders of this process, by loader and options: one load, however many batches, queries and streams.
_loaded: dict[tuple[str, str], Encoder] = {}
#: Texts encoded at once.
TEXTS = 256


def load(loader: str, options: str = "{}") -> Encoder:
    """The encoder that ``module:function`` gives when called with the options (a JSON object), kept in the process."""
    key = (loader, options)
    if key not in _loaded:
        module, _, function = loader.partition(":")
        _loaded[key] = getattr(import_module(module), function)(**json.loads(options))
    return _loaded[key]


class TextEncoder(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector of a text column (null: empty), by an encoder that every worker loads once.

    ``loader`` names a function, ``module:function``, that executors can import; called with ``options`` it returns a
    function from a list of texts to a matrix of ``size`` columns. Only the names are saved, not the encoder.
    """

    loader = Param(Params._dummy(), "loader", "module:function that gives the encoder", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "JSON object of the function's arguments", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "width of the vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, loader=None, options="{}", size=None):
        super().__init__()
        self._setDefault(options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def getSize(self) -> int:
        return self.getOrDefault("size")

    def _transform(self, dataset):
        loader, options, size = (self.getOrDefault(p) for p in ("loader", "options", "size"))

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = load(loader, options)
            for batch in batches:
                texts, found = batch.tolist(), []
                for at in range(0, len(texts), TEXTS):
                    some = texts[at: at + TEXTS]
                    vectors = np.asarray(encoder(some), float).reshape(len(some), -1)
                    if vectors.shape[1] != size:
                        raise ValueError(f"encoder gave {vectors.shape[1]} dimensions, expected {size}")
                    found += list(vectors)
                yield pd.Series(found, dtype=object)

        encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        vector = F.pandas_udf(encode, "array<double>")(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(vector))


def letter_counts(size: int = 16) -> Encoder:
    """A loader for trying things out: counts of letters, by code, as unit vectors."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
            out[i] = np.bincount(codes % size, minlength=size)
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return encode
