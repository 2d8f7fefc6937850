"""The declared feature chain as Spark ML stages that can be saved and loaded.

Each stage is a Transformer with parameters only, so a chain is a PipelineModel: its folder
holds the columns, keys and lags that a trained pipeline declared, and a later session
applies the same features to other series.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline import SLOT_MINUTES
from wattline.functions.calendar import calendar_columns, deepar_time_columns
from wattline.operators.features import DEEPAR_LAGS, lag_rows, lag_time
from wattline.operators.panel import regular_grid


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage over series: ``keys`` name a series, ``ts`` orders it."""

    keys = Param(Params._dummy(), "keys", "columns that name a series", TypeConverters.toListString)
    ts = Param(Params._dummy(), "ts", "time column", TypeConverters.toString)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(keys=["item_id"], ts="datetime_15min")
        self._set(**given)

    def value(self, name: str):
        return self.getOrDefault(name)

    def in_order(self) -> Window:
        return Window.partitionBy(*self.value("keys")).orderBy(self.value("ts"))


class RegularGrid(_Stage):
    """Every slot from a series' first to its last; ``columns`` are kept, null where a slot had no row."""

    columns = Param(Params._dummy(), "columns", "columns to keep", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return regular_grid(df, self.value("columns")).drop("observed")


class TimeParts(_Stage):
    """Calendar columns: ``scaled`` to [-0.5, 0.5], or as whole numbers."""

    scaled = Param(Params._dummy(), "scaled", "scaled or whole", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, scaled=True, ts="datetime_15min"):
        super().__init__(**self._input_kwargs)
        self._setDefault(scaled=True)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns((deepar_time_columns if self.value("scaled") else calendar_columns)(self.value("ts")))


class ObservedFlag(_Stage):
    """``flag``: 1.0 where ``column`` is a number, else 0.0; ``filled``: the column with 0.0 in those places."""

    column = Param(Params._dummy(), "column", "column", TypeConverters.toString)
    flag = Param(Params._dummy(), "flag", "name of the flag", TypeConverters.toString)
    filled = Param(Params._dummy(), "filled", "name of the filled column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column=None, flag="observed", filled="target_filled"):
        super().__init__(**self._input_kwargs)
        self._setDefault(flag="observed", filled="target_filled")

    def _transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.value("column"))
        seen = c.isNotNull() & ~F.isnan(c)
        return df.withColumns({self.value("flag"): seen.cast("double"), self.value("filled"): F.when(seen, c).otherwise(F.lit(0.0))})


class LogAge(_Stage):
    """``output``: log10 of 2 plus the number of rows before in the series."""

    output = Param(Params._dummy(), "output", "name of the column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, output="age", keys=("item_id",), ts="datetime_15min"):
        super().__init__(**{k: list(v) if k == "keys" else v for k, v in self._input_kwargs.items()})
        self._setDefault(output="age")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.value("output"), F.log10(F.lit(2.0) + (F.row_number().over(self.in_order()) - 1)))


class Lags(_Stage):
    """``prefix`` + n: the value of ``column`` n rows (``by`` rows) or n slots (``by`` time) earlier."""

    column = Param(Params._dummy(), "column", "column", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "lags", TypeConverters.toListInt)
    prefix = Param(Params._dummy(), "prefix", "prefix of the names", TypeConverters.toString)
    by = Param(Params._dummy(), "by", "rows or time", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column=None, steps=None, prefix="lag_", by="rows", keys=("item_id",), ts="datetime_15min"):
        super().__init__(**{k: list(v) if k in ("keys", "steps") else v for k, v in self._input_kwargs.items()})
        self._setDefault(prefix="lag_", by="rows")

    def _transform(self, df: DataFrame) -> DataFrame:
        wanted = {f"{self.value('prefix')}{n}": n for n in self.value("steps")}
        if self.value("by") == "time":
            return lag_time(df, self.value("column"), wanted, self.value("keys"), self.value("ts"), SLOT_MINUTES)
        return lag_rows(df, self.value("column"), wanted, self.value("keys"), self.value("ts"))


def deepar_chain(column: str = "active_kw", lags: list[int] = DEEPAR_LAGS) -> PipelineModel:
    """F9 as declared: grid, scaled time parts, observed flag, age, row lags of the filled target."""
    return PipelineModel([RegularGrid(columns=[column]), TimeParts(), ObservedFlag(column=column), LogAge(), Lags(column="target_filled", steps=lags)])


def save_chain(chain: PipelineModel, path: str) -> None:
    chain.write().overwrite().save(path)


def load_chain(path: str) -> PipelineModel:
    return PipelineModel.load(path)
