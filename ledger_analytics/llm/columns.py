"""Tables whose columns may have any names, also those that an operator uses itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Numbered:
    """``df`` with its columns renamed by position, so that no name clashes with a new one."""

    def __init__(self, df: DataFrame):
        self._names = df.columns
        self.columns = [f"in_{i}" for i in range(len(self._names))]
        self.df = df.toDF(*self.columns)

    def __getitem__(self, name: str) -> str:
        """The new name of a column."""
        if name in self._names:
            return self.columns[self._names.index(name)]
        return self.columns[[n.lower() for n in self._names].index(name.lower())]

    def back(self, df: DataFrame) -> DataFrame:
        """The old columns of ``df``, which has the renamed ones among others."""
        return df.select(*self.columns).toDF(*self._names)


def with_spare(df: DataFrame, value, stem: str) -> tuple[DataFrame, str]:
    """``df`` with a column ``value`` under a name that it does not have, and the name."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name in taken:
        name += "_"
    return df.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(name)), name
