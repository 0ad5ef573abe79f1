"""Documents whose own column names are out of the way, each row with an identity that needs no shuffle."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.plans.materialize import materialize

ROW = "row"


class Veiled:
    """``df`` has the columns of ``docs`` under neutral names, and ``row``, unique and the same whenever it is read.

    Stored rows are told apart by their file and place in it. Others are stored
    first. So decisions can be made on a few narrow columns and meet the rows once.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.columns = docs.columns
        names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
        self._names = names
        veiled = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        try:
            if "_metadata" in docs.columns:
                raise AnalysisException("the name is taken")
            self.df = docs.select(*veiled, place.alias(ROW))
            self.df.schema  # noqa: B018  only files know places
        except AnalysisException:
            self.df = materialize(docs.select(*veiled, F.monotonically_increasing_id().alias(ROW)))

    def __getitem__(self, column: str) -> str:
        return self._names[column]

    def col(self, column: str) -> Column:
        return F.col(self._names[column])

    def restore(self, df: DataFrame, *more: str) -> DataFrame:
        """The columns of the documents under their names, and ``more``, which replace those named alike."""
        kept = [F.col(n).alias(c) for c, n in self._names.items() if c not in more]
        return df.select(*kept, *more)
