"""The rules as functions of SQL, for queries that cannot go through ``mask``.

They run in Python workers, by Arrow batches; ``operators.mask`` is the fast way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config
from .hashing import pseudonym
from .names import category, classify
from .walk import Walker, dump, parse


def register(spark: SparkSession, config: Config | None = None) -> list[str]:
    """Make these callable in SQL, under the settings given; their names:

    ``pii_type(name)``, ``pii_category(name)``: what a column name means; null where nothing.
    ``mask_value(value, name)``: a cell as ``mask`` would leave it in a column of that name.
    ``mask_json(payload)``: a JSON payload as ``mask_payloads`` would leave it.
    ``pseudonym(value, salt)``: eight hexadecimal digits.
    """
    config = config or Config()

    @F.pandas_udf("string")
    def pii_type(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else classify(n))

    @F.pandas_udf("string")
    def pii_category(names: pd.Series) -> pd.Series:
        return names.map(lambda n: category(t) if n is not None and (t := classify(n)) else None)

    @F.pandas_udf("string")
    def mask_value(values: pd.Series, names: pd.Series) -> pd.Series:
        w = Walker(config)
        return pd.Series([None if v is None else w.text(v, n) if config.enabled else v for v, n in zip(values, names, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def mask_json(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                tree = parse(v.strip()) if v is not None and config.enabled else None
            except (ValueError, RecursionError):
                tree = None
            return v if tree is None else dump(Walker(config).payload(tree))

        return values.map(one)

    @F.pandas_udf("string")
    def pseudonym_of(values: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else pseudonym(s or "", v) for v, s in zip(values, salts, strict=True)], dtype=object)

    found = {"pii_type": pii_type, "pii_category": pii_category, "mask_value": mask_value, "mask_json": mask_json, "pseudonym": pseudonym_of}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
