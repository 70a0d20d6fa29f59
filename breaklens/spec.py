"""Column roles of a transaction table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Names of the columns that play each role in an analysis."""

    key: str
    target: str
    changes: tuple[str, ...]
    labels: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    ts: str | None = None
    exclude: tuple[str, ...] = field(default=(), repr=False)

    @classmethod
    def infer(cls, df: DataFrame, key, target, changes, labels=(), ts=None, exclude=()):
        """Fill numeric and categorical from the schema, leaving the named roles out."""
        taken = {key, target, ts, *changes, *labels, *exclude}
        types = infer_types(df)
        return cls(
            key=key,
            target=target,
            changes=tuple(changes),
            labels=tuple(labels),
            numeric=tuple(c for c, kind in types.items() if kind == "numeric" and c not in taken),
            categorical=tuple(c for c, kind in types.items() if kind == "categorical" and c not in taken),
            ts=ts,
            exclude=tuple(exclude),
        )


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column name -> 'numeric', 'categorical' or 'other', by schema type alone."""
    kinds = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            kinds[f.name] = "categorical"
        else:
            kinds[f.name] = "other"
    return kinds


# Roles of the transaction fixture.
FLAGS = ["chg_factor", "chg_coupon", "chg_principal", "chg_date", "chg_interest", "chg_rating"]
LABELS = ["fld_factor", "fld_coupon", "fld_date"]
TARGET = "was_exception"
KEY = "txn_key"
