"""All registered queries: importing a plans module registers its queries."""

from breaklens.plans import (  # noqa: F401
    association,
    evaluation,
    graphs,
    joining,
    modeling,
    monitoring,
    preprocessing,
    rulesets,
    sampling,
    scalars,
    statistics,
    timeline,
)
from breaklens.plans.registry import ORACLE, QUERIES  # noqa: F401
