"""All oracle queries, each a complete SQL text."""

from checks import churn_sql, health_sql, panel_sql, primitives_sql
from checks.build import with_relations
from checks.inputs_sql import INPUTS

RELATIONS = {**INPUTS, **panel_sql.R, **health_sql.R, **churn_sql.R}
SELECTS = {**panel_sql.Q, **health_sql.Q, **churn_sql.Q, **primitives_sql.Q}


def all_sql() -> dict[str, str]:
    return {name: with_relations(select, RELATIONS) for name, select in SELECTS.items()}
