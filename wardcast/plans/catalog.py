"""All named queries and their oracle SQL, merged from the plan modules."""

from __future__ import annotations

from wardcast.plans import (clinical_plans, feature_plans, model_plans,
                            oracle_clinical, oracle_features, oracle_models,
                            oracle_series, oracle_sources, series_plans, source_plans)

PLAN_MODULES = [(clinical_plans, oracle_clinical), (series_plans, oracle_series),
                (feature_plans, oracle_features), (model_plans, oracle_models),
                (source_plans, oracle_sources)]


def all_queries() -> dict:
    out = {}
    for plans, _ in PLAN_MODULES:
        out.update(plans.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for _, oracle in PLAN_MODULES:
        out.update(oracle.ORACLE)
    return out
