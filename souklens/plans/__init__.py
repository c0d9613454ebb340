from souklens.plans.registry import QUERIES
from souklens.plans import (benchmark_plans, causal_plans, engagement_plans, event_plans, feature_plans, lift_plans,
                            panel_plans, primitive_plans, yoy_plans)

__all__ = ["QUERIES"]
