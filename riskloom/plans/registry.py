"""Imports every query module so each registers its queries, then
exposes the two maps used by ``__spark_entry__``."""

from riskloom.plans import q_features, q_operators, q_eval, q_smote, q_model  # noqa: F401
from riskloom.plans.catalog import ORACLE, QUERIES  # noqa: F401
