"""Relational tables to nested document datasets, on Spark."""

from docnest.operators.nest import embed_chunks, embed_junction, embed_levels, embed_many, embed_one
from docnest.operators.patterns import (
    Approximation,
    Attribute,
    Computed,
    Custom,
    Outlier,
    Subset,
    apply_patterns,
    register_pattern,
)
from docnest.plans.migrate import Migration, migrate, plan_for
from docnest.plans.model import EMBED, REFERENCE, Catalogue, Edge, PlanError, Settings, TableSpec

__all__ = [
    "EMBED", "REFERENCE", "Approximation", "Attribute", "Catalogue", "Computed", "Custom", "Edge", "Migration",
    "Outlier", "PlanError", "Settings", "Subset", "TableSpec", "apply_patterns", "embed_chunks", "embed_junction", "embed_levels",
    "embed_many", "embed_one", "migrate", "plan_for", "register_pattern",
]
