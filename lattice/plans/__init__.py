"""Queries over the test tables and over fixed inputs, one for each operator."""

from lattice.plans.fixed import FIXED
from lattice.plans.queries import PLANS, symbol_search_topk

PLANS |= FIXED

__all__ = ["PLANS", "symbol_search_topk"]
