"""Whole queries, by name."""

from siltstone.plans import catalog_detect, catalog_last, catalog_more, catalog_rest, catalog_whole
from siltstone.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_detect", "catalog_last", "catalog_more", "catalog_rest", "catalog_whole"]
