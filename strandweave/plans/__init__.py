"""Importing this package registers every query."""

from . import captures, catalog, files, fulltext, health, ledger, matching, nodefiles, organizing, records, tagging, talk, times, upkeep

__all__ = ["captures", "catalog", "files", "fulltext", "health", "ledger", "matching", "nodefiles", "organizing", "records", "tagging", "talk", "times", "upkeep"]
