"""Queries over the driver's tables, one per operator; importing this registers them all."""

from . import contracts, evaluation, integrity, learning, mechanisms, promotion, read_model, rounds, rules, segments, timeline
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contracts", "evaluation", "integrity", "learning", "mechanisms", "promotion", "read_model", "rounds", "rules", "segments", "timeline"]
