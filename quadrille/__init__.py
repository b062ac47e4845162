"""Graph-shaped analytics on Spark: triples, queries over them, rules, probabilities, streams and learned relations."""

from .dataset import Dataset
from .engine import QueryEngine
from .operators.builder import TripleQuery
from .reason.reasoner import Hierarchy, Reasoner

__all__ = ["Dataset", "QueryEngine", "TripleQuery", "Reasoner", "Hierarchy"]
