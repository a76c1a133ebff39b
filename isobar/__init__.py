"""Gridded ensembles and point tracks as Spark DataFrames.

A cube is long: dataset, variable, realization, time, lat, lon, value, one row a
cell, null where a value is missing.  Operators take and return DataFrames.
"""

from .plans.api import DataDiagnostics, ISOConfig, MJOConfig, ObservationData, ReplicabilityTest, ScientificEvaluation, SimulationData, TCConfig

__all__ = ["DataDiagnostics", "ISOConfig", "MJOConfig", "ObservationData", "ReplicabilityTest", "ScientificEvaluation", "SimulationData", "TCConfig"]
