"""Spark-native operators for episodic decision trajectories."""

from stepweave.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
