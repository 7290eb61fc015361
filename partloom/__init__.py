"""Spark-native engine for part-level labels on 3D objects."""

from partloom.session import build_session, checkpointed, shared_dir

__all__ = ["build_session", "checkpointed", "shared_dir"]
