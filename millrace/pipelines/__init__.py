"""Pipelines built of the engine's parts."""
