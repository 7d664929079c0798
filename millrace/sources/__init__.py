"""Connectors, isolated reading and incremental reading."""
