"""Readers, sinks, declared schemas and the deterministic fixtures."""
