"""Skew-safe DataFrame operators: sequences, joins, profiles, features, walks, neighbours."""
