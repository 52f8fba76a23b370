"""Operators for preparing training text: extraction, counting, scoring, formatting, filtering, sharding."""
