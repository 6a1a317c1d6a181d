"""Operators over unbounded inputs of records."""
