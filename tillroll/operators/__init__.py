"""Relational and mining operators over retail DataFrames."""
