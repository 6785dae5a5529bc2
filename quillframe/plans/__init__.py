"""Registered queries: input views, Spark plans and their SQL checks."""
