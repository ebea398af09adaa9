"""Registered queries, their SQL oracles, the SQL gate and the schema registry."""
