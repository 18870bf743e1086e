"""Registered queries: a Spark plan and the SQL it is checked against."""
