"""Registered queries: adapters from the test tables, Spark plans, check SQL."""
