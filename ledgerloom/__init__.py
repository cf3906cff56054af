"""Ledger analytics and reconciliation expressed as Spark DataFrame plans."""
