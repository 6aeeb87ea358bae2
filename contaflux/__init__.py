"""Fiscal, treasury and document analytics as PySpark DataFrame transforms."""
