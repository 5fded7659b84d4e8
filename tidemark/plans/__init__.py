"""Statements, jobs and the driver's queries."""
