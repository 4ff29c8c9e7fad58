"""Composed jobs, derived relations and the registered queries."""
