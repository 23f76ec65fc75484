"""Whole plans: import definitions, the definition runner and the composite register queries."""
