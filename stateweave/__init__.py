"""Register imports on Spark: scan, map, validate, number, identify, relate and compare.

Everything is a DataFrame in and a DataFrame (or Column) out, so Catalyst sees
the whole plan.  ``stateweave.plans.runner`` chains the operators for one
declarative import definition.
"""

__version__ = "0.1.0"
