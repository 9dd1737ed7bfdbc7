"""Sensor-history analytics as Spark DataFrame operators.

Every operator works on all series of a table at once; see README.md.
"""
