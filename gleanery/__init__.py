"""Gleanery: a PySpark library that curates large, messy text tables.

Every public function takes DataFrames and returns DataFrames; nothing in the
package collects rows to the driver inside an operator.
"""
