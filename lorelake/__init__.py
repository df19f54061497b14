"""Lorelake: knowledge-corpus analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and plain parameters) and returns
DataFrames.  Nothing here collects a data-sized result to the driver.
"""
