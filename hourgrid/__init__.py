"""Hourly price analytics as Spark DataFrame operators.

Every public operator takes DataFrames plus plain parameters and returns a
DataFrame; nothing is collected to the driver.
"""
