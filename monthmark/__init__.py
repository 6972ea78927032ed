"""monthmark: month-end portfolio analytics on Spark.

Master tables with effective dates go in, a month-end panel comes out, and every
report, change flag, rating and reconciliation is a DataFrame-to-DataFrame function.
"""
