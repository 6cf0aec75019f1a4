"""Training-data operators: each works on whole tables as Spark jobs.

Nothing outside this folder imports it.
"""
