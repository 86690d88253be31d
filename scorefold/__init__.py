"""scorefold: curate, score, merge and evaluate reasoning datasets with PySpark.

Every operator is a ``DataFrame -> DataFrame`` function made of Spark
expressions, so Catalyst plans the work and the cluster runs it.
"""
