"""Readers and writers. Paths go to Spark, so any store that Spark reads will do."""
