"""Cohort analytics and training-data operations as Spark DataFrame transformations."""
