"""Cohort de-identification as Spark DataFrame jobs."""
