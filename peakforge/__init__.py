"""Spectra analytics as Spark DataFrame jobs."""
