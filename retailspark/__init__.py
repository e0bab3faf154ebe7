"""Retail search and recommendation data jobs on Apache Spark."""
