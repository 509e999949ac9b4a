"""Traceable passage retrieval as Spark DataFrame programs."""
