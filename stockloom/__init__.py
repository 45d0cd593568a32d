"""Stockloom: catalogue and inventory analytics written as Spark DataFrame jobs."""
