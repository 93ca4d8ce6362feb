"""Governed metrics as Spark DataFrame plans."""
