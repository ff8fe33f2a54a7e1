"""Spark jobs for retrieval, grounding and corpus work: DataFrames in, DataFrames out."""
