"""riffle: river gauge analytics as Spark jobs."""
