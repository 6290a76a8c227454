"""Evidence analytics on Spark: scores, entity resolution, claims, research evidence, as DataFrame functions."""
