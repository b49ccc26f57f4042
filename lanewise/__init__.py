"""lanewise: live read mapping and training-data operators on Spark."""
