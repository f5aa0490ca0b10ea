"""Learning and estimation under a memory budget on Spark."""
