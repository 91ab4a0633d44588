"""Collections of drawings and text corpora on Spark."""
