"""Link-based vertex similarity on Spark."""
