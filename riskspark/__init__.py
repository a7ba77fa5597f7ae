"""riskspark: multi-asset risk analytics and corpus preparation as Spark DataFrame operators."""
