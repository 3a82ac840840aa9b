"""otflow: network-flow security analytics as Spark DataFrame operators."""
