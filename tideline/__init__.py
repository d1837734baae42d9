"""tideline: maritime traffic-flow analytics as Spark DataFrame operators."""
