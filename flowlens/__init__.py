"""flowlens: off-exchange trading flow analytics as lazy Spark DataFrame operators."""
