"""ledgerloom: business analytics operators as lazy Spark DataFrame programs."""
