"""egresslens: exfiltration analytics as Spark DataFrame operators."""
