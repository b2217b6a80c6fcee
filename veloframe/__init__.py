"""veloframe: mobility-simulation analytics as PySpark DataFrame operators."""
