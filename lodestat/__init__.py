"""lodestat: revisioned statistics and evidence-backed text claims on Spark."""
