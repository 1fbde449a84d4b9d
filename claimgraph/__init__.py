"""Claim consensus and knowledge-graph analytics as Spark DataFrame operators."""
