"""Tessera: document-intelligence and retrieval analytics as Spark DataFrame plans."""
