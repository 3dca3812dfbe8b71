"""Ranked retrieval, graph, fact-store and corpus analytics as DataFrame plans."""
