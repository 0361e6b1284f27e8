"""Graph, recommendation, table and flow operators."""
