"""Operators over whole tables: ranking, retrieval, re-ranking, catalogue cleaning, entities and metrics."""
