"""Cross-cutting plan helpers: sessions, durable cuts of lineage, skew handling."""
