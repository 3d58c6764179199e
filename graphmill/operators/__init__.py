"""Graph building, matching, linking, enrichment and evaluation operators."""
