"""Search, clustering and evaluation operators."""
