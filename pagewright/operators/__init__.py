"""DataFrame-level operators: extraction, links, traversal, index, search."""
