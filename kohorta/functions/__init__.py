"""Column functions: digests, ranks and token arithmetic."""
