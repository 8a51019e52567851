"""Column functions over record headers, digests and URLs."""
