"""Column expressions: identities, text and paths, arrays and tensors, JSON and tags, numbers."""
