"""Reports of results, and questions about written ones."""
