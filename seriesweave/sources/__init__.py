"""Reading recorder tables and registries, and writing rebuilt statistics."""
