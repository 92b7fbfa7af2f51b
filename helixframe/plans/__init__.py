"""Report tables and the query registry, composed from operators."""
