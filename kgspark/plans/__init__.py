"""The algebra, mapping documents and the catalogue of queries."""
