"""Views of the supplied tables as a reference graph, and the catalogue of queries."""
