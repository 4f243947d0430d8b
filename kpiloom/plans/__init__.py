"""Star-schema builders and the query library over them."""
