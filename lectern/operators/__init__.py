"""DataFrame operators from which queries are composed."""
