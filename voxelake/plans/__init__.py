"""Point clouds and the queries over them."""
