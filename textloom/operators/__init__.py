"""The index, its queries and what is done with them."""
