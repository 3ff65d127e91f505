"""Column helpers: keyed draws, array arithmetic and scalable ordering."""
