"""DataFrame transformations, one for each operator."""
