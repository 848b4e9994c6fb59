"""Jobs and read models composed from the operators."""
