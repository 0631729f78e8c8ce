"""End-user jobs composed from the operators."""
