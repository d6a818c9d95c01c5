"""functions of the analytics engine."""
