"""See the README for the operator map."""
