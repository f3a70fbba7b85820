"""Jobs and dashboard queries built from the operators."""
