"""Whole flows built from the operators, and the registered queries over the test tables."""
