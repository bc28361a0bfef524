"""Domain operators: pure DataFrame -> DataFrame functions."""
