"""Expression and session helpers shared by the operators."""
