"""Column expressions and argument parsing shared by the operators."""
