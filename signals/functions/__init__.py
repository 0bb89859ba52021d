"""Column expressions and scalar statistics shared by the operators."""
