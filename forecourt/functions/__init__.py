"""Column expressions and join, numbering and reshape helpers shared by the operators."""
